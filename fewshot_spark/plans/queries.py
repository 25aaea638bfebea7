"""All registered queries (import order = registration order)."""

from __future__ import annotations

from . import q_data, q_examples, q_label_sets, q_models, q_runs, q_train, q_words  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "flagship"
