"""Run settings (typed, checked once) and the run identifier."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

LOSSES = ("CosineSimilarityLoss", "TripletLoss")
CLASSIFIERS = ("logistic_regression", "LinearSVC", "centroid")
STRATEGIES = ("one-vs-rest", "multi-output", "classifier-chain")
KINDS = ("single", "multilabel", "ablation")

# Result-folder names of the three run kinds. ``{exp}`` is empty by default, which
# leaves three dashes before ``margin``; trailing dashes are stripped.
RUN_ID_FORMATS = {
    "single": "{setting}-{model}-{loss}-{classifier}-itarations_{iters}-batch_{batch}-{exp}--margin_{margin}",
    "multilabel": "MULTILABEL-{setting}-{model}-{loss}-{classifier}-itarations_{iters}-batch_{batch}-{exp}--margin_{margin}",
    "ablation": "TEM-{model}-{loss}-{classifier}-itarations_{iters}-batch_{batch}-{exp}--margin_{margin}--{setting}",
}


@dataclass(frozen=True)
class RunConfig:
    """Settings of one run. Defaults follow the original experiments where they are defined
    (iterations 40, batch 16, logistic regression, cosine-similarity loss, margin 0.25, 10 seeds,
    one-vs-rest); the sample-size default is the list ``(16,)``. ``datasets``, ``is_dev_set`` and
    ``is_test_set`` choose the sets that ``loading.load_sets`` reads by name. Texts are whole unless
    ``max_seq_length`` names a number of tokens. ``max_fit_rows`` (none by default) bounds the rows one
    split's head and adapter are fitted on (those with the smallest seeded hash of their id). A split
    of up to ``stream_rows`` rows streams through one task; a larger one is trained by distributed
    steps, at most ``max_large_steps`` of them. Records are committed after every
    ``splits_per_commit`` splits. ``optimizer``: plain steps (``sgd``) or ``adamw``. ``on_empty`` says
    what happens to a multi-label row without a disjoint partner: ``skip`` (counted in the result)
    or ``raise``. The classifier ``centroid`` (class means) with ``use_adapter=False`` is a baseline
    that SQL can restate. ``save_embeddings`` stores test and anchor vectors beside the results.

    ``checkpoint_intermediates`` cuts the lineage of a run's example and row tables with a reliable
    ``checkpoint()`` (into ``spark.checkpoint.dir``) instead of ``persist()``, so a lost executor
    does not trigger recomputation of the sampling and partner joins."""

    model: str = "hash-256"
    datasets: tuple[str, ...] = ()
    sample_sizes: tuple[int, ...] = (16,)
    num_iterations: int = 40
    batch_size: int = 16
    max_seq_length: int | None = None
    classifier: str = "logistic_regression"
    loss: str = "CosineSimilarityLoss"
    margin: float = 0.25
    exp_name: str = ""
    add_normalization_layer: bool = False
    is_dev_set: bool = False
    is_test_set: bool = False
    setting_name: str = "DEV"
    seeds_num: int = 10
    override_results: bool = False
    multi_target_strategy: str = "one-vs-rest"
    kind: str = "single"
    draw_seed: int = 0
    encoder_dim: int = 256
    use_adapter: bool = True
    adapter_lr: float = 0.5
    optimizer: str = "sgd"
    max_fit_rows: int | None = None
    stream_rows: int = 200_000
    max_large_steps: int = 200
    splits_per_commit: int = 256
    on_empty: str = "skip"
    save_embeddings: bool = False
    results_dir: str | None = None
    checkpoint_intermediates: bool = False
    # optional encoder for runs: DataFrame(row_id, text) -> DataFrame(row_id, embedding ARRAY<DOUBLE>),
    # e.g. ``lambda df: encode_with_model(df, factory, dim)``; None = the hashed encoder
    encoder: Callable | None = field(default=None, compare=False, repr=False)

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss must be one of {LOSSES}")
        if self.classifier not in CLASSIFIERS:
            raise ValueError(f"classifier must be one of {CLASSIFIERS}")
        if self.multi_target_strategy not in STRATEGIES:
            raise ValueError(f"multi_target_strategy must be one of {STRATEGIES}")
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        if self.kind == "multilabel" and self.classifier == "LinearSVC":
            raise ValueError("multi-label heads are logistic_regression or centroid")
        if self.kind == "ablation" and self.setting_name == "B":
            raise ValueError("setting 'B' has no label or template tables")
        if isinstance(self.sample_sizes, int) or not self.sample_sizes or min(self.sample_sizes) < 1:
            raise ValueError("sample_sizes must be a non-empty sequence of positive integers")
        if self.on_empty not in ("skip", "raise"):
            raise ValueError("on_empty must be 'skip' or 'raise'")
        if self.optimizer not in ("sgd", "adamw"):
            raise ValueError("optimizer must be 'sgd' or 'adamw'")
        for name in ("num_iterations", "batch_size", "max_seq_length", "seeds_num", "encoder_dim", "max_fit_rows", "stream_rows", "max_large_steps", "splits_per_commit"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be >= 1")

    @property
    def seeds(self) -> list[int]:
        return list(range(self.seeds_num))

    @property
    def triplet(self) -> bool:
        return self.loss == "TripletLoss"

    def as_dict(self) -> dict:
        d = {k: v for k, v in asdict(self).items() if k != "encoder"}
        d["encoder"] = None if self.encoder is None else getattr(self.encoder, "__qualname__", type(self.encoder).__qualname__)
        return d


# Settings that change no record: which splits are asked for, where and how often they are stored,
# and how intermediates are kept.
_NOT_IN_RECORDS = {
    "datasets", "sample_sizes", "seeds_num", "is_dev_set", "is_test_set", "override_results", "save_embeddings",
    "results_dir", "checkpoint_intermediates", "splits_per_commit",
}


def settings_key(cfg: RunConfig) -> str:
    """Fingerprint of every setting that can change a record (a new field of ``RunConfig`` counts
    until it is named above), beside the run's name in the result table's partitions."""
    kept = {k: v for k, v in cfg.as_dict().items() if k not in _NOT_IN_RECORDS}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, default=str).encode()).hexdigest()[:16]


def run_id(cfg: RunConfig) -> str:
    """Name of the run (the result folder of the original scripts)."""
    text = RUN_ID_FORMATS[cfg.kind].format(
        setting=cfg.setting_name, model=cfg.model.replace("/", "-"), loss=cfg.loss, classifier=cfg.classifier,
        iters=cfg.num_iterations, batch=cfg.batch_size, exp=cfg.exp_name, margin=cfg.margin,
    )
    return text.rstrip("-")
