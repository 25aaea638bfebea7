"""Operators for large training-text corpora: sharding, token counts, URL rules, near-dedup,
language ID, decontamination, packing, line dedup and quality scoring.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per
operator; ``corpus_pipeline.py`` at the repository top chains five of them.
"""
