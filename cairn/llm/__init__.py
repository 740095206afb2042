"""Operators for building training data: deduplication, scans, language models, mixing.

Nothing outside this folder, `corpus_pipeline.py` and the guard in `__spark_entry__.py`
imports it.
"""
