"""Operators for preparing text corpora at scale.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
