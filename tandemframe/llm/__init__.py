"""Corpus operators for training-data preparation.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it: the rest
of the library works without it.
"""
