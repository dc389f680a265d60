"""Operators of a training-data pipeline: packing, tokenization, vector search,
de-duplication, URL filters and document classifiers.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
