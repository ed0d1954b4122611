"""Operators for training-data corpora. Nothing outside this folder and corpus_pipeline.py imports them."""
