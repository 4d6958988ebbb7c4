"""Operators of a training-data pipeline over whole corpora; see corpus_pipeline.py for a chain of them."""
