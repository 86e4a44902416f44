"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and ``__spark_entry__.py`` are its only users.
"""
