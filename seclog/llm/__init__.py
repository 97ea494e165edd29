"""Operators for building training data: one module per operator, named by what it does.

Nothing outside this package and ``corpus_pipeline.py`` imports it.
"""
