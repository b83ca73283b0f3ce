"""Operators of a training-data pipeline over text corpora and embeddings.

Nothing outside this package imports it; ``queries`` registers one query for each operator.
"""
