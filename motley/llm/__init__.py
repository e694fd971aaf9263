"""Operators for training-data pipelines over documents, pages and vectors.

Nothing outside this subpackage imports it.
"""
