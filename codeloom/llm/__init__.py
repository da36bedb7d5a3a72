"""Operators for training-data pipelines over a table of documents.

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
