"""Operators for training-data pipelines over text, pages, conversations and embeddings.

Nothing else in the library imports this subpackage.  Operators take and return
DataFrames; Python code inside them runs in Arrow batches on executors.  The thin
queries that apply each operator to its whole table are in ``queries``.
"""
