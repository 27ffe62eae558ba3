"""Operators for large-scale training-data pipelines.

Each module holds one operator and the thin ``opN_`` query that applies it to
the ``documents`` or ``pages`` table.  Nothing outside this subpackage imports
it.
"""
