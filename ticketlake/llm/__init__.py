"""Operators for building training data at scale.

Nothing outside this subpackage imports it. Every module holds one operator
with a general interface; `queries.py` derives the registered queries from
them.
"""
