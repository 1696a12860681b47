"""Operators for building training corpora: one module per operator, queries in ``queries.py``.

Nothing outside this folder imports it, except the entry module's guarded import.
"""
