"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin queries that read the standard tables are in ``queries``.
"""
