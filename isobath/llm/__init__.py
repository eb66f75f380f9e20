"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general DataFrame -> DataFrame interface and a thin ``op<N>_...`` query
that applies it to a whole table.
"""
