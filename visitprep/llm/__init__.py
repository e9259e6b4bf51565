"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; ``queries`` holds the thin registered queries.
"""
