"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this subpackage.  Each
module holds one operator with a general interface; ``queries`` holds the thin
query wrappers and the SQL that checks them.
"""
