"""All registered queries of the library."""

from . import block_queries, interval_queries, library_queries, result_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
