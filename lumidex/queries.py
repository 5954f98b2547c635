"""All queries of the media library, and the SQL that gives the same rows."""

from __future__ import annotations

from . import queries_search, queries_usage, queries_vectors
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "queries_search", "queries_usage", "queries_vectors"]
flagship = queries_search.flagship
