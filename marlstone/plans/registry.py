"""All queries of the engine itself, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import admin, crawling, dialogue, evaluation, flow, graphs, ingest, lookup, maintenance, scalars, scalars_more, search, uploads  # noqa: F401  each registers its queries
from .base import ORACLE_SQL, QUERIES
from .search import vector_search as flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
