"""Every registered panel query, with its SQL counterpart where one exists."""

from . import feature_queries, panel_queries, research_queries, store_queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "feature_queries", "panel_queries", "research_queries", "store_queries"]
