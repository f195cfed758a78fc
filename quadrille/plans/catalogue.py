"""Queries by name, and the SQL that gives the same rows."""

from . import format_queries, graph_queries, mapping_queries, mining_queries, report_queries, run_queries, term_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "format_queries", "graph_queries", "mapping_queries", "mining_queries", "report_queries", "run_queries", "term_queries"]
