"""Query registry: one key per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import query_graph, query_reports, query_samples
from .declare import ORACLE_SQL, QUERIES

FLAGSHIP = "c11_blocks"
MODULES = (query_graph, query_reports, query_samples)
__all__ = ["FLAGSHIP", "MODULES", "ORACLE_SQL", "QUERIES"]
