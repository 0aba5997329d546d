"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import evidence_queries, frame_queries, geometry_queries, protocol_queries, text_queries
from .registry import QUERIES, SQL, Query

MODULES = (geometry_queries, evidence_queries, text_queries, frame_queries, protocol_queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
