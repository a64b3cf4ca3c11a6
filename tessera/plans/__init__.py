"""Named queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from tessera.plans import fact_queries, graph_queries, knowledge_queries, read_queries, search_queries, source_queries, store_queries, upkeep_queries, written_queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
