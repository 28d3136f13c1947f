"""All registered queries of the core library."""

from __future__ import annotations

from tarnwell.plans import evaluation_queries, io_queries, table_queries, text_queries  # noqa: F401  they register themselves
from tarnwell.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
