"""All registered queries of the panel engine."""

from __future__ import annotations

from panelspark.queries import ORACLES, QUERIES, blends, books, drifts, events, factors, grids, joins, landed, listings, live, more, reports, samples, sources, stats, studies  # noqa: F401


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
