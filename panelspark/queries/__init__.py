"""Registered queries: operators applied to the derived tables, with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.sources.tables import Tables, ctes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Digits that doubles are rounded to on both sides, and a nudge off ties: sums don't depend on their order then.
DIGITS, NUDGE = 6, 1.0000000003


def query(name: str, sql: str | None = None, doubles: str = "", extra: dict[str, str] | None = None) -> Callable:
    """Register f(tables) as a query; doubles: its floating columns, rounded on both sides. sql names derived tables freely."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        def run(spark, sf_dir):
            df = f(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c) * NUDGE, DIGITS) + F.lit(0.0) for c in doubles.split()}) if doubles else df

        QUERIES[name] = run
        if sql:
            swaps = ", ".join(f"round(CAST({c} AS DOUBLE) * CAST({NUDGE} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            body = ctes(sql, extra)
            ORACLES[name] = f"SELECT * REPLACE ({swaps}) FROM ({body})" if swaps else body
        return f

    return register
