"""Rows that only larger or odd tables hold: both engines say the same."""

import datetime
import itertools
import types

import duckdb
import pytest

from panelspark import catalog
from panelspark.operators import xsection as X
from panelspark.queries import factors, grids, reports, studies
from panelspark.sources import files

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def both(spark, name, folder, **other):
    """Rows of a query in Spark and in DuckDB over the tables of DIR, but for those of `other`, written as SQL over the former."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"COPY ({other.get(t, 'SELECT * FROM ' + repr(f'{DIR}/{t}.parquet'))}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    cols = ", ".join(df.columns)
    return sorted(map(tuple, df.collect()), key=str), sorted(con.sql(f"SELECT {cols} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=str)


def test_a_fill_without_turnover_costs_nothing(spark, tmp_path):
    events = f"SELECT * REPLACE (CASE WHEN event_id % 10 = 0 THEN 0.0 WHEN event_id % 10 = 1 THEN NULL ELSE value END AS value) FROM '{DIR}/events.parquet'"
    ours, theirs = both(spark, "p12_fees", tmp_path, events=events)
    assert ours == theirs
    assert all(r[1:] == (0.0, 0.0) for r in ours if r[0] % 10 < 2) and all(r[1] > 4.9 for r in ours if r[0] % 10 > 1)


def test_stops_at_the_level_itself_have_no_t(spark, tmp_path):
    own = f"SELECT * REPLACE (100.0 * l_quantity AS l_extendedprice, 0.05 AS l_discount) FROM '{DIR}/lineitem.parquet'"
    low = f"SELECT * REPLACE (l_quantity AS l_extendedprice, 0.05 AS l_discount) FROM '{DIR}/lineitem.parquet'"
    ours, theirs = both(spark, "q14_stops", tmp_path, lineitem=f"{own} UNION ALL {low}")
    at = [r for r in ours if r[0] == "intraday"]
    assert at and all(r[4] == 1.0 and r[5] == -r[1] and r[7] is None for r in at)
    assert [r[:7] for r in ours] == [r[:7] for r in theirs] and [r[7] for r in ours] == [r[7] for r in theirs]


def uncorrelated():
    """Groups of seven pairs of ranks without any correlation."""
    mine = range(1, 8)
    return [p for p in itertools.permutations(mine) if sum((a - 4) * (b - 4) for a, b in zip(mine, p)) == 0]


def test_no_rank_correlation_is_nought(spark):
    rows = [(g, float(a), float(b)) for g, p in enumerate(uncorrelated()) for a, b in zip(range(1, 8), p)]
    ic = X.rank_ic(spark.createDataFrame(rows, "g int, v double, fwd double"), "v", "fwd", ("g",))
    assert {r.ic for r in ic.collect()} == {0.0}
    s = X.ic_summary(ic).first()
    assert (s.n, s.hit) == (len(uncorrelated()), 0.0)


def test_sql_of_rank_correlations_tells_none_from_nought():
    rows = ", ".join(f"('f', 'f', {g}, {a}.0, {b}.0)" for g, p in enumerate(uncorrelated()) for a, b in zip(range(1, 8), p))
    con = duckdb.connect()
    for name, sql, x in (("lr", studies.LONG["li"], "ic"), ("lk", grids.LEGS["lic"], "x"), ("rk", factors.IC["ics"], "ic")):
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM (VALUES {rows}) r(factor, leg, date, a, b)")
        assert con.sql(f"SELECT count(*) FROM ({sql}) z WHERE {x} > 0").fetchall() == [(0,)]


def test_no_run_is_ahead_of_its_equal(spark, monkeypatch):
    s = spark.createDataFrame([("all", 1.0, -0.1, 0.5, 0.1), ("ten", 1.0 + 1e-13, -0.1, 0.5 + 1e-13, 0.1), ("base", 1.1, -0.1, 0.6, 0.1)], "variant string, log_wealth double, max_drawdown double, sharpe double, ann_mean double")
    two = spark.createDataFrame([("c", datetime.date(2000, 1, 3), 1.0, 1.0)], "code string, date date, close_a double, close_b double")
    monkeypatch.setattr(reports, "low_ranks", lambda t: (s.selectExpr("1 AS p", "1 AS n"), s.select("variant")))
    monkeypatch.setattr(reports, "daily", lambda *a: None)
    monkeypatch.setattr(reports, "summary", lambda d: s)
    got = reports.q37(types.SimpleNamespace(month_ends=s.select("variant").withColumnRenamed("variant", "date"), two_source=two)).collect()
    assert {r.variant: (r.ahead, r.steadier) for r in got} == {"all": (False, False), "ten": (False, False), "base": (True, True)}


@pytest.mark.parametrize("name", ["q33_exits", "q34_ladder", "q35_touches"])
def test_listings_deal_the_facts_once(spark, monkeypatch, name):
    real, plans = files.written, []

    def caught(df, n):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, n)

    monkeypatch.setattr(files, "written", caught)
    out = catalog.queries()[name](spark, DIR)
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    assert len(plans) == 1 and plans[0].count("Exchange") == 1
