"""A sample of the registered queries against DuckDB on the smallest tables; all SQL must at least parse."""

import math

import duckdb
import pytest

from panelspark import catalog

DIR = "/root/testdata/sf0.001"
SAMPLE = ("p5_limit_flags", "w4_w6_risk_liquidity", "w13_rolling_box", "w17_threshold_reversal", "x2_x4_f6_blend", "x9_rank_ic", "j5_report_asof", "j12_revision_match", "a3_clustered_t", "b1_b2_ew_portfolio", "b1_rebalances", "e4_event_cars", "e9_e11_ladder", "t4_t7_stream_ledger", "s14_s15_incremental_merge", "q1_factor_ic", "q14_stops", "q17_index_caar", "q23_box_vs_hold", "q38_cb_paper", "q42_dataset_build", "q43_minute_accumulation", "x19_weight_cap", "x7_hysteresis", "t5_publication_gate", "t2_stream_dedup", "t3_late_rows", "t1_stream_bars_merge", "s22_sink_parquet", "q15_boundaries", "q13_hedge_grid", "q19_samples", "q24_arms", "q33_exits", "e15_decisions", "q4_universes", "q22_arms")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.sql(catalog.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_all_sql_binds(con):
    for name, sql in catalog.oracle_sql().items():
        con.sql(f"EXPLAIN {sql}").fetchall()


def test_entry_without_text_operators(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
