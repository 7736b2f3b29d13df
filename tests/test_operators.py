"""Hand-computed cases of the panel operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelspark.functions import dist
from panelspark.functions import scalars as S
from panelspark.operators import asof as J
from panelspark.operators import events as E
from panelspark.operators import ingest as I
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X


def d(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_limit_flags_and_boards(spark):
    rows = [("sh.688001", 12.0, 10.0), ("sh.600001", 11.0, 10.0), ("sh.600001", 9.0, 10.0), ("sz.300001", 10.5, 10.0), ("sh.600002", None, 10.0), ("sh.600003", 5.0, None)]
    df = frame(spark, rows, "code string, close double, pre double")
    out = df.select(S.board_of("code"), S.limit_flag("close", "pre", S.limit_width("code", F.lit(d(0))))).collect()
    assert [tuple(r) for r in out] == [("STAR", 1), ("Main", 1), ("Main", -1), ("ChiNext", 0), ("Main", None), ("Main", 0)]


def test_cost_and_stop_specs(spark):
    with pytest.raises(ValueError):
        S.CostSpec(commission=-1)
    with pytest.raises(ValueError):
        S.StopSpec()
    r = frame(spark, [(0.0,), (1000.0,), (1e6,)], "t double").select(S.CostSpec().buy_fee("t")).collect()
    assert [round(x[0], 6) for x in r] == [0.0, 5.01, 260.0]
    bars = frame(spark, [(10.0, 9.5, 8.0, 12.0), (10.0, 8.5, 8.5, 9.0), (10.0, None, None, None), (0.0, 1.0, 1.0, 1.0)], "b double, c double, l double, h double")
    assert [x[0] for x in bars.select(S.StopSpec(0.1, 0.1, "intraday").exit_price("b", "c", "l", "h")).collect()] == [9.0, 8.5, None, None]


def test_asof_join_directions_and_boundaries(spark):
    left = frame(spark, [("a", d(0)), ("a", d(5)), ("a", d(9)), ("b", d(5))], "k string, t date")
    right = frame(spark, [("a", d(1), 1), ("a", d(5), 2)], "k string, u date, v int")
    back = {(r.k, r.t): r.v for r in J.asof_join(left, right, ["k"], "t", "u").collect()}
    assert back == {("a", d(0)): None, ("a", d(5)): 2, ("a", d(9)): 2, ("b", d(5)): None}
    strict = {(r.k, r.t): r.v for r in J.asof_join(left, right, ["k"], "t", "u", strict=True).collect()}
    assert strict[("a", d(5))] == 1
    fwd = {(r.k, r.t): r.v for r in J.asof_join(left, right, ["k"], "t", "u", "forward", True).collect()}
    assert fwd == {("a", d(0)): 1, ("a", d(5)): None, ("a", d(9)): None, ("b", d(5)): None}


def test_membership_before_between_and_after(spark):
    m = frame(spark, [(d(30), "a"), (d(30), "b"), (d(60), "c")], "snap_date date, code string")
    days = frame(spark, [(d(0),), (d(30),), (d(59),), (d(60),), (d(99),)], "date date")
    got = {}
    for r in J.membership_asof(days, m).collect():
        got.setdefault(r.date, set()).add(r.code)
    assert got == {d(30): {"a", "b"}, d(59): {"a", "b"}, d(60): {"c"}, d(99): {"c"}}


def walk(n, seed):
    rng, x = random.Random(seed), 100.0
    out = []
    for _ in range(n):
        x *= 1 + rng.uniform(-0.06, 0.06)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drawdown_episodes_match_the_recursion(spark, seed):
    xs = walk(300, seed)
    want, open_ = [], False
    for i, x in enumerate(xs):
        peak = max(xs[max(0, i - 49) : i + 1])
        if not open_ and x <= 0.8 * peak:
            want.append(i)
            open_ = True
        elif open_ and x >= 0.95 * peak:
            open_ = False
    df = frame(spark, [("s", i, x) for i, x in enumerate(xs)], "series_id string, pos int, close double")
    assert sorted(r.pos for r in W.drawdown_episodes(df, "close", 0.2, 50).collect()) == want


def test_fractional_target_matches_the_recursion(spark):
    rng = random.Random(4)
    rows, t = [], 1.0
    for i in range(120):
        if rng.random() < 0.1:
            t = rng.choice([0.0, 0.3, 1.0])
        rows.append(("c", i, t, rng.uniform(-0.1, 0.1)))
    f, want = rows[0][2], {0: (0.0, 0.0)}
    for (_, i, tgt, r), (_, _, prev, _) in zip(rows[1:], rows[:-1], strict=True):
        gross = f * r
        pre = f * (1 + r) / (1 + gross)
        traded = tgt - pre if tgt != prev else 0.0
        want[i] = (gross, gross - (traded * 0.001 if traded > 0 else -traded * 0.002))
        f = tgt if tgt != prev else pre
    df = frame(spark, rows, "code string, pos int, target double, ret double")
    for r in B.fractional_target(df, rates=(0.001, 0.002)).collect():
        assert abs(r.gross - want[r.pos][0]) < 1e-12 and abs(r.net - want[r.pos][1]) < 1e-12


def test_weight_cap_matches_the_fixed_point(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for day in range(20):
        w = [rng.random() ** 3 for _ in range(rng.randint(2, 12))]
        w = [x / sum(w) for x in w]
        rows += [(d(day), f"c{i:02d}", x) for i, x in enumerate(w)]
        if len(w) * 0.25 >= 1:
            capped = set()
            while True:
                free = [i for i in range(len(w)) if i not in capped]
                scale = (1 - 0.25 * len(capped)) / sum(w[i] for i in free) if free else 0
                over = {i for i in free if w[i] * scale > 0.25 + 1e-12}
                if not over:
                    break
                capped |= over
            w = [0.25 if i in capped else x * scale for i, x in enumerate(w)]
        want |= {(d(day), f"c{i:02d}"): x for i, x in enumerate(w)}
    for r in X.weight_cap(frame(spark, rows, "date date, code string, w double")).collect():
        assert abs(r.w - want[r.date, r.code]) < 1e-9


def test_blend_skips_missing_and_rank_ties(spark):
    df = frame(spark, [(d(0), "a", 1.0, None), (d(0), "b", 1.0, 3.0), (d(0), "c", None, None)], "date date, code string, x double, y double")
    assert [r[0] for r in df.orderBy("code").select(X.blend(["x", "y"], [1.0, 1.0])).collect()] == [1.0, 2.0, None]
    assert [r[1] for r in df.select("code", X.average_rank("x").alias("r")).orderBy("code").collect()] == [1.5, 1.5, None]
    with pytest.raises(ValueError):
        X.blend(["x"], [1.0, 2.0])


def test_distributions_against_tables(spark):
    r = spark.range(1).select(
        dist.t_cdf(F.lit(2.228), F.lit(10)), dist.t_cdf(F.lit(12.706), F.lit(1)), dist.normal_cdf(F.lit(1.96)), dist.t_quantile(0.975, F.lit(10)), dist.binomial_two_sided(F.lit(8), F.lit(10)),
    ).first()
    for got, want in zip(r, (0.975, 0.975, 0.975, 2.2281, 0.109375), strict=True):
        assert abs(got - want) < 1e-4


def test_no_dispersion_gives_null(spark):
    df = frame(spark, [(0.01,), (0.01,), (0.01,)], "r double")
    assert df.agg(A.t_of("r"), A.sharpe_of("r")).first() == (None, None)


def test_reliability_and_losses(spark):
    df = frame(spark, [([0.9, 0.1], 0), ([0.2, 0.8], 0), ([0.5, 0.5], 1)], "p array<double>, y int")
    r = df.agg(A.brier()).first()[0]
    assert abs(r - (0.02 + 1.28 + 0.5) / 3) < 1e-12
    assert A.reliability(df, 2).agg(F.sum("n")).first()[0] == 3


def test_incremental_merge_modes(spark):
    old = frame(spark, [("a", d(0), 1.0), ("a", d(1), 2.0), ("b", d(0), 5.0), ("b", d(1), 5.0), ("c", d(3), 1.0)], "code string, date date, close double")
    new = frame(spark, [("a", d(1), 2.0), ("a", d(2), 3.0), ("b", d(1), 4.0), ("b", d(2), 4.5), ("c", d(2), 9.0), ("n", d(2), 7.0)], "code string, date date, close double")
    bars, modes = I.incremental_bars_merge(old, new)
    assert {r.code: (r.mode, r.rows) for r in modes.collect()} == {"a": ("append", 1), "b": ("rebase", 2), "c": ("skip", 0), "n": ("new", 1)}
    assert sorted((r.code, r.date, r.close) for r in bars.collect()) == [("a", d(0), 1.0), ("a", d(1), 2.0), ("a", d(2), 3.0), ("b", d(1), 4.0), ("b", d(2), 4.5), ("c", d(3), 1.0), ("n", d(2), 7.0)]


def test_event_cars_run_off_the_data(spark):
    panel = frame(spark, [("a", i, 0.01 if i != 3 else None) for i in range(1, 8)], "code string, pos int, abn double")
    ev = frame(spark, [("a", 2)], "code string, entry_pos int")
    got = {r.horizon: (None if r.car is None else round(r.car, 6), r.n_days) for r in E.event_cars(ev, panel, [2, 5, 6], 0.001).collect()}
    assert got == {2: (0.009, 1), 5: (0.039, 4), 6: (None, None)}


def test_cost_basis_fold(spark):
    fills = frame(spark, [("x", "a", d(0), 1, 100, 10.0), ("x", "a", d(1), 2, 100, 20.0), ("x", "a", d(2), 3, -50, 30.0), ("x", "b", d(0), 4, 10, 1.0), ("x", "b", d(1), 5, -10, 2.0), ("x", "b", d(2), 6, 5, 3.0)], "account string, code string, date date, fill_id int, shares int, price double")
    assert {(r.code): (r.shares, r.basis) for r in B.cost_basis(fills).collect()} == {"a": (150.0, 15.0), "b": (5.0, 3.0)}


def test_streaming_flags_match_batch(spark, tmp_path):
    from panelspark.streaming import streams

    rows = [("a", d(i), f) for i, f in enumerate([0, 1, 1, None, 1, 0, 1])]
    for k, part in enumerate((rows[:3], rows[3:])):
        frame(spark, part, "code string, date date, flag int").write.parquet(str(tmp_path / f"in/{k}"))
    s = spark.readStream.schema("code string, date date, flag int").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    q = streams.fresh_flags(s, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.date for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [d(1), d(4), d(6)]
