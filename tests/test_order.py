"""Order statistics, sliding windows, correlations, books with memory and ledgers against plain Python."""

import collections
import datetime as dt
import random

import numpy as np
import pytest

from panelspark.operators import order as O
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import xsection as X


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed", "two", "one"])
def test_exact_quantiles(spark, monkeypatch, kind):
    monkeypatch.setattr(O, "BINS", 8)  # many passes
    rng = random.Random(kind)
    x = {"spread": [rng.gauss(0, 1) for _ in range(997)], "ties": [float(rng.randrange(3)) for _ in range(500)], "skewed": [rng.random() ** 40 * 10 ** rng.randrange(-12, 12) for _ in range(800)], "two": [1.0, 1.0 + 2**-52], "one": [5.0]}[kind]
    rows = [(v,) for v in x] + [(None,), (float("nan"),), (float("inf"),)]
    probs = [0.0, 0.01, 1 / 3, 0.5, 2 / 3, 0.99, 1.0]
    got = O.exact_quantiles(spark.createDataFrame(rows, "v double").repartition(5), "v", probs)
    assert got == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    assert O.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) == [None]


def test_sliding_quantiles(spark):
    rng = random.Random(4)
    rows = [(c, i, rng.choice([None, float("nan"), float(rng.randrange(5)), rng.random()])) for c in "ab" for i in range(150)]
    wanted = {"lo": ("v", 0.3, 20, 5), "mid": ("v", 0.5, 20, 1), "all": ("v", 0.9, 500, 60)}
    got = O.sliding_quantiles(spark.createDataFrame(rows, "code string, pos int, v double").repartition(4), wanted).collect()
    assert len(got) == 300
    x = {(c, i): v for c, i, v in rows}
    for r in got:
        for out, (_, q, window, least) in wanted.items():
            held = [v for i in range(max(0, r.pos - window + 1), r.pos + 1) if (v := x[r.code, i]) is not None and v == v]
            assert r[out] == (pytest.approx(np.quantile(held, q)) if len(held) >= least else None)


@pytest.mark.parametrize("block, chunk", [(64, 256), (3, 7)])
def test_correlations_with_gaps(spark, block, chunk):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 11)) + rng.normal(size=(60, 1)) + 100
    m[rng.random(m.shape) < 0.3] = np.nan
    m[:, 10] = np.where(np.arange(60) < 58, np.nan, 1.0)  # no spread
    rows = [(day(i), f"c{j:02}", None if np.isnan(m[i, j]) else float(m[i, j])) for i in range(60) for j in range(11)]
    got = {(r.x, r.y): r for r in O.correlations(spark.createDataFrame(rows, "date date, code string, v double").repartition(3), "v", block=block, chunk=chunk).collect()}
    for i in range(11):
        for j in range(i + 1, 11):
            ok = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            r = got.get((f"c{i:02}", f"c{j:02}"))
            assert (r is None) == (ok.sum() < 2)
            if r and j < 10:
                assert r.n == ok.sum() and r.c == pytest.approx(np.corrcoef(m[ok, i], m[ok, j])[0, 1])
            elif r:
                assert r.c is None


@pytest.mark.parametrize("n, band", [(3, 0), (3, 2), (2, 5)])
def test_a_hysteresis_book_follows_the_recursion(spark, n, band):
    rng = random.Random(n * 10 + band)
    rows = [(v, day(i), f"c{k}", None if i == 4 or rng.random() < 0.2 else float(rng.randrange(6))) for v in "xy" for i in range(25) for k in range(9)]
    got = collections.defaultdict(set)
    for r in X.hysteresis_book(spark.createDataFrame(rows, "v string, date date, code string, s double").repartition(4), "s", n, band, ("v",)).collect():
        got[r.v, r.date].add(r.code)
    for v in "xy":
        held = []
        for i in range(25):
            ranked = [c for _, c in sorted((-s, c) for w, d, c, s in rows if w == v and d == day(i) and s is not None)]
            stay = [c for c in ranked[: n + band] if c in held][:n]
            held = (stay + [c for c in ranked[:n] if c not in stay])[:n]
            assert got[v, day(i)] == set(held) and len(held) <= n


def test_a_sweep_of_bands_is_one_fold(spark):
    rng = random.Random(2)
    rows = [(day(i), f"c{k}", rng.random(), n, b) for i in range(9) for k in range(8) for n, b in ((2, 0), (2, 3), (4, 1))]
    df = spark.createDataFrame(rows, "date date, code string, s double, n int, band int")
    got = {tuple(r) for r in X.hysteresis_book(df, "s", "n", "band", ("n", "band")).collect()}
    for n, b in ((2, 0), (2, 3), (4, 1)):
        one = X.hysteresis_book(df.where(f"n = {n} and band = {b}").select("date", "code", "s"), "s", n, b)
        assert {(n, b, r.date, r.code) for r in one.collect()} == {x for x in got if x[:2] == (n, b)}


def test_ledger_and_equity_by_marks(spark):
    rng = random.Random(7)
    fills = [(rng.randrange(3), rng.choice("pqr"), day(rng.randrange(80)), i, rng.choice([-100, 100, 200]), 5.0 + rng.random(), 1.0) for i in range(60)]
    fills += [(0, "z", day(3), 900, 100, 4.0, 1.0), (0, "z", day(5), 901, -100, 6.0, 1.0)]
    marks = [(c, day(i), 5.0 + rng.random()) for c in "pqrz" for i in range(90) if rng.random() < 0.8 or c == "p"]
    f = spark.createDataFrame(fills, "account int, code string, date date, fill_id int, shares long, price double, fee double")
    m = spark.createDataFrame(marks, "code string, date date, close double")
    price = {(c, d): x for c, d, x in marks}
    got = B.ledger(f, m).collect()
    assert len(got) == 3 * 90
    other = {(r.account, r.date): r.equity for r in B.equity_by_marks(f, m).collect()}
    for r in got:
        own = [x for x in fills if x[0] == r.account and x[2] <= r.date]
        cash = 1e6 - sum(s * p + fee for *_, s, p, fee in own)
        value = sum(s * price.get((c, r.date), 0.0) for _, c, _, _, s, _, _ in own)
        assert (r.cash, r.value, r.equity) == pytest.approx((cash, value, cash + value))
        if (r.account, r.date) in other:
            assert other[r.account, r.date] == pytest.approx(r.equity)
    assert B.position_runs(f).where("account = 0 and code = 'z'").select("since", "until", "shares").collect() == [(day(3), day(5), 100)]


def test_terciles_and_winsorized_t_by_exact_edges(spark):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(300)]
    df = spark.createDataFrame([(day(i % 90), v) for i, v in enumerate(x)] + [(day(1), None)], "date date, v double")
    edges = np.quantile(x, [1 / 3, 2 / 3])
    got = collections.Counter(r.tercile for r in X.pooled_terciles(df, "v").collect())
    want = collections.Counter(int(v > edges[0]) + int(v > edges[1]) for v in x)
    assert got == want | {None: 1}
    lo, hi = np.quantile(x, [0.05, 0.95])
    by = collections.defaultdict(list)
    for i, v in enumerate(x):
        by[day(i % 90).month].append(min(max(v, lo), hi))
    m = [np.mean(v) for v in by.values()]
    r = A.winsorized_clustered_t(df, "v", 0.05, 0.95).first()
    assert r["mean"] == pytest.approx(np.mean(m)) and r["t"] == pytest.approx(np.mean(m) / (np.std(m, ddof=1) / np.sqrt(len(m))))
