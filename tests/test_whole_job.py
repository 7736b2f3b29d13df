"""Queries do the whole of what their names say."""

import datetime
import random

from panelspark.operators import xsection as X
from panelspark.plans import ml
from panelspark.queries import live


def months(n):
    return [datetime.date(2000 + i // 12, i % 12 + 1, 28) for i in range(n)]


def test_walk_forward_takes_every_month_and_the_default_window(spark, monkeypatch):
    rows = [(d, f"c{k}", *(float((k * 7 + i * 3 + j * 5) % 11) for j in range(5)), float((7 * k + i) % 5)) for i, d in enumerate(months(40)) for k in range(10)]
    data = spark.createDataFrame(rows, "date date, code string, ep double, bp double, low_vol double, mom double, rev double, fwd double")
    asked = {}

    def caught(d, features, folds, *args, **kw):
        asked.update(folds=folds, features=features, args=args, kw=kw)
        return d.select("date", "code", "fwd", live.F.lit(0.0).alias("pred"))

    monkeypatch.setattr(live, "five_factors", lambda t: data)
    monkeypatch.setattr(ml, "walk_forward_predict", caught)
    live.m2(None)
    # the last dates learn from 36 months and 200 rows, the defaults
    assert asked == {"folds": months(40), "features": list(live.FACTORS), "args": (), "kw": {}}


def test_walk_forward_counts_the_rows_of_each_window(spark):
    rows = [(d, f"c{k}", float(k), float((7 * k + i) % 5)) for i, d in enumerate(months(6)) for k in range(4 if i < 3 else 8)]
    data = spark.createDataFrame(rows, "date date, code string, x double, fwd double")
    got = ml.walk_forward_predict(data, ["x"], months(6), min_train=2, window=2, least_rows=12, trees=1)
    # windows hold 8, 8, 12 and 16 rows
    assert {(r["date"], r["count"]) for r in got.groupBy("date").count().collect()} == {(months(6)[4], 8), (months(6)[5], 8)}


def boosted(train, test, trees, depth, rate, least, shrink, bins):
    """One fold, step by step. train, test: lists of (bins of features, target in whole parts)."""
    at = lambda b, tree: tree if not isinstance(tree, tuple) else at(b, tree[2] if b[tree[0]] > tree[1] else tree[1 + 2])
    p, q = [0] * len(train), [0] * len(test)

    def grow(rows, left):
        best = None
        if left:
            for f in range(len(train[0][0])):
                for b in range(bins):
                    lo = [i for i in rows if train[i][0][f] <= b]
                    hi = [i for i in rows if train[i][0][f] > b]
                    if b not in {train[i][0][f] for i in rows} or min(len(lo), len(hi)) < least:
                        continue
                    score = lambda own: (sum(train[i][1] - p[i] for i in own) / ml.PARTS) ** 2 / (len(own) + shrink)
                    gain = score(lo) + score(hi) - score(rows)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, lo, hi)
        if best is None:
            if left:  # passes on whole
                return grow(rows, left - 1)
            v = rate * sum(train[i][1] - p[i] for i in rows) / (len(rows) + shrink)
            return int(v + 0.5) if v >= 0 else -int(-v + 0.5)
        _, f, b, lo, hi = best
        return (f, b, grow(hi, left - 1), grow(lo, left - 1))

    for _ in range(trees):
        tree = grow(list(range(len(train))), depth)
        p = [x + at(b, tree) for x, (b, _) in zip(p, train, strict=True)]
        q = [x + at(b, tree) for x, (b, _) in zip(q, test, strict=True)]
    return q


def test_all_folds_at_once_equal_one_after_the_other(spark):
    rng = random.Random(1)
    at = months(8)
    rows = [(d, f"c{k}", rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([None, 0.5, -1.0])) for d in at for k in range(30)]
    rows = [(d, c, x, 9.0 if y > 1 else y, z or 0.0, round(0.05 * x - 0.03 * (y > 0) + rng.gauss(0, 0.05), 9)) for d, c, x, y, z in rows]
    data = spark.createDataFrame(rows, "date date, code string, x double, y double, z double, fwd double").repartition(5)
    named = dict(trees=3, depth=2, rate=0.3, least_leaf=8, shrink=1.0, bins=16)
    got = {(r.date, r.code): r.pred for r in ml.walk_forward_predict(data, ["x", "y", "z"], at, min_train=2, window=3, least_rows=50, **named).collect()}
    assert {d for d, _ in got} == set(at[2:])
    cut = lambda v: min(max(int((v + 3) * 16 / 6 // 1), 0), 15)
    for k in range(2, 8):
        part = lambda days: [([cut(x), cut(y), cut(z)], round(f * ml.PARTS)) for d, _, x, y, z, f in rows if d in days]
        want = boosted(part(at[max(0, k - 3) : k]), part([at[k]]), 3, 2, 0.3, 8, 1.0, 16)
        for (_, c, *_), w in zip([r for r in rows if r[0] == at[k]], want, strict=True):
            assert abs(got[at[k], c] - w / ml.PARTS) < 1e-8


def test_a_date_of_equal_predictions_has_no_rank_correlation(spark):
    rows = [(d, f"c{k}", 1.0 if d == 1 else float(k), float(k)) for d in (1, 2) for k in range(5)]
    got = X.rank_ic(spark.createDataFrame(rows, "date int, code string, pred double, fwd double"), "pred", "fwd").collect()
    assert [(r.date, r.n, round(r.ic, 9)) for r in got] == [(2, 5, 1.0)]
