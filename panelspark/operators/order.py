"""Order statistics that need no sort of a whole group: exact quantiles of a table, and of sliding windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram: what one pass sends back for each range that is still open.
BINS = 1024


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float]) -> list[float | None]:
    """Interpolated quantiles of all finite values, exact. NULL for an empty table.

    A pass counts the values of each open range in BINS bins; the bin that holds a wanted rank is the range of the next pass, from its least to
    its largest value. A range of one value is settled, so a few passes do, ties or not, and no task ever holds the distinct values.
    """
    v = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('inf')")
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probs)
    at = [p * (n - 1) for p in probs]
    ranks = sorted({k for x in at for k in (floor(x), ceil(x))})
    found: dict[int, float] = {}
    spans = [(lo, hi, 0, ranks)]
    while spans:
        found |= {k: a for a, b, _, ks in spans if a == b for k in ks}
        spans = [s for s in spans if s[0] < s[1]]
        if not spans:
            break
        span, part = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b, _, _) in enumerate(spans):
            inside = F.col("v").between(F.lit(a), F.lit(b))
            span = F.when(inside, i).otherwise(span)
            # halves, so that the width of a range doesn't pass the largest double
            part = F.when(inside, F.least(F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS), F.lit(BINS - 1)).cast("int")).otherwise(part)
        bins = v.select("v", span.alias("s"), part.alias("b")).where("s is not null").groupBy("s", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        narrower = []
        for i, (_, _, below, ks) in enumerate(spans):
            for r in sorted((r for r in bins if r.s == i), key=lambda r: r.b):
                if own := [k for k in ks if below <= k < below + r.n]:
                    narrower.append((r.lo, r.hi, below, own))
                below += r.n
        spans = narrower
    return [found[floor(x)] * (ceil(x) - x) + found[ceil(x)] * (x - floor(x)) if floor(x) != ceil(x) else found[floor(x)] for x in at]


def sliding_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float, int, int]], keys: tuple[str, ...] = ("code",), order: str = "pos") -> DataFrame:
    """Adds columns: out -> (value, q, window, least) is the interpolated quantile of the values in the last `window` rows, NULL below `least` of them.

    A key's history is one Arrow group. Its window is a sorted list that a row enters and leaves by bisection, so a row costs about the same
    whatever the window; outs that share value and window share the list. NULL and NaN are no values.
    """
    lists: dict[tuple[str, int], list[tuple[str, float, int]]] = {}
    for out, (value, q, window, least) in wanted.items():
        lists.setdefault((value, window), []).append((out, q, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by(order)
        for (value, window), outs in lists.items():
            x = t.column(value).to_numpy().astype(float)
            given = ~np.isnan(x)
            held, queue = [], deque()
            got = {out: np.full(len(x), np.nan) for out, _, _ in outs}
            for i, (v, ok) in enumerate(zip(x.tolist(), given.tolist(), strict=True)):
                if queue and queue[0][0] <= i - window:
                    del held[bisect_left(held, queue.popleft()[1])]
                if ok:
                    insort(held, v)
                    queue.append((i, v))
                for out, q, least in outs:
                    if len(held) >= max(least, 1):
                        at = q * (len(held) - 1)
                        lo, hi = floor(at), ceil(at)
                        got[out][i] = held[lo] if lo == hi else (hi - at) * held[lo] + (at - lo) * held[hi]
            for out, _, _ in outs:
                t = t.append_column(out, pa.array(got[out], mask=np.isnan(got[out])))
        yield from t.select([*names, *wanted]).to_batches()

    names = df.columns
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{out}` double" for out in wanted)])
    return df.groupBy(*keys).applyInArrow(run, kinds)


def correlations(df: DataFrame, value: str, row: str = "date", column: str = "code", block: int = 64, chunk: int = 256) -> DataFrame:
    """(x, y, n, c) for each pair of columns x < y with two rows or more in common: how many, and the correlation there.

    A block of columns in a chunk of rows is a small matrix. Two blocks meet in the chunks of both, one after the other, and add up products and, for the
    gaps, counts, sums and squares of what the other one has: nothing is as large as pairs times rows. Blocks and chunks go by hash.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(row).cast("string").alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v"))
    rows, columns = d.agg(F.approx_count_distinct("r"), F.approx_count_distinct("c")).first()
    centre = d.groupBy("c").agg(F.avg("v").alias("m"))  # correlations don't change, and sums stay small
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    d = d.join(centre, "c").select(part("c", -(-columns // block) or 1).alias("b"), part("r", -(-rows // chunk) or 1).alias("ch"), "r", "c", (F.col("v") - F.col("m")).alias("v"))

    def pack(t: pa.Table) -> pa.Table:
        names, j = np.unique(t.column("c").to_numpy(), return_inverse=True)
        places, i = np.unique(t.column("r").to_numpy(), return_inverse=True)
        m = np.full((len(places), len(names)), np.nan)
        m[i, j] = t.column("v").to_numpy()
        return pa.table({"b": t.column("b").slice(0, 1), "ch": t.column("ch").slice(0, 1), "rs": pa.array([places.tolist()], pa.list_(pa.string())), "cs": pa.array([names.tolist()], pa.list_(pa.string())), "m": pa.array([m.tobytes()], pa.binary())})

    packed = d.groupBy("b", "ch").applyInArrow(pack, "b int, ch int, rs array<string>, cs array<string>, m binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs: dict[str, int] = {}
        ys: dict[str, int] = {}
        sums = np.zeros((6, 0, 0))
        same = False
        for batch in batches:
            for r in batch.to_pylist():
                same = r["bx"] == r["by"]
                _, a, b = np.intersect1d(r["rx"], r["ry"], assume_unique=True, return_indices=True)
                x = np.frombuffer(r["mx"]).reshape(-1, len(r["cx"]))[a]
                y = np.frombuffer(r["my"]).reshape(-1, len(r["cy"]))[b]
                i, j = [xs.setdefault(c, len(xs)) for c in r["cx"]], [ys.setdefault(c, len(ys)) for c in r["cy"]]
                if sums.shape[1:] != (len(xs), len(ys)):
                    sums = np.pad(sums, ((0, 0), (0, len(xs) - sums.shape[1]), (0, len(ys) - sums.shape[2])))
                hx, hy = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
                x, y = np.nan_to_num(x), np.nan_to_num(y)
                sums[np.ix_(range(6), i, j)] += np.stack([hx.T @ hy, x.T @ hy, hx.T @ y, (x * x).T @ hy, hx.T @ (y * y), x.T @ y])
        n, sx, sy, xx, yy, xy = sums
        with np.errstate(all="ignore"):
            c = (xy - sx * sy / n) / np.sqrt((xx - sx * sx / n) * (yy - sy * sy / n))
        one, two = np.array(list(xs), object), np.array(list(ys), object)
        i, j = np.nonzero((n >= 2) & ((one[:, None] < two[None, :]) if same else np.ones(n.shape, bool)))
        x, y = one[i], two[j]
        swap = x > y
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(n[i, j].astype(np.int64)), pa.array(c[i, j], mask=~np.isfinite(c[i, j]))], ["x", "y", "n", "c"])

    left = packed.select("ch", F.col("b").alias("bx"), F.col("rs").alias("rx"), F.col("cs").alias("cx"), F.col("m").alias("mx"))
    right = packed.select("ch", F.col("b").alias("by"), F.col("rs").alias("ry"), F.col("cs").alias("cy"), F.col("m").alias("my"))
    return left.join(right, "ch").where("bx <= by").groupBy("bx", "by").applyInArrow(meet, "x string, y string, n long, c double")
