"""Operators across the securities of a date, and set operations between memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.order import exact_quantiles

BY = ("date",)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def winsorize(df: DataFrame, value: str, lower: float = 0.01, upper: float = 0.99, by=BY) -> DataFrame:
    """Clip to each date's interpolated quantiles; NULL stays NULL. The quantiles are aggregated and joined back, so no date is one window."""
    cuts = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(lower), F.lit(upper))).alias("__q"))
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(value, F.col("__q")[0]), F.col("__q")[1]))
    return df.join(cuts, list(by), "left").withColumn(value, clipped).drop("__q")


def zscore(value, by=BY) -> Column:
    """NULL where the values differ by no more than rounding: a deviation of at most 1e-9 of their mean."""
    w = Window.partitionBy(*by)
    mean, sd = F.avg(_c(value)).over(w), F.stddev_samp(_c(value)).over(w)
    return F.when(sd > 1e-9 * F.abs(mean), (_c(value) - mean) / sd)


def standardize(df: DataFrame, value: str, out: str, lower: float = 0.01, upper: float = 0.99, by=BY) -> DataFrame:
    return winsorize(df.withColumn(out, F.col(value)), out, lower, upper, by).withColumn(out, zscore(out, by))


def blend(columns: list[str], weights: list[float] | None = None) -> Column:
    """Weighted mean of the scores that are there; NULL if none is."""
    weights = weights or [1.0] * len(columns)
    if len(weights) != len(columns):
        raise ValueError("as many weights as columns")
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    present = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))
    return F.when(present > 0, total / present)


def place(value, descending: bool = True, by=BY, tie: str = "code") -> Column:
    """1-based place among the values that are there; ties in order of `tie`."""
    v = _c(value)
    w = Window.partitionBy(*by, v.isNull()).orderBy(v.desc() if descending else v.asc(), tie)
    return F.when(v.isNotNull(), F.row_number().over(w))


def average_rank(value, by=BY) -> Column:
    """Rank from 1, ties sharing the mean of theirs; among the values that are there."""
    v = _c(value)
    p = Window.partitionBy(*by, v.isNull())
    return F.when(v.isNotNull(), F.rank().over(p.orderBy(v)) + (F.count("*").over(Window.partitionBy(*by, v)) - 1) / 2)


def rank_pct(value, by=BY) -> Column:
    return average_rank(value, by) / F.count(_c(value)).over(Window.partitionBy(*by))


def rank_ic(df: DataFrame, factor: str, fwd: str, by=BY, least: int = 5) -> DataFrame:
    """(by, ic, n): rank correlation of factor and forward return where both are there, to nine digits, so that none is told from nought by rounding; a group where one of them is the same for all has none."""
    both = df.where(F.col(factor).isNotNull() & F.col(fwd).isNotNull()).withColumn("__f", average_rank(factor, by)).withColumn("__r", average_rank(fwd, by))
    w = Window.partitionBy(*by)
    both = both.withColumn("__differ", (F.min("__f").over(w) < F.max("__f").over(w)) & (F.min("__r").over(w) < F.max("__r").over(w))).where("__differ")
    agg = both.groupBy(*by).agg(F.round(F.corr("__f", "__r"), 9).alias("ic"), F.count("*").alias("n"))
    return agg.where((F.col("n") >= least) & F.col("ic").isNotNull() & ~F.isnan("ic"))


def ic_summary(ic: DataFrame, by=()) -> DataFrame:
    g = ic.groupBy(*by).agg(F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"), F.count("*").alias("n"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"))
    return g.withColumn("ir", F.when(F.col("sd") > 1e-12, F.col("mean_ic") / F.col("sd"))).withColumn("t", F.col("ir") * F.sqrt("n"))


def quantile_bin(value, bins: int, by=BY, tie: str = "code") -> Column:
    """Bin 0.. by first-rank, edges right-closed; the fuller bins are the lower ones at even spacing."""
    r, n = place(value, False, by, tie) - 1, F.count(_c(value)).over(Window.partitionBy(*by))
    return F.when(n >= bins, F.greatest(F.lit(0), F.ceil(r * bins / F.greatest(n - 1, F.lit(1))) - 1)).cast("int")


def quantile_returns(df: DataFrame, factor: str, fwd: str, bins: int = 5, by=BY) -> DataFrame:
    """(bin, mean_ret, n_dates): mean forward return of a bin on each date, then over dates."""
    both = df.where(F.col(factor).isNotNull() & F.col(fwd).isNotNull()).withColumn("bin", quantile_bin(factor, bins, by))
    daily = both.where("bin is not null").groupBy(*by, "bin").agg(F.avg(fwd).alias("r"))
    return daily.groupBy("bin").agg(F.avg("r").alias("mean_ret"), F.count("*").alias("n_dates"))


def selection_excess(df: DataFrame, score: str, fwd: str, n: int, bins: int = 5, by=BY) -> DataFrame:
    """(by, top, universe, excess, spread) of the n best by score; dates with too few names are left out."""
    both = df.where(F.col(score).isNotNull() & F.col(fwd).isNotNull()).withColumn("__p", place(score, True, by)).withColumn("__b", quantile_bin(score, bins, by))
    g = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("__p") <= n, F.col(fwd))).alias("top"), F.avg(fwd).alias("universe"),
        (F.avg(F.when(F.col("__b") == bins - 1, F.col(fwd))) - F.avg(F.when(F.col("__b") == 0, F.col(fwd)))).alias("spread"),
    )
    return g.where(F.col("n") >= max(n, bins)).select(*by, "top", "universe", (F.col("top") - F.col("universe")).alias("excess"), "spread")


def pooled_terciles(df: DataFrame, value: str, out: str = "tercile") -> DataFrame:
    """Thirds of the pooled sample, edges right-closed. The edges are found at once, see exact_quantiles."""
    lo, hi = exact_quantiles(df, value, [1 / 3, 2 / 3])
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.when(F.col(value) <= F.lit(lo), 0).when(F.col(value) <= F.lit(hi), 1).otherwise(2)))


def sector_demean(value, sector, by=BY) -> Column:
    v, s = _c(value), _c(sector)
    return F.when(s.isNull(), v).otherwise(v - F.avg(v).over(Window.partitionBy(*by, s)))


def sector_cap(value, sector, k: int, by=BY) -> Column:
    """The value of the k best of each sector; those without a label are one sector."""
    return F.when(place(value, True, (*by, F.coalesce(_c(sector), F.lit("<none>")))) <= k, _c(value))


def cross_demean(value, by=BY) -> Column:
    return _c(value) - F.avg(_c(value)).over(Window.partitionBy(*by))


def inverse_vol_weights(df: DataFrame, sigma: str = "sigma", floor: float = 1e-4, by=BY) -> DataFrame:
    """Adds w: 1/sigma, normalised; a missing or tiny sigma takes the basket's median, and without any all are equal."""
    ok = F.when(F.col(sigma) >= floor, F.col(sigma))
    med = df.groupBy(*by).agg(F.percentile(ok, F.lit(0.5)).alias("__m"))
    d = df.join(med, list(by), "left").withColumn("__i", F.coalesce(1 / F.coalesce(ok, F.col("__m")), F.lit(1.0)))
    return d.withColumn("w", F.col("__i") / F.sum("__i").over(Window.partitionBy(*by))).drop("__i", "__m")


def weight_cap(df: DataFrame, weight: str = "w", cap: float = 0.25, by=BY, tie: str = "code") -> DataFrame:
    """Cap weights and spill what is cut pro rata until none is over it: the first k in order are capped, k the least that leaves the next one under."""
    o = Window.partitionBy(*by).orderBy(F.desc(weight), tie)
    p = Window.partitionBy(*by)
    d = df.withColumn("__k", F.row_number().over(o) - 1).withColumn("__n", F.count("*").over(p))
    d = d.withColumn("__s", F.sum(weight).over(o.rowsBetween(0, Window.unboundedFollowing)))
    d = d.withColumn("__big", F.min(F.when(F.col(weight) * (1 - F.col("__k") * cap) / F.col("__s") <= cap + 1e-12, F.col("__k"))).over(p))
    rest = F.max(F.when(F.col("__k") == F.col("__big"), F.col("__s"))).over(p)
    capped = F.when(F.col("__k") < F.col("__big"), cap).otherwise(F.col(weight) * (1 - F.col("__big") * cap) / rest)
    return d.withColumn(weight, F.when(F.col("__n") * cap < 1, F.col(weight)).otherwise(capped)).drop("__k", "__n", "__s", "__big")


def basket_weights(raw=None, by=BY) -> Column:
    """Equal weights, or the given ones without negatives, normalised; equal again if nothing is left."""
    p = Window.partitionBy(*by)
    equal = 1 / F.count("*").over(p)
    if raw is None:
        return equal
    pos = F.greatest(F.coalesce(_c(raw), F.lit(0.0)), F.lit(0.0))
    return F.when(F.sum(pos).over(p) > 0, pos / F.sum(pos).over(p)).otherwise(equal)


def hysteresis_band(df: DataFrame, score: str, n: int, band: int, order: str = "date") -> DataFrame:
    """Adds held: in at rank n, out below rank n + band. Per name, so the number held may exceed n; band 0 is the plain top n. See hysteresis_book for a book of n names."""
    d = df.withColumn("rank", place(score))
    w = Window.partitionBy("code").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sig = F.when(F.coalesce(F.col("rank") > n + band, F.lit(True)), 0).when(F.col("rank") <= n, 1)
    return d.withColumn("held", F.coalesce(F.last(sig, True).over(w), F.lit(0)) == 1)


def hysteresis_book(df: DataFrame, score: str, n: int | str, band: int | str, by: tuple[str, ...] = (), order: str = "date") -> DataFrame:
    """(by, order, code) of a book of at most n names: those held stay while their rank is n + band or better, best first; places left go to names of rank n or better.

    What is held decides what is held next, so the dates of a book are folded in order: an array of at most n + band names each, one row for a
    book. n and band may be columns among `by`, so a sweep is one job.
    """
    size, slack = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (n, band))
    d = df.withColumn("__r", place(score, True, (*by, order)))
    near = F.array_sort(F.collect_list(F.when(F.col("__r") <= size + slack, F.struct("__r", "code"))))
    # grouped by date first: a fold then has an array a date, whatever the number of names
    dates = d.groupBy(*by, order).agg(F.transform(near, lambda x: x["code"]).alias("__near"))
    row = F.struct(F.col(order).alias("at"), F.col("__near").alias("near"), size.cast("int").alias("n"))
    folds = dates.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("__days"))
    day = f"array<struct<at:{df.schema[order].dataType.simpleString()},held:array<string>>>"
    state = lambda held, out: F.struct(held.alias("held"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        stay = F.slice(F.filter(x["near"], lambda c: F.array_contains(s["held"], c)), F.lit(1), x["n"])
        fresh = F.filter(F.slice(x["near"], F.lit(1), x["n"]), lambda c: ~F.array_contains(stay, c))
        held = F.slice(F.concat(stay, fresh), F.lit(1), x["n"])
        return state(held, F.concat(s["out"], F.array(F.struct(x["at"].alias("at"), held.alias("held")))))

    none = state(F.array().cast("array<string>"), F.array().cast(day))
    out = folds.select(*by, F.explode(F.aggregate("__days", none, step, lambda s: s["out"])).alias("x"))
    return out.select(*by, F.col("x.at").alias(order), F.explode("x.held").alias("code"))


def argmax_asset(df: DataFrame, value: str, asset: str = "code", by=BY) -> DataFrame:
    """(by, pick): the asset with the largest value; the lowest name among equals; none where all are NULL."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(asset).alias("a")))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("__b")).select(*by, F.col("__b.a").alias("pick"))


def snapshot_changes(membership: DataFrame) -> DataFrame:
    """(snap_date, code, change): adds and deletes between neighbouring snapshots; the first has none."""
    snaps = membership.select("snap_date").distinct()
    k = snaps.select("snap_date", F.lead("snap_date").over(Window.orderBy("snap_date")).alias("next"), F.lag("snap_date").over(Window.orderBy("snap_date")).alias("prev"))
    m = membership.join(F.broadcast(k), "snap_date")  # one row a snapshot
    adds = m.where("prev is not null").select("snap_date", "prev", "code").join(membership.select(F.col("snap_date").alias("prev"), "code"), ["prev", "code"], "left_anti").select("snap_date", "code", F.lit("add").alias("change"))
    dels = m.where("next is not null").select(F.col("next").alias("snap_date"), "code").join(membership, ["snap_date", "code"], "left_anti").select("snap_date", "code", F.lit("delete").alias("change"))
    return adds.unionByName(dels)
