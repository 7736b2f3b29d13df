"""Statistics of returns, events and forecasts. No dispersion (below 1e-12) and too few values give NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import dist
from panelspark.operators.order import exact_quantiles

TINY = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def t_of(x) -> Column:
    """Aggregate: mean over its standard error."""
    sd, n = F.stddev_samp(_c(x)), F.count(_c(x))
    return F.when((n >= 2) & (sd >= TINY), F.avg(_c(x)) / (sd / F.sqrt(n)))


def sharpe_of(x, year: int = 252) -> Column:
    sd = F.stddev_samp(_c(x))
    return F.when((F.count(_c(x)) >= 2) & (sd >= TINY), F.avg(_c(x)) / sd * F.sqrt(F.lit(float(year))))


def clustered_t(df: DataFrame, value: str, date: str = "date", freq: str = "month", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n_periods, mean, t): means of calendar periods first, then t across them."""
    p = df.where(F.col(value).isNotNull()).groupBy(*by, F.date_trunc(freq, date).alias("__p")).agg(F.avg(value).alias("m"))
    return p.groupBy(*by).agg(F.count("*").alias("n_periods"), F.avg("m").alias("mean"), t_of("m").alias("t"))


def max_drawdown(df: DataFrame, equity: str = "equity", by: tuple[str, ...] = ("series_id",), order: str = "date") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__d", F.col(equity) / F.max(equity).over(w) - 1).groupBy(*by).agg(F.min("__d").alias("max_drawdown"))


def cagr_of(value="equity", date="date", year: float = 365.25) -> Column:
    years = F.greatest(F.date_diff(F.max(date), F.min(date)) / year, F.lit(1e-9))
    return F.pow(F.max_by(value, date) / F.min_by(value, date), 1 / years) - 1


def perf_summary(df: DataFrame, ret: str, by: tuple[str, ...] = ("series_id",), date: str = "date") -> DataFrame:
    """(by, wealth, cagr, max_drawdown, calmar, sharpe, ann_mean, ann_vol) of daily returns."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__r", F.coalesce(ret, F.lit(0.0))).withColumn("__e", F.product(1 + F.col("__r")).over(w))
    d = d.withColumn("__d", F.col("__e") / F.greatest(F.max("__e").over(w), F.lit(1.0)) - 1)
    years = F.greatest(F.date_diff(F.max(date), F.min(date)) / 365.25, F.lit(1e-9))
    g = d.groupBy(*by).agg(F.max_by("__e", date).alias("wealth"), F.min("__d").alias("max_drawdown"), years.alias("__y"), sharpe_of("__r").alias("sharpe"), (F.avg("__r") * 252).alias("ann_mean"), (F.stddev_samp("__r") * F.sqrt(F.lit(252.0))).alias("ann_vol"))
    g = g.withColumn("cagr", F.when(F.col("wealth") > 0, F.pow("wealth", 1 / F.col("__y")) - 1)).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown")))
    return g.drop("__y")


def carry_in_slice(df: DataFrame, windows: DataFrame, equity: str = "equity", order: str = "date") -> DataFrame:
    """(label, max_drawdown, growth) in each window, drawdowns against the high-water mark of all that went before. windows: (label, lo, hi), a few rows."""
    w = Window.partitionBy("series_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__d", F.col(equity) / F.max(equity).over(w) - 1)
    s = d.join(F.broadcast(windows), F.col(order).between(F.col("lo"), F.col("hi")))
    return s.groupBy("series_id", "label").agg(F.min("__d").alias("max_drawdown"), (F.max_by(equity, order) / F.min_by(equity, order) - 1).alias("growth"))


def beta_r2(df: DataFrame, y: str, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def window_inference(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """(by, n, mean, ann, t, p, lo, hi, hit): mean with its 95% interval and two-sided p."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), t_of(value).alias("t"), F.avg((F.col(value) > 0).cast("double")).alias("hit"))
    half = dist.t_quantile(0.975, F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return g.select(*by, "n", "mean", (F.col("mean") * 12).alias("ann"), "t", dist.t_two_sided(F.col("t"), F.col("n") - 1).alias("p"), (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "hit")


def p_this_weak(win_mean: Column, full_mean: Column, sigma: Column, n: Column) -> Column:
    return dist.normal_cdf((win_mean - full_mean) / (sigma / F.sqrt(n)))


def welch(df: DataFrame, value: str, group: Column) -> DataFrame:
    """(t, df, p) of two samples with unequal variances; group is true for the first."""
    v = lambda c: F.when(c, F.col(value))
    a, b = v(group), v(~group)
    g = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.var_samp(a) / F.count(a)).alias("va"), (F.var_samp(b) / F.count(b)).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"))
    t = (F.col("ma") - F.col("mb")) / F.sqrt(F.col("va") + F.col("vb"))
    dof = F.pow(F.col("va") + F.col("vb"), 2) / (F.pow("va", 2) / (F.col("na") - 1) + F.pow("vb", 2) / (F.col("nb") - 1))
    return g.select(t.alias("t"), dof.alias("df")).withColumn("p", dist.t_two_sided(F.col("t"), F.col("df")))


def boundaries(df: DataFrame, value: str, by: tuple[str, ...], order: str = "date", least: int = 6) -> DataFrame:
    """(by, order, n_early, n_late, late, t_late, welch) at each row that can split a series: the part from it on by itself, and against the part before.

    Both parts come from running counts, sums and squares, so all splits cost one pass. `least` rows on either side.
    """
    w = Window.partitionBy(*by)
    before = w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(value)
    d = df.where(x.isNotNull()).select(*by, order, F.count("*").over(before).alias("n1"), F.sum(x).over(before).alias("s1"), F.sum(x * x).over(before).alias("q1"), F.count("*").over(w).alias("n"), F.sum(x).over(w).alias("s"), F.sum(x * x).over(w).alias("q"))
    d = d.withColumns({"n2": F.col("n") - F.col("n1"), "s2": F.col("s") - F.col("s1"), "q2": F.col("q") - F.col("q1")}).where(f"n1 >= {least} and n2 >= {least}")
    mean = lambda k: F.col(f"s{k}") / F.col(f"n{k}")
    error = lambda k: (F.col(f"q{k}") - F.col(f"n{k}") * mean(k) * mean(k)) / (F.col(f"n{k}") - 1) / F.col(f"n{k}")
    ratio = lambda a, e: F.when(e >= TINY * TINY, a / F.sqrt(e))
    return d.select(*by, order, F.col("n1").alias("n_early"), F.col("n2").alias("n_late"), mean(2).alias("late"), ratio(mean(2), error(2)).alias("t_late"), ratio(mean(1) - mean(2), error(1) + error(2)).alias("welch"))


def in_windows(df: DataFrame, value: str, windows: DataFrame, by: tuple[str, ...], order: str = "date") -> DataFrame:
    """(by, label, n, mean, t, hit) of a value in each window (label, lo, hi), a few rows that may overlap."""
    d = df.where(F.col(value).isNotNull()).join(F.broadcast(windows), F.col(order).between(F.col("lo"), F.col("hi")))
    return d.groupBy(*by, "label").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), t_of(value).alias("t"), F.avg((F.col(value) > 0).cast("double")).alias("hit"))


def sign_test(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    g = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).groupBy(*by).agg(F.count_if(F.col(value) > 0).alias("wins"), F.count("*").alias("n"))
    return g.withColumn("p", dist.binomial_two_sided(F.col("wins"), F.col("n")))


def winsorized_clustered_t(df: DataFrame, value: str, lo: float = 0.01, hi: float = 0.99, date: str = "date") -> DataFrame:
    """clustered_t of values cut to their pooled quantiles, which are found at once, see exact_quantiles."""
    low, high = exact_quantiles(df, value, [lo, hi])
    d = df.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))))
    return clustered_t(d, value, date)


def event_summary(df: DataFrame, value: str, by: tuple[str, ...], date: str = "date") -> DataFrame:
    """(by, n, mean, median, t_event, share, t_month)."""
    ok = df.where(F.col(value).isNotNull())
    g = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"), t_of(value).alias("t_event"), F.avg((F.col(value) > 0).cast("double")).alias("share"))
    return g.join(clustered_t(ok, value, date, by=by).select(*by, F.col("t").alias("t_month")), list(by))


def log_loss(p: str = "p", y: str = "y") -> Column:
    return -F.avg(F.log(F.least(F.greatest(F.element_at(p, F.col(y) + 1), F.lit(1e-15)), F.lit(1.0))))


def brier(p: str = "p", y: str = "y") -> Column:
    return F.avg(F.aggregate(F.transform(p, lambda v, i: F.pow(v - (i == F.col(y)).cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def reliability(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(bin, n, pred, emp): equal bins from the least confidence to 1, the last one closed."""
    d = df.select(F.array_max(p).alias("conf"), (F.array_position(p, F.array_max(p)) - 1 == F.col(y)).cast("double").alias("hit"))
    lo = d.agg(F.min("conf").alias("__lo"))
    width = (1 - F.col("__lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("conf") - F.col("__lo")) / width), F.lit(bins - 1))).otherwise(0)
    return d.crossJoin(F.broadcast(lo)).withColumn("bin", b.cast("int")).groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("pred"), F.avg("hit").alias("emp"))


def herfindahl(picks: DataFrame, sector: str = "bucket", by: str = "date") -> DataFrame:
    """(hhi, top_share): mean over dates of the squared sector shares and of the largest share."""
    s = picks.groupBy(by, F.coalesce(sector, F.lit("<none>")).alias("s")).agg(F.count("*").alias("k"))
    d = s.withColumn("sh", F.col("k") / F.sum("k").over(Window.partitionBy(by))).groupBy(by).agg(F.sum(F.col("sh") * F.col("sh")).alias("h"), F.max("sh").alias("m"))
    return d.agg(F.avg("h").alias("hhi"), F.avg("m").alias("top_share"))


def require(df: DataFrame, condition: str, message: str) -> DataFrame:
    """The one-row frame, if its condition holds."""
    if df.where(condition).isEmpty():
        raise ValueError(f"{message}: {[r.asDict() for r in df.take(1)]}")
    return df
