"""Learning and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import membership_asof
from panelspark.plans import ml
from panelspark.queries import query
from panelspark.queries.factors import LIMITS, SCORES, Z, flagged, month_scores
from panelspark.sources.files import fresh_path, written
from panelspark.streaming import streams


def drained(t, df, mode: str, name: str):
    """Run a streaming frame over what is there and give its rows as a table."""
    at = fresh_path(t.spark, f"stream-{name}")
    w = df.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True)
    if mode == "complete":
        w.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{at}/out")).start().awaitTermination()
    else:
        w.outputMode(mode).format("parquet").option("path", f"{at}/out").start().awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{at}/out")


def stream_of(t, name: str):
    schema = getattr(t, name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*" if not t.sf_dir.startswith("viewfs") else "*.parquet").parquet(t.sf_dir)


@query("m1_build_dataset", "SELECT date, count(*) AS n, sum(f) AS s FROM (SELECT date, fwd - avg(fwd) OVER (PARTITION BY date) AS f FROM zz WHERE zm IS NOT NULL AND ze IS NOT NULL AND fwd IS NOT NULL) a GROUP BY date", "s", extra=SCORES | Z)
def m1(t):
    return ml.build_dataset(month_scores(t), ["mom", "ey"]).groupBy("date").agg(F.count("*").alias("n"), F.sum("fwd").alias("s"))


FACTORS = ("ep", "bp", "low_vol", "mom", "rev")
MIN_TRAIN = 24


def five_factors(t):
    """(date, code, five scores, fwd) of members at month ends. Prices and multiples of days without a bar are the last ones."""
    carry = lambda c: F.last(c, True).over(W.by_code().rowsBetween(Window.unboundedPreceding, 0))
    d = W.densify_panel(t.bars, t.calendar, t.codes).withColumns({"mark": W.valuation_mark(), "pe": carry("pe_ttm"), "pb": carry("pb_mrq")})
    d = d.withColumn("mr", W.daily_return("mark"))
    d = d.withColumns({"ep": S.inverse_positive("pe"), "bp": S.inverse_positive("pb"), "low_vol": W.low_vol("mr", 120), "mom": W.momentum("mark", 120, 20), "rev": -W.trailing_return("mark", 20)})
    w = Window.partitionBy("code").orderBy("date")
    m = d.join(F.broadcast(t.month_ends), "date").withColumn("fwd", F.lead("mark").over(w) / F.col("mark") - 1)
    return m.join(membership_asof(t.month_ends, t.membership), ["date", "code"]).select("date", "code", *FACTORS, "fwd")


def folded(t):
    d = written(ml.build_dataset(five_factors(t), list(FACTORS)), "factors")
    return d, [r.date for r in d.select("date").distinct().orderBy("date").collect()]  # a date a month


def out_of_sample(d, folds):
    """A row for each factor, of the months that a model would be asked for."""
    late = d.where(F.col("date") >= F.lit(folds[MIN_TRAIN])) if len(folds) > MIN_TRAIN else d.limit(0)
    return late.select("date", "code", "fwd", F.explode(F.array(*(F.struct(F.lit(f).alias("strategy"), F.round(f, 9).alias("v")) for f in FACTORS))).alias("x")).select("x.strategy", "date", "code", "x.v", "fwd")


FIVE = {
    "fill": "SELECT date, code, pos, CASE WHEN pos <= max(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY code) THEN last_value(close IGNORE NULLS) OVER w END AS mark, last_value(pe_ttm IGNORE NULLS) OVER w AS pe, last_value(pb_mrq IGNORE NULLS) OVER w AS pb FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos)",
    "moved": "SELECT *, mark / lag(mark) OVER (PARTITION BY code ORDER BY pos) - 1 AS mr FROM fill",
    "five": "SELECT date, code, mark, CASE WHEN pe > 0 THEN 1/pe END AS ep, CASE WHEN pb > 0 THEN 1/pb END AS bp, CASE WHEN count(mr) OVER v >= 120 THEN -stddev_samp(mr) OVER v END AS low_vol, lag(mark, 20) OVER w / lag(mark, 120) OVER w - 1 AS mom, -(mark / lag(mark, 20) OVER w - 1) AS rev FROM moved WINDOW w AS (PARTITION BY code ORDER BY pos), v AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)",
    "fivem": "SELECT f.*, fwd FROM (SELECT *, lead(mark) OVER (PARTITION BY code ORDER BY date) / mark - 1 AS fwd FROM five JOIN month_ends USING (date)) f JOIN members m ON m.date = f.date AND m.code = f.code",
    "tall": "SELECT date, code, fwd, f, x FROM (SELECT date, code, fwd, ep, bp, low_vol, mom, rev FROM fivem) UNPIVOT INCLUDE NULLS (x FOR f IN (ep, bp, low_vol, mom, rev))",
    "cuts": "SELECT date, f, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM tall GROUP BY date, f",
    "clipped": "SELECT t.*, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS c FROM tall t JOIN cuts USING (date, f)",
    "scaled": "SELECT *, CASE WHEN stddev_samp(c) OVER w > 1e-9 * abs(avg(c) OVER w) THEN (c - avg(c) OVER w) / stddev_samp(c) OVER w END AS z FROM clipped WINDOW w AS (PARTITION BY date, f)",
    "whole": "SELECT s.date, s.code, f AS strategy, round(z, 9) AS v, fwd FROM scaled s JOIN (SELECT date, code FROM scaled GROUP BY date, code HAVING count(z) = 5 AND count(fwd) = 5) k USING (date, code)",
    "oos": f"SELECT strategy, date, code, v, fwd - avg(fwd) OVER (PARTITION BY strategy, date) AS fwd FROM whole WHERE date >= (SELECT max(date) FROM (SELECT DISTINCT date FROM whole ORDER BY date LIMIT {MIN_TRAIN + 1}) z HAVING count(*) = {MIN_TRAIN + 1})",
    "ranked": "SELECT *, rank() OVER (PARTITION BY strategy, date ORDER BY v) + (count(*) OVER (PARTITION BY strategy, date, v) - 1)/2.0 AS a, rank() OVER (PARTITION BY strategy, date ORDER BY fwd) + (count(*) OVER (PARTITION BY strategy, date, fwd) - 1)/2.0 AS b, row_number() OVER (PARTITION BY strategy, date ORDER BY v DESC, code) AS p, row_number() OVER (PARTITION BY strategy, date ORDER BY v, code) - 1 AS r, count(*) OVER (PARTITION BY strategy, date) AS n FROM oos",
    "monthly": "SELECT strategy, date, round(corr(a, b), 9) AS ic, avg(CASE WHEN p <= 5 THEN fwd END) - avg(fwd) AS excess, avg(CASE WHEN greatest(0, ceil(r*5.0/greatest(n - 1, 1)) - 1) = 4 THEN fwd END) - avg(CASE WHEN greatest(0, ceil(r*5.0/greatest(n - 1, 1)) - 1) = 0 THEN fwd END) AS spread FROM ranked GROUP BY strategy, date HAVING count(*) >= 5",
}


@query("q16_single_factors", "SELECT strategy, count(ic) AS months, avg(ic) AS mean_ic, avg(ic)/stddev_samp(ic) AS ir, avg(ic)/stddev_samp(ic)*sqrt(count(ic)) AS t, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS hit, avg(excess) AS excess, avg(spread) AS spread FROM monthly GROUP BY strategy", "mean_ic ir t hit excess spread", extra=FIVE)
def q16_factors(t):
    """The five factors by themselves, over the months that a model is asked for."""
    return ml.evaluated(out_of_sample(*folded(t)))


@query("q16_model_vs_factors")
def q16_model(t):
    """The model's scores against those of the single factors, over the months that it predicts."""
    d, folds = folded(t)
    p = ml.walk_forward_predict(d, list(FACTORS), folds)
    alone = out_of_sample(d, folds).join(F.broadcast(p.select("date").distinct()), "date")
    both = alone.unionByName(p.select(F.lit("model").alias("strategy"), "date", "code", F.col("pred").alias("v"), "fwd"))
    return ml.evaluated(both).select("strategy", "months", *(F.round(c, 6).alias(c) for c in ("mean_ic", "ir", "t", "hit", "excess", "spread")))


@query("m2_m3_walk_forward")
def m2(t):
    """Rank correlation of each month's predictions with what followed."""
    d, folds = folded(t)
    return X.rank_ic(ml.walk_forward_predict(d, list(FACTORS), folds), "pred", "fwd").withColumn("ic", F.round("ic", 6))


def arriving(t, name: str, batches: list, start):
    """Write batch after batch into one folder and run the stream over what is new: start(stream, base) gives a started query, and each run takes up where the last one ended."""
    base = fresh_path(t.spark, name)
    for b in batches:
        b.write.mode("append").parquet(f"{base}/in")
        start(t.spark.readStream.schema(b.schema).parquet(f"{base}/in"), base).awaitTermination()
    return base


#: Events as they arrive: the first half, the second half, and then every tenth of all, most of them late.
ARRIVALS = {"arrivals": "SELECT *, CASE WHEN event_id % 10 = 7 THEN 2 WHEN event_id * 2 < (SELECT count(*) FROM events) THEN 0 ELSE 1 END AS batch FROM events"}
MINUTES = (1, 5, 60)


def arrivals(t):
    d = t.sql("SELECT * FROM arrivals", ARRIVALS).withColumn("ts", F.col("ts").cast("timestamp"))
    return [d.where(F.col("batch") == k).drop("batch") for k in range(3)]


def latest(t, path: str, keys: list[str], schema: str):
    """The row of the last batch for each key."""
    d = t.spark.read.schema(f"{schema}, v int").parquet(path)
    return d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("v")))).where("__k = 1").drop("__k", "v")


#: mark: the watermark when a batch begins, the latest time before it in whole milliseconds less the delay.
WINDOWED = ARRIVALS | {
    "marks": "SELECT max(CASE WHEN batch = 0 THEN ts END) AS b0, max(CASE WHEN batch < 2 THEN ts END) AS b1, max(ts) AS b2 FROM arrivals",
    "marked": "SELECT a.*, m, CAST(floor(epoch_us(ts) / (m * 60000000.0)) AS BIGINT) * m AS first, date_trunc('milliseconds', CASE batch WHEN 1 THEN b0 WHEN 2 THEN b1 END) - INTERVAL 10 MINUTE AS mark, date_trunc('milliseconds', b2) - INTERVAL 10 MINUTE AS last_mark FROM arrivals a JOIN marks ON TRUE JOIN (VALUES (1), (5), (60)) v(m) ON TRUE",
    "ended": "SELECT *, mark IS NOT NULL AND (first + m) * 60000 <= epoch_ms(mark) AS late, (first + m) * 60000 <= epoch_ms(last_mark) AS closed FROM marked",
}


@query("t3_minute_bars", "SELECT event_type, m AS minutes, first, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM ended WHERE NOT late AND closed GROUP BY event_type, m, first", "open high low close", extra=WINDOWED)
def t3(t):
    """Bars of three lengths from one stream in three arrivals; windows close as the watermark passes, rows for closed windows are dropped. first: minutes since 1970."""

    def start(stream, base):
        bars = streams.many_period_bars(stream.withColumn("one", F.lit(1)), MINUTES, key="event_type", price="value", volume="one", late="10 minutes", tie="event_id")
        return bars.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()

    base = arriving(t, "minute_bars", arrivals(t), start)
    out = t.spark.read.schema("event_type string, start timestamp, open double, high double, low double, close double, volume long, minutes int").parquet(f"{base}/out")
    return out.select("event_type", "minutes", F.expr("unix_seconds(start) div 60").alias("first"), "open", "high", "low", "close", F.col("volume").alias("n"))


@query("t3_late_rows", "SELECT event_type, m AS minutes, count(*) AS late FROM ended WHERE late GROUP BY event_type, m", extra=WINDOWED)
def t3_late(t):
    """How many rows of each length came after their window had closed."""

    def start(stream, base):
        rows = streams.with_periods(stream, MINUTES)
        return streams.into_versions(streams.late_rows(rows, ["event_type", "minutes"], F.col("end")), f"{base}/out", f"{base}/state")

    base = arriving(t, "late_rows", arrivals(t), start)
    return latest(t, f"{base}/out", ["event_type", "minutes"], "event_type string, minutes int, late long")


DEDUP = ARRIVALS | {
    "marks": "SELECT max(CASE WHEN batch = 0 THEN ts END) AS b0, max(CASE WHEN batch < 2 THEN ts END) AS b1 FROM arrivals",
    "marked": "SELECT a.*, batch > 0 AND epoch_ms(ts) <= epoch_ms(CASE batch WHEN 1 THEN b0 ELSE b1 END - INTERVAL 5 DAY) AND ts <= date_trunc('milliseconds', CASE batch WHEN 1 THEN b0 ELSE b1 END - INTERVAL 5 DAY) AS late FROM arrivals a JOIN marks ON TRUE",
}


@query("t2_stream_dedup", "SELECT event_type, count(*) AS n FROM marked WHERE NOT late GROUP BY event_type", extra=DEDUP)
def t2(t):
    """Overlapping windows: the second arrival holds the first one again, the third comes twice, and most of it after its time has passed."""
    one, two, three = arrivals(t)

    def start(stream, base):
        kept = streams.minute_dedup(stream, ["event_id"], "ts", "5 days").select("event_id", "event_type")
        return kept.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()

    base = arriving(t, "dedup", [one, one.unionAll(two), three.unionAll(three)], start)
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("t4_t7_stream_ledger", "SELECT account, code, CAST(sum(shares) AS BIGINT) AS shares, sum(CAST(round((shares*price + fee)*1e7) AS BIGINT)) / 1e7 AS paid FROM fills GROUP BY 1, 2", "paid")
def t4(t):
    """Fills that arrive in three batches, most of them more than once: the stream's positions are those of the fills."""
    e = t.events
    f = e.select((F.col("user_id") % 20).alias("account"), F.col("event_type").alias("code"), F.col("event_id").alias("fill_id"), F.col("ts").cast("timestamp").alias("ts"), (F.when(F.col("event_id") % 3 == 0, -100).otherwise(100) * (1 + F.col("event_id") % 5)).alias("shares"), F.col("value").alias("price"))
    f = f.withColumn("fee", F.greatest(F.lit(5.0), F.abs("shares") * F.col("price") * 0.00025))
    start = lambda stream, base: streams.into_versions(streams.ledger_stream(stream, late="40 days"), f"{base}/out", f"{base}/state")
    base = arriving(t, "ledger", [f.where("fill_id % 2 = 0"), f.unionAll(f.where("fill_id % 5 = 1")), f], start)
    return latest(t, f"{base}/out", ["account", "code"], "account long, code string, shares long, paid double")


@query("t6_event_detect", "SELECT code, count(*) AS n FROM (SELECT *, lag(flag) OVER (PARTITION BY code ORDER BY pos) AS prev FROM flags) x WHERE flag = 1 AND coalesce(prev, 9) <> 1 GROUP BY code", extra=LIMITS)
def t6(t):
    path = fresh_path(t.spark, "flags")
    flagged(t).select("code", "date", "flag").write.parquet(path)
    s = t.spark.readStream.schema("code string, date date, flag int").parquet(path)
    return drained(t, streams.fresh_flags(s, 1), "append", "flags").groupBy("code").agg(F.count("*").alias("n"))
