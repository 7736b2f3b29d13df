"""Statistics of returns, events and forecasts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import dist
from panelspark.operators import stats as A
from panelspark.operators.order import correlations
from panelspark.operators import xsection as X
from panelspark.queries import query
from panelspark.queries.factors import rets

IXR = {"ixr": "SELECT series_id, date, close, close / lag(close) OVER (PARTITION BY series_id ORDER BY date) - 1 AS r FROM index_series"}
PRED = {"pr": "SELECT doc_id, y, [1 - p1, p1] AS p, greatest(p1, 1 - p1) AS conf, CASE WHEN 1 - p1 >= p1 THEN 0 ELSE 1 END AS c FROM predictions"}


def ixr(t):
    return t.index_series.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("series_id").orderBy("date")) - 1)


@query("a1_universe_mean", "SELECT c.date, coalesce(avg(r.ret), 0) AS m FROM calendar c LEFT JOIN members m ON m.date = c.date LEFT JOIN rets r ON r.date = m.date AND r.code = m.code GROUP BY c.date", "m")
def a1(t):
    from panelspark.operators.asof import membership_asof

    m = membership_asof(t.calendar.select("date"), t.membership).join(rets(t).select("date", "code", "ret"), ["date", "code"], "left")
    return t.calendar.select("date").join(m, "date", "left").groupBy("date").agg(F.coalesce(F.avg("ret"), F.lit(0.0)).alias("m"))


@query("a2_a5_tstat_sharpe", "SELECT code, avg(ret) / (stddev_samp(ret) / sqrt(count(ret))) AS t, avg(ret) / stddev_samp(ret) * sqrt(252.0) AS sharpe FROM rets GROUP BY code", "t sharpe")
def a2(t):
    return rets(t).groupBy("code").agg(A.t_of("ret").alias("t"), A.sharpe_of("ret").alias("sharpe"))


@query("a3_clustered_t", "SELECT code, count(*) AS n_periods, avg(m) AS mean, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM (SELECT code, date_trunc('month', date) AS p, avg(ret) AS m FROM rets WHERE ret IS NOT NULL GROUP BY 1, 2) x GROUP BY code", "mean t")
def a3(t):
    return A.clustered_t(rets(t), "ret", by=("code",))


@query("a4_batch_t", "SELECT count(*) AS n, avg(m) AS mean, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM (SELECT snap_date, avg(b.close) AS m FROM membership s JOIN bars b ON b.code = s.code AND b.date = s.snap_date GROUP BY snap_date) x", "mean t")
def a4(t):
    m = t.membership.join(t.bars.withColumnRenamed("date", "snap_date"), ["code", "snap_date"]).groupBy("snap_date").agg(F.avg("close").alias("m"))
    return m.agg(F.count("*").alias("n"), F.avg("m").alias("mean"), A.t_of("m").alias("t"))


@query("a7_cagr", "SELECT series_id, pow(max_by(close, date) / min_by(close, date), 1.0 / greatest((max(date) - min(date)) / 365.25, 1e-9)) - 1 AS cagr FROM index_series GROUP BY series_id", "cagr")
def a7(t):
    return t.index_series.groupBy("series_id").agg(A.cagr_of("close").alias("cagr"))


@query("a8_perf_summary", "SELECT series_id, exp(sum(ln(1 + coalesce(r, 0)))) AS wealth, avg(coalesce(r, 0)) / stddev_samp(coalesce(r, 0)) * sqrt(252.0) AS sharpe, avg(coalesce(r, 0)) * 252 AS ann_mean, stddev_samp(coalesce(r, 0)) * sqrt(252.0) AS ann_vol FROM ixr GROUP BY series_id", "wealth sharpe ann_mean ann_vol", extra=IXR)
def a8(t):
    return A.perf_summary(ixr(t), "r").select("series_id", "wealth", "sharpe", "ann_mean", "ann_vol")


@query("a9_carry_in_slice", "SELECT series_id, label, min(d) AS max_drawdown, max_by(close, date) / min_by(close, date) - 1 AS growth FROM (SELECT *, close / max(close) OVER (PARTITION BY series_id ORDER BY date) - 1 AS d FROM index_series) x JOIN (VALUES ('a', DATE '1993-01-01', DATE '1994-12-31'), ('b', DATE '1995-01-01', DATE '1997-12-31')) w(label, lo, hi) ON date BETWEEN lo AND hi GROUP BY series_id, label", "max_drawdown growth")
def a9(t):
    w = t.spark.createDataFrame([("a", "1993-01-01", "1994-12-31"), ("b", "1995-01-01", "1997-12-31")], "label string, lo string, hi string").select("label", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return A.carry_in_slice(t.index_series, w, "close")


@query("a11_beta_r2", "SELECT code, regr_slope(ret, r) AS beta, regr_r2(ret, r) AS r2, count(*) AS n FROM rets JOIN ixr USING (date) WHERE ret IS NOT NULL AND r IS NOT NULL GROUP BY code", "beta r2", extra=IXR)
def a11(t):
    return A.beta_r2(rets(t).join(F.broadcast(ixr(t).select("date", "r")), "date"), "ret", "r", ("code",))


@query("a12_pair_corr", "SELECT a.code AS x, b.code AS y, corr(a.ret, b.ret) AS c FROM rets a JOIN rets b ON a.date = b.date AND a.code < b.code WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2", "c")
def a12(t):
    return correlations(rets(t), "ret").select("x", "y", "c")


@query("a13_window_inference")
def a13(t):
    return A.window_inference(rets(t), "ret", ("code",))


@query("a14_p_this_weak")
def a14(t):
    d = ixr(t).agg(F.avg(F.when(F.year("date") >= 1996, F.col("r"))).alias("w"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.count(F.when(F.year("date") >= 1996, F.col("r"))).alias("n"))
    return d.select(F.round(A.p_this_weak(F.col("w"), F.col("m"), F.col("s"), F.col("n")), 6).alias("p"))


@query("a15_welch", "SELECT (ma - mb) / sqrt(va + vb) AS t, pow(va + vb, 2) / (va*va/(na-1) + vb*vb/(nb-1)) AS df FROM (SELECT avg(r) FILTER (date < DATE '1995-01-01') AS ma, avg(r) FILTER (date >= DATE '1995-01-01') AS mb, var_samp(r) FILTER (date < DATE '1995-01-01') / count(r) FILTER (date < DATE '1995-01-01') AS va, var_samp(r) FILTER (date >= DATE '1995-01-01') / count(r) FILTER (date >= DATE '1995-01-01') AS vb, count(r) FILTER (date < DATE '1995-01-01') AS na, count(r) FILTER (date >= DATE '1995-01-01') AS nb FROM ixr) x", "t df", extra=IXR)
def a15(t):
    return A.welch(ixr(t), "r", F.col("date") < "1995-01-01").select("t", "df")


@query("a16_sign_test", "SELECT code, count(*) FILTER (ret > 0) AS wins, count(*) AS n FROM rets WHERE ret IS NOT NULL AND ret <> 0 GROUP BY code")
def a16(t):
    return A.sign_test(rets(t), "ret", ("code",)).drop("p")


@query("a17_winsorized_t", "SELECT count(*) AS n_periods, avg(m) AS mean, avg(m) / (stddev_samp(m) / sqrt(count(*))) AS t FROM (SELECT date_trunc('month', date) AS p, avg(least(greatest(ret, q1), q9)) AS m FROM rets, (SELECT quantile_cont(ret, 0.01) AS q1, quantile_cont(ret, 0.99) AS q9 FROM rets) q WHERE ret IS NOT NULL GROUP BY 1) x", "mean t")
def a17(t):
    return A.winsorized_clustered_t(rets(t), "ret")


@query("a18_event_summary", "SELECT code, count(*) AS n, avg(ret) AS mean, quantile_cont(ret, 0.5) AS median, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t_event, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS share FROM rets WHERE ret IS NOT NULL GROUP BY code", "mean median t_event share")
def a18(t):
    return A.event_summary(rets(t), "ret", ("code",)).drop("t_month")


@query("a19_per_year", "SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM (SELECT year(date) AS y, count(*) AS n FROM bars GROUP BY 1) x", "median")
def a19(t):
    return t.bars.groupBy(F.year("date").alias("y")).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


def preds(t):
    return t.predictions.select("doc_id", "y", F.array(1 - F.col("p1"), F.col("p1")).alias("p"))


@query("a20_a21_losses", "SELECT -avg(ln(least(greatest(p[y + 1], 1e-15), 1.0))) AS log_loss, avg(pow(p[1] - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(p[2] - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2)) AS brier FROM pr", "log_loss brier", extra=PRED)
def a20(t):
    return preds(t).agg(A.log_loss().alias("log_loss"), A.brier().alias("brier"))


@query("a22_q40_reliability", "SELECT CAST(least(floor((conf - lo) / ((1 - lo) / 10)), 9) AS INT) AS bin, count(*) AS n, avg(conf) AS pred, avg(CASE WHEN c = y THEN 1.0 ELSE 0.0 END) AS emp FROM pr, (SELECT min(conf) AS lo FROM pr) m GROUP BY 1", "pred emp", extra=PRED)
def a22(t):
    return A.reliability(preds(t))


@query("a23_herfindahl", "SELECT avg(h) AS hhi, avg(m) AS top_share FROM (SELECT date, sum(s*s) AS h, max(s) AS m FROM (SELECT date, k / sum(k) OVER (PARTITION BY date) AS s FROM (SELECT date, coalesce(bucket, '<none>') AS b, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS r FROM bars) x JOIN industry USING (code) WHERE r <= 5 GROUP BY 1, 2) y) z GROUP BY date) w", "hhi top_share")
def a23(t):
    top = t.bars.withColumn("r", X.place("amount")).where("r <= 5").join(F.broadcast(t.industry), "code")
    return A.herfindahl(top)


@query("a25_a27_coverage", "SELECT (SELECT count(DISTINCT code) FROM bars) / (SELECT count(DISTINCT code) FROM membership) AS coverage, (SELECT max(date) FROM bars) AS latest, (SELECT avg(CASE WHEN b.code IS NULL THEN 0.0 ELSE 1.0 END) FROM members m LEFT JOIN bars b ON b.code = m.code AND b.date = m.date WHERE m.date = (SELECT max(date) FROM calendar)) AS published", "coverage published")
def a25(t):
    from panelspark.operators.asof import membership_asof

    latest = t.bars.agg(F.max("date").alias("date"))
    m = membership_asof(latest, t.membership).join(t.bars.select("date", "code", F.lit(1.0).alias("there")), ["date", "code"], "left")
    pub = m.agg(F.max("date").alias("latest"), F.avg(F.coalesce("there", F.lit(0.0))).alias("published"))
    cov = t.bars.agg(F.count_distinct("code").alias("a")).crossJoin(t.membership.agg(F.count_distinct("code").alias("b")))
    return cov.crossJoin(pub).select((F.col("a") / F.col("b")).alias("coverage"), "latest", "published")


@query("a28_a37_missing_keys", "SELECT DISTINCT code FROM bars WHERE code NOT IN (SELECT code FROM holders WHERE stat_date >= DATE '1998-10-01')")
def a28(t):
    return t.codes.join(t.holders.where("stat_date >= date'1998-10-01'"), "code", "left_anti")


@query("a28_missing_in_window", "SELECT c.code, count(*) AS missing FROM codes c CROSS JOIN (SELECT date FROM calendar WHERE date >= DATE '1998-01-01') d WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.code = c.code AND b.date = d.date) GROUP BY c.code")
def a28w(t):
    """Trading days of a window on which a code has no row."""
    days = t.calendar.where("date >= date'1998-01-01'").select("date")
    return t.codes.crossJoin(F.broadcast(days)).join(t.bars.select("code", "date"), ["code", "date"], "left_anti").groupBy("code").agg(F.count("*").alias("missing"))


@query("a37_incomplete_days", "SELECT date, n_codes - n AS lacking FROM (SELECT date, count(DISTINCT code) AS n FROM bars GROUP BY date) d, (SELECT count(*) AS n_codes FROM codes) c WHERE n < n_codes")
def a37(t):
    """Days that lack a key of the whole set, and how many."""
    total = t.codes.agg(F.count("*").alias("n_codes"))
    d = t.bars.groupBy("date").agg(F.count_distinct("code").alias("n")).crossJoin(F.broadcast(total))
    return d.where("n < n_codes").select("date", (F.col("n_codes") - F.col("n")).alias("lacking"))


@query("a29_s25_freshness", "SELECT code, (SELECT max(date) FROM bars) - max(date) AS lag_days FROM bars GROUP BY code HAVING (SELECT max(date) FROM bars) - max(date) <= 45")
def a29(t):
    run = t.bars.agg(F.max("date").alias("run"))
    g = t.bars.groupBy("code").agg(F.max("date").alias("last")).crossJoin(F.broadcast(run))
    return g.select("code", F.date_diff("run", "last").cast("long").alias("lag_days")).where("lag_days <= 45")


@query("a31_drawdown_snapshot", "SELECT code, max(close) AS high, strftime(max_by(date, (close, -epoch(date))), '%Y-%m') AS high_month, max_by(close, date) / max(close) - 1 AS drawdown FROM bars GROUP BY code".replace("strftime(max_by(date, (close, -epoch(date))), '%Y-%m') AS high_month, ", ""), "high drawdown")
def a31(t):
    return t.bars.groupBy("code").agg(F.max("close").alias("high"), (F.max_by("close", "date") / F.max("close") - 1).alias("drawdown"))


@query("a32_log_corr", "SELECT corr(a, b) AS c FROM (SELECT ln(x) - ln(lag(x) OVER (ORDER BY m)) AS a, ln(y) - ln(lag(y) OVER (ORDER BY m)) AS b FROM (SELECT date_trunc('month', date) AS m, avg(close) FILTER (code LIKE 'sh%') AS x, avg(close) FILTER (code LIKE 'sz%') AS y FROM bars GROUP BY 1) q) z", "c")
def a32(t):
    w = Window.partitionBy(F.lit(1)).orderBy("m")
    g = t.bars.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.avg(F.when(F.col("code").startswith("sh"), F.col("close"))).alias("x"), F.avg(F.when(F.col("code").startswith("sz"), F.col("close"))).alias("y"))
    return g.select((F.log("x") - F.log(F.lag("x").over(w))).alias("a"), (F.log("y") - F.log(F.lag("y").over(w))).alias("b")).agg(F.corr("a", "b").alias("c"))


@query("a33_roe_vs_cagr", "SELECT corr(m, g) AS c, regr_slope(g, m) AS slope FROM (SELECT r.code, avg(roe) AS m FROM annual_reports r GROUP BY r.code HAVING count(*) >= 3) a JOIN (SELECT code, pow(max_by(close, date) / min_by(close, date), 1.0 / ((max(date) - min(date)) / 365.25)) - 1 AS g FROM bars GROUP BY code) b USING (code)", "c slope")
def a33(t):
    m = t.annual_reports.groupBy("code").agg(F.avg("roe").alias("m"), F.count("*").alias("k")).where("k >= 3")
    return m.join(t.bars.groupBy("code").agg(A.cagr_of("close").alias("g")), "code").agg(F.corr("m", "g").alias("c"), F.regr_slope("g", "m").alias("slope"))


@query("a34_holding_stats", "SELECT min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM (SELECT snap_date, count(*) AS n FROM membership GROUP BY 1) x", "median")
def a34(t):
    return t.membership.groupBy("snap_date").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"))


@query("a35_per_name_excess", "SELECT code, sum(e) AS excess, count(*) AS days FROM (SELECT code, ret - avg(ret) OVER (PARTITION BY date) AS e FROM rets WHERE ret IS NOT NULL) x GROUP BY code", "excess")
def a35(t):
    return rets(t).where("ret is not null").withColumn("e", X.cross_demean("ret")).groupBy("code").agg(F.sum("e").alias("excess"), F.count("*").alias("days"))


@query("a36_truncation_gate", "SELECT code, max(date) AS last FROM bars GROUP BY code HAVING max(date) < DATE '1998-12-01' - INTERVAL 15 DAY")
def a36(t):
    return t.bars.groupBy("code").agg(F.max("date").alias("last")).where("date_diff(date'1998-12-01', last) > 15")


@query("a36_truncated_series", "SELECT code, max(date) AS last FROM supplier_days GROUP BY code HAVING max(date) < (SELECT max(date) FROM supplier_days) - INTERVAL 15 DAY")
def a36s(t):
    """Series that end more than 15 days before the last of all."""
    end = t.supplier_days.agg(F.max("date").alias("end"))
    return t.supplier_days.groupBy("code").agg(F.max("date").alias("last")).crossJoin(F.broadcast(end)).where("date_diff(end, last) > 15").select("code", "last")


@query("a10_ann_vol", "SELECT code, stddev_samp(ret) * sqrt(252) AS ann_vol FROM rets WHERE ret IS NOT NULL GROUP BY code", "ann_vol")
def a10(t):
    return rets(t).where("ret is not null").groupBy("code").agg((F.stddev_samp("ret") * F.sqrt(F.lit(252))).alias("ann_vol"))


@query("f4_distributions")
def f4(t):
    d = rets(t).where("ret is not null").groupBy("code").agg(A.t_of("ret").alias("t"), F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("w"))
    return d.select("code", F.round(dist.t_two_sided(F.col("t"), F.col("n") - 1), 6).alias("p_t"), F.round(dist.normal_cdf(F.col("t")), 6).alias("phi"), F.round(dist.t_quantile(0.975, F.col("n") - 1), 5).alias("t975"), F.round(dist.binomial_two_sided(F.col("w"), F.col("n")), 6).alias("p_sign"))
