"""Further operators and studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import asof as J
from panelspark.operators import events as E
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.order import sliding_quantiles
from panelspark.queries import query
from panelspark.queries.books import BOOK, SUMMARY, SUMMED, book_sql, top_book
from panelspark.queries.events import abnormal
from panelspark.queries.factors import IC, LIMITS, REV, SCORES, Z, month_scores, rets, series
from panelspark.queries.stats import IXR, ixr
from panelspark.queries.studies import DRIFT, MONTHLY, book, drift_sql, report


@query("a26_pull_health", "SELECT avg(CASE WHEN n >= 10 THEN 1.0 ELSE 0.0 END) AS healthy, count(*) AS names FROM (SELECT code, count(*) AS n FROM bars GROUP BY code) x", "healthy")
def a26(t):
    return t.bars.groupBy("code").agg(F.count("*").alias("n")).agg(F.avg((F.col("n") >= 10).cast("double")).alias("healthy"), F.count("*").alias("names"))


HELD = SCORES | {"pk": "SELECT c.pos, x.code AS pick FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS r FROM ms WHERE mom IS NOT NULL) x JOIN calendar c ON c.date = x.date WHERE r = 1"}


@query("a30_held_mix", "SELECT held, count(*) AS days FROM (SELECT c.pos, max_by(p.pick, p.pos) AS held FROM calendar c JOIN pk p ON p.pos + 2 <= c.pos GROUP BY c.pos) d GROUP BY held", extra=HELD)
def a30(t):
    d = B.rotation(X.argmax_asset(month_scores(t), "mom"), rets(t), t.calendar)
    return d.where("held is not null").groupBy("held").agg(F.count("*").alias("days"))


@query("b14_buy_hold", "SELECT date, avg(ret) AS ew FROM rets WHERE ret IS NOT NULL GROUP BY date", "ew")
def b14(t):
    return rets(t).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("ew"))


@query("b20_live_step", "SELECT account, max(date) AS as_of, max_by(equity, date) AS equity, max_by(equity, date)/1e6 - 1 AS total FROM (SELECT a.account, d.date, 1e6 - coalesce(sum(f.shares*f.price + f.fee), 0) + coalesce(sum(f.shares*coalesce(m.close, 0)), 0) AS equity FROM (SELECT DISTINCT account FROM fills) a CROSS JOIN (SELECT DISTINCT date FROM marks) d LEFT JOIN fills f ON f.account = a.account AND f.date <= d.date LEFT JOIN marks m ON m.code = f.code AND m.date = d.date GROUP BY 1, 2) z GROUP BY account", "equity total")
def b20(t):
    g = B.ledger(t.fills, t.marks).groupBy("account").agg(F.max("date").alias("as_of"), F.max_by("equity", "date").alias("equity"))
    return g.withColumn("total", F.col("equity") / 1e6 - 1)


@query("x14_deviation_shape", "SELECT q, count(*) AS n, avg(fwd) AS mean FROM (SELECT date, fwd, CASE WHEN n >= 5 THEN greatest(0, CAST(ceil(r*5.0/greatest(n - 1, 1)) AS INT) - 1) END AS q FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom, code) - 1 AS r, count(*) OVER (PARTITION BY date) AS n FROM ms WHERE mom IS NOT NULL AND fwd IS NOT NULL) a) b GROUP BY q", "mean", extra=SCORES)
def x14(t):
    d = month_scores(t).where("mom is not null and fwd is not null").withColumn("q", X.quantile_bin("mom", 5))
    return d.groupBy("q").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean"))


@query("x17_demeaned_forward", "SELECT date, code, fwd - avg(fwd) OVER (PARTITION BY date) AS fwd FROM ms WHERE fwd IS NOT NULL", "fwd", extra=SCORES)
def x17(t):
    return month_scores(t).where("fwd is not null").select("date", "code", X.cross_demean("fwd").alias("fwd"))


@query("w34_attribution_legs", "SELECT series_id, date, coalesce(max(state) OVER (PARTITION BY series_id ORDER BY pos), 0) AS entry_only, CASE WHEN x >= hi THEN 0 ELSE 1 END AS exit_only FROM rs", extra=REV)
def w34(t):
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = W.threshold_reversal_state(series(t))
    return d.select("series_id", "date", F.max("state").over(w).alias("entry_only"), F.when(F.col("x") >= F.col("q_hi"), 0).otherwise(1).alias("exit_only"))


@query("e6_q25_symposium", "SELECT horizon, count(*) AS n, avg(car) AS mean FROM (SELECT h.horizon, b.s - a.s AS car FROM (SELECT d.code, min(c.pos) AS p FROM dividends d JOIN calendar c ON c.date > d.ex_date GROUP BY d.code, d.ex_date) e CROSS JOIN (VALUES (5), (20)) h(horizon) JOIN pf a ON a.code = e.code AND a.pos = e.p JOIN pf b ON b.code = e.code AND b.pos = e.p + h.horizon) z GROUP BY horizon", "mean", extra=LIMITS | {
    "ab": "SELECT f.*, ret - avg(ret) OVER (PARTITION BY f.date) AS abn FROM (SELECT *, close / pre - 1 AS ret FROM flags) f",
    "pf": "SELECT code, pos, sum(coalesce(abn, 0)) OVER (PARTITION BY code ORDER BY pos) AS s FROM ab"})
def e6(t):
    ev = J.next_trading_row(t.dividends.select("code", "ex_date"), t.calendar, "ex_date")
    c = E.event_cars(ev, abnormal(t), [5, 20]).where("car is not null")
    return c.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("car").alias("mean"))


@query("e10_schedule_into", "SELECT d.code, d.ex_date, z.close / b.close AS growth FROM dividends d ASOF JOIN index_series b ON b.series_id = 'EW' AND b.date >= d.ex_date ASOF JOIN (SELECT 'EW' AS k, date, close FROM index_series) z ON z.k = 'EW' AND z.date <= d.ex_date + 100".replace("b.series_id = 'EW'", "b.series_id = d.k").replace("z.k = 'EW'", "z.k = d.k").replace("FROM dividends d", "FROM (SELECT *, 'EW' AS k FROM dividends) d"), "growth")
def e10(t):
    ev = t.dividends.select("code", "ex_date", F.lit("EW").alias("series_id"), F.date_add("ex_date", 100).alias("end"))
    i = t.index_series.select("series_id", "date", "close")
    a = J.asof_join(ev, i, ["series_id"], "ex_date", "date", "forward").withColumnRenamed("close", "c0").drop("date").where("c0 is not null")
    return J.asof_join(a, i, ["series_id"], "end", "date").select("code", "ex_date", (F.col("close") / F.col("c0")).alias("growth"))


@query("q3_turnstd_blend", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | Z | {
    "tq": "SELECT date, quantile_cont(-turn, 0.01) AS t1, quantile_cont(-turn, 0.99) AS t9 FROM ms GROUP BY date",
    "tw": "SELECT ms.date, ms.code, CASE WHEN turn IS NOT NULL THEN least(greatest(-turn, t1), t9) END AS c FROM ms JOIN tq ON tq.date = ms.date",
    "tz": "SELECT date, code, CASE WHEN stddev_samp(c) OVER w > 1e-9 * abs(avg(c) OVER w) THEN (c - avg(c) OVER w) / stddev_samp(c) OVER w END AS zt FROM tw WINDOW w AS (PARTITION BY date)",
} | book_sql("SELECT 'a' AS variant, date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY sc DESC, code) AS p FROM (SELECT z.date, z.code, CASE WHEN ze IS NOT NULL OR zt IS NOT NULL THEN round((coalesce(ze, 0) + 0.5*coalesce(zt, 0)) / (CASE WHEN ze IS NULL THEN 0 ELSE 1 END + CASE WHEN zt IS NULL THEN 0 ELSE 0.5 END), 9) END AS sc FROM zz z JOIN tz ON tz.date = z.date AND tz.code = z.code) a WHERE sc IS NOT NULL) b WHERE p <= 5", MONTHLY))
def q3(t):
    s = X.standardize(X.standardize(month_scores(t).withColumn("ts", -F.col("turn")), "ts", "zt"), "ey", "ze")
    return report(book(t, s.withColumn("sc", F.round(X.blend(["ze", "zt"], [1.0, 0.5]), 9)), "sc"))


@query("q5_quality_concentration", "SELECT avg(h) AS hhi, avg(m) AS top_share FROM (SELECT date, sum(s*s) AS h, max(s) AS m FROM (SELECT date, k / sum(k) OVER (PARTITION BY date) AS s FROM (SELECT date, coalesce(bucket, '<none>') AS b, count(*) AS k FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey DESC, code) AS r FROM ms WHERE ey IS NOT NULL) x JOIN industry USING (code) WHERE r <= 5 GROUP BY 1, 2) y) z GROUP BY date) w", "hhi top_share", extra=SCORES)
def q5(t):
    return A.herfindahl(month_scores(t).withColumn("r", X.place("ey")).where("r <= 5").join(F.broadcast(t.industry), "code"))


@query("q6_size_tilt", "SELECT date, corr(a, b) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY -amount) + (count(*) OVER (PARTITION BY date, amount) - 1)/2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1)/2.0 AS b FROM ms WHERE amount IS NOT NULL AND fwd IS NOT NULL) x GROUP BY date HAVING count(*) >= 5", "ic", extra=SCORES)
def q6(t):
    return X.rank_ic(month_scores(t).withColumn("sz", -F.col("amount")), "sz", "fwd").select("date", "ic")


@query("q10_cadence", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | book_sql(
    "SELECT variant, a.date, code FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey DESC, code) AS p FROM ms WHERE ey IS NOT NULL) a JOIN vs s ON s.date = a.date WHERE p <= 5",
    "SELECT variant, date FROM month_ends, (VALUES ('M'), ('Q')) v(variant) WHERE variant = 'M' OR quarter(date) * 3 = month(date)"))
def q10(t):
    """Monthly and quarterly rebalances of one book, in one job."""
    m = t.month_ends.withColumn("q", F.quarter("date") * 3 == F.month("date"))
    sig = m.select(F.lit("M").alias("variant"), "date").unionAll(m.where("q").select(F.lit("Q").alias("variant"), "date"))
    tgt = month_scores(t).withColumn("p", X.place("ey")).where("p <= 5").select("date", "code").join(F.broadcast(sig), "date").select("variant", "date", "code")
    return report(B.ew_portfolio(tgt, sig, rets(t), t.calendar, (0.001, 0.002))[0].join(F.broadcast(t.calendar), "pos"))


@query("q13_index_hedge", "SELECT regr_slope(d.net, i.r) AS beta, regr_r2(d.net, i.r) AS r2, count(*) AS n FROM dy d JOIN calendar c ON c.pos = d.pos JOIN ixr i ON i.date = c.date WHERE i.r IS NOT NULL", "beta r2", extra=SCORES | BOOK | IXR)
def q13(t):
    d = top_book(t)[0].join(F.broadcast(t.calendar), "pos").join(F.broadcast(ixr(t).select("date", "r")), "date")
    return A.beta_r2(d, "net", "r")


@query("q16_single_factor_ic", "SELECT avg(ic) AS mean_ic, count(*) AS n FROM ics", "mean_ic", extra=SCORES | IC)
def q16(t):
    return X.rank_ic(month_scores(t), "ey", "fwd").agg(F.avg("ic").alias("mean_ic"), F.count("*").alias("n"))


@query("q21_pyramid_entry", "SELECT filled, count(*) AS n, avg(pyramid - lump) AS edge FROM (SELECT 0.999*pn/p0 - 1 AS lump, (0.999*pn/p0 + coalesce(0.999*pn/f0, 1) + coalesce(0.999*pn/f1, 1))/3 - 1 AS pyramid, 1 + CAST(f0 IS NOT NULL AS INT) + CAST(f1 IS NOT NULL AS INT) AS filled FROM py) x GROUP BY filled", "edge", extra={
    "ow": "SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS pos FROM bars",
    "pa": "SELECT e.code, e.pos, e.close AS p0, w.pos AS row, w.close FROM ow e JOIN ow w ON w.code = e.code AND w.pos BETWEEN e.pos + 1 AND e.pos + 20",
    "py": "SELECT code, pos, any_value(p0) AS p0, max_by(close, row) AS pn, min_by(close, row) FILTER (close <= 0.925*p0) AS f0, min_by(close, row) FILTER (close <= 0.85*p0) AS f1 FROM pa GROUP BY code, pos"})
def q21(t):
    from panelspark.queries.events import e7

    return e7(t).groupBy("filled").agg(F.count("*").alias("n"), F.avg(F.col("pyramid") - F.col("lump")).alias("edge"))


@query("q22_cyclical_pe", f"SELECT {SUMMED} FROM vp", SUMMARY, extra={
    "pq": "SELECT code, date, close, round(pe_ttm, 4) AS pe, pos FROM dense",
    "pw": "SELECT *, CASE WHEN count(CASE WHEN pe > 0 THEN pe END) OVER w >= 5 THEN round(quantile_cont(CASE WHEN pe > 0 THEN pe END, 0.7) OVER w, 6) END AS q70, CASE WHEN count(CASE WHEN pe > 0 THEN pe END) OVER w >= 5 THEN round(quantile_cont(CASE WHEN pe > 0 THEN pe END, 0.3) OVER w, 6) END AS q30 FROM pq WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "ph": "SELECT code, date, close, coalesce(last_value(CASE WHEN pe > 0 AND pe <= q30 THEN 0 WHEN pe < 0 OR pe >= q70 THEN 1 END IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos), 0) AS held FROM pw",
} | book_sql(
    "SELECT variant, date, code FROM ph JOIN month_ends USING (date), (VALUES ('inverse'), ('all')) v(variant) WHERE close IS NOT NULL AND (variant = 'all' OR held = 1)",
    "SELECT variant, date FROM month_ends, (VALUES ('inverse'), ('all')) v(variant)"))
def q22(t):
    """Held on a high or negative multiple, sold on a low one, against holding all."""
    d = rets(t).withColumn("pe_ttm", F.round("pe_ttm", 4)).withColumn("own", F.when(F.col("pe_ttm") > 0, F.col("pe_ttm")))
    d = sliding_quantiles(d, {"q70": ("own", 0.7, 60, 5), "q30": ("own", 0.3, 60, 5)}).withColumns({c: F.round(c, 6) for c in ("q70", "q30")})
    d = d.withColumn("held", W.state_hold((F.col("pe_ttm") < 0) | (F.col("pe_ttm") >= F.col("q70")), (F.col("pe_ttm") > 0) & (F.col("pe_ttm") <= F.col("q30"))))
    m = d.join(F.broadcast(t.month_ends), "date").where("held = 1 and close is not null").select(F.lit("inverse").alias("variant"), "date", "code")
    a = d.join(F.broadcast(t.month_ends), "date").where("close is not null").select(F.lit("all").alias("variant"), "date", "code")
    sig = t.month_ends.crossJoin(F.broadcast(t.spark.createDataFrame([("inverse",), ("all",)], "variant string")))
    return report(B.ew_portfolio(m.unionAll(a), sig, rets(t), t.calendar, (0.001, 0.002))[0].join(F.broadcast(t.calendar), "pos"))


@query("q28_anchor_quintiles", "SELECT q, count(*) AS n_periods, avg(m) AS mean, avg(m)/(stddev_samp(m)/sqrt(count(*))) AS t FROM (SELECT q, date_trunc('month', date) AS k, avg(fwd) AS m FROM (SELECT date, fwd, CASE WHEN n >= 5 THEN greatest(0, CAST(ceil(r*5.0/greatest(n - 1, 1)) AS INT) - 1) END AS q FROM (SELECT s.date, s.fwd, row_number() OVER (PARTITION BY s.date ORDER BY dev, s.code) - 1 AS r, count(*) OVER (PARTITION BY s.date) AS n FROM ms s JOIN dv ON dv.date = s.date AND dv.code = s.code WHERE s.fwd IS NOT NULL AND dev IS NOT NULL) a) b WHERE q IS NOT NULL GROUP BY 1, 2) c GROUP BY q", "mean t", extra=SCORES | {
    "dv": "SELECT b.code, b.date, b.close / (f.c0 * pow(1 + r.m, (b.date - f.d0) / 365.25)) - 1 AS dev FROM bars b ASOF JOIN (SELECT code, pub_date, avg(roe) OVER (PARTITION BY code ORDER BY pub_date) AS m FROM annual_reports) r ON r.code = b.code AND r.pub_date <= b.date JOIN (SELECT code, min(date) AS d0, min_by(close, date) AS c0 FROM bars GROUP BY code) f ON f.code = b.code",
})
def q28(t):
    from panelspark.queries.joins import w27

    d = w27(t).join(month_scores(t), ["date", "code"]).where("fwd is not null").withColumn("q", X.quantile_bin("dev", 5))
    return A.clustered_t(d.where("q is not null"), "fwd", by=("q",)).select("q", "n_periods", "mean", "t")


def drift(t, events, horizons=(20, 60)):
    ev = J.next_trading_row(events, t.calendar, "pub_date")
    c = E.event_cars(ev, abnormal(t), list(horizons)).withColumn("date", F.col("pub_date"))
    return A.event_summary(c, "car", ("horizon",)).select("horizon", "n", "mean", "median", "t_event", "share")


FELL = "SELECT code, pub_date FROM (SELECT code, pub_date, roe, avg(roe) OVER (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY code ORDER BY pub_date) AS k FROM annual_reports) x WHERE k > 3 AND m >= 0.11 AND m - roe >= 0.005"
TURNED = "SELECT code, min(pub_date) AS pub_date FROM (SELECT code, pub_date, capex, max(capex) OVER w AS hi, min(capex) OVER w AS lo, count(*) OVER w AS n FROM annual_reports WINDOW w AS (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) x WHERE n = 3 AND lo > 0 AND capex <= 0.9*hi GROUP BY code"


@query("q29_roe_decline", DRIFT, "mean median t_event share", extra=drift_sql(FELL))
def q29(t):
    from panelspark.queries.joins import w25

    return drift(t, w25(t))


@query("q32_capex_transition", DRIFT, "mean median t_event share", extra=drift_sql(TURNED))
def q32(t):
    from panelspark.queries.joins import w26

    return drift(t, w26(t))


@query("q36_peak_registration", "SELECT series_id, count(*) AS peaks FROM (SELECT *, count(x) OVER w AS n, max(x) OVER w AS m FROM ix WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) a WHERE n = 25 AND x = m GROUP BY series_id", extra=REV)
def q36(t):
    p = W.centered_peak("x", 12, Window.partitionBy("series_id").orderBy("pos"))
    return series(t).withColumn("p", p).where("p").groupBy("series_id").agg(F.count("*").alias("peaks"))


@query("q41_dataset_health", "SELECT code, count(*) AS rows, min(date) AS first, max(date) AS last, count(*) FILTER (close IS NULL) AS gaps FROM bars GROUP BY code")
def q41(t):
    return t.bars.groupBy("code").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(F.col("close").isNull()).alias("gaps"))
