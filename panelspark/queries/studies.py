"""Studies end to end: operators composed into the reports that a user runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import membership_asof
from panelspark.queries import query
from panelspark.queries.books import RATES, SUMMARY, SUMMED, book_sql, summary
from panelspark.queries.events import ABN, LAD
from panelspark.queries.factors import BOX, REV, SCORES, Z, blended, boxed, month_scores, rets, series

def one():
    return F.lit("a").alias("variant")


def book(t, scores, score: str, n: int = 5, weight: str | None = None):
    m = scores.withColumn("p", X.place(score)).where(F.col("p") <= n)
    cols = [one(), "date", "code", *([weight] if weight else [])]
    return B.ew_portfolio(m.select(*cols), t.month_ends.select(one(), "date"), rets(t), t.calendar, RATES, weight=weight)[0].join(F.broadcast(t.calendar), "pos")


def report(df, ret: str = "net", by=("variant",)):
    return summary(df, by, ret)


def long_scores(t):
    """One row for each factor, date and code."""
    m = month_scores(t)
    return m.select("date", "code", "fwd", F.explode(F.array(F.struct(F.lit("ey").alias("factor"), F.col("ey").alias("v")), F.struct(F.lit("mom").alias("factor"), F.col("mom").alias("v")), F.struct(F.lit("turn").alias("factor"), (-F.col("turn")).alias("v")))).alias("x")).select("date", "code", "fwd", "x.factor", "x.v")


LONG = SCORES | {
    "lf": "SELECT date, code, fwd, 'ey' AS factor, ey AS v FROM ms UNION ALL SELECT date, code, fwd, 'mom' AS factor, mom AS v FROM ms UNION ALL SELECT date, code, fwd, 'turn' AS factor, -turn AS v FROM ms",
    "lr": "SELECT factor, date, rank() OVER (PARTITION BY factor, date ORDER BY v) + (count(*) OVER (PARTITION BY factor, date, v) - 1)/2.0 AS a, rank() OVER (PARTITION BY factor, date ORDER BY fwd) + (count(*) OVER (PARTITION BY factor, date, fwd) - 1)/2.0 AS b FROM lf WHERE v IS NOT NULL AND fwd IS NOT NULL",
    "li": "SELECT factor, date, round(corr(a, b), 9) AS ic FROM lr GROUP BY factor, date HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL",
}


@query("q1_factor_ic", "SELECT factor, avg(ic) AS mean_ic, stddev_samp(ic) AS sd, count(*) AS n, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(ic)/stddev_samp(ic) AS ir, avg(ic)/stddev_samp(ic)*sqrt(count(*)) AS t FROM li GROUP BY factor", "mean_ic sd hit ir t", extra=LONG)
def q1(t):
    return X.ic_summary(X.rank_ic(long_scores(t), "v", "fwd", ("factor", "date")), ("factor",))


MONTHLY = "SELECT 'a' AS variant, date FROM month_ends"


@query("q2_multifactor", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | Z | book_sql(
    "SELECT variant, date, code FROM (SELECT variant, date, code, row_number() OVER (PARTITION BY variant, date ORDER BY round(coalesce(ze*a, 0) - coalesce(zm*b, 0), 9) DESC, code) AS p FROM zz, (VALUES ('1:0', 1.0, 0.0), ('1:1', 1.0, 1.0), ('5:1', 5.0, 1.0)) v(variant, a, b)) x WHERE p <= 5",
    "SELECT variant, date FROM month_ends, (VALUES ('1:0'), ('1:1'), ('5:1')) v(variant)"))
def q2(t):
    s = blended(t)
    v = t.spark.createDataFrame([("1:0", 1.0, 0.0), ("1:1", 1.0, 1.0), ("5:1", 5.0, 1.0)], "variant string, a double, b double")
    x = s.crossJoin(F.broadcast(v)).withColumn("sc", F.coalesce(F.col("ze") * F.col("a"), F.lit(0.0)) + F.coalesce(F.col("zr") * F.col("b"), F.lit(0.0)))
    m = x.withColumn("p", X.place(F.round("sc", 9), True, ("variant", "date"))).where("p <= 5").select("variant", "date", "code")
    d = B.ew_portfolio(m, t.month_ends.crossJoin(F.broadcast(v.select("variant"))), rets(t), t.calendar, RATES)[0].join(F.broadcast(t.calendar), "pos")
    return report(d)


@query("q4_liquidity_ic", "SELECT factor, CASE WHEN date < DATE '1995-01-01' THEN 'early' ELSE 'late' END AS era, count(*) AS n, avg(ic) AS mean_ic FROM li GROUP BY 1, 2", "mean_ic", extra=LONG)
def q4(t):
    ic = X.rank_ic(long_scores(t), "v", "fwd", ("factor", "date")).withColumn("era", F.when(F.col("date") < "1995-01-01", "early").otherwise("late"))
    return ic.groupBy("factor", "era").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"))


@query("q7_sector_neutral", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | book_sql("SELECT 'a' AS variant, date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY nv DESC, code) AS p FROM (SELECT ms.date, ms.code, round(CASE WHEN bucket IS NULL THEN ey ELSE ey - avg(ey) OVER (PARTITION BY ms.date, bucket) END, 12) AS nv FROM ms JOIN industry ON industry.code = ms.code) a WHERE nv IS NOT NULL) b WHERE p <= 5", MONTHLY))
def q7(t):
    s = month_scores(t).join(F.broadcast(t.industry), "code").withColumn("nv", F.round(X.sector_demean("ey", "bucket"), 12))
    return report(book(t, s, "nv"))


def cap_sql(raw: str, cap: float = 0.25) -> dict[str, str]:
    """wc: the weights w of raw (date, code, w) with the cap, what is cut being spread pro rata."""
    return {
        "wx": raw,
        "wo": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, code) - 1 AS k, count(*) OVER (PARTITION BY date) AS n, sum(w) OVER (PARTITION BY date ORDER BY w DESC, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM wx",
        "wg": f"SELECT *, min(CASE WHEN w*(1 - k*{cap})/s <= {cap} + 1e-12 THEN k END) OVER (PARTITION BY date) AS big FROM wo",
        "wc": f"SELECT date, code, CASE WHEN n*{cap} < 1 THEN w WHEN k < big THEN {cap} ELSE w*(1 - big*{cap})/rest END AS w FROM (SELECT *, max(CASE WHEN k = big THEN s END) OVER (PARTITION BY date) AS rest FROM wg) x",
    }


SIZED = cap_sql("SELECT date, code, i / sum(i) OVER (PARTITION BY date) AS w FROM (SELECT s.date, s.code, coalesce(1/coalesce(sg, md), 1.0) AS i FROM sz s JOIN (SELECT date, quantile_cont(sg, 0.5) AS md FROM sz GROUP BY date) m ON m.date = s.date) a") | {
    "sg60": "SELECT date, code, CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w END AS sigma FROM rets WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "sz": "SELECT x.date, x.code, CASE WHEN sigma >= 0.0001 THEN sigma END AS sg FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey DESC, code) AS p FROM ms WHERE ey IS NOT NULL) x LEFT JOIN sg60 g ON g.date = x.date AND g.code = x.code WHERE p <= 5",
}


@query("q8_position_sizing", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | SIZED | book_sql("SELECT 'a' AS variant, date, code, w FROM wc", MONTHLY, weight="w"))
def q8(t):
    sig = rets(t).withColumn("sigma", W.trailing(F.stddev_samp, "ret", 60, 2)).select("date", "code", "sigma")
    s = month_scores(t).withColumn("p", X.place("ey")).where("p <= 5").join(sig, ["date", "code"], "left")
    return report(book(t, X.weight_cap(X.inverse_vol_weights(s)), "ey", 5, "w"))


@query("q9_regime_filter", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | {
    "rg": "SELECT date, CASE WHEN count(*) OVER w >= 60 AND close < avg(close) OVER w THEN 0.0 ELSE 1.0 END AS x FROM index_series WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
} | book_sql("SELECT 'a' AS variant, a.date, code, x/5 AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey DESC, code) AS p FROM ms WHERE ey IS NOT NULL) a JOIN rg ON rg.date = a.date WHERE p <= 5", MONTHLY, weight="w"))
def q9(t):
    w = Window.partitionBy("series_id").orderBy("date")
    e = t.index_series.select("date", F.coalesce(W.moving_average_regime("close", 60, w), F.lit(1.0)).alias("x"))
    s = month_scores(t).join(F.broadcast(e), "date").withColumn("w", F.col("x") / 5)
    return report(book(t, s, "ey", 5, "w"))


@query("q12_survivorship", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | {
    "lastm": "SELECT code FROM membership WHERE snap_date = (SELECT max(snap_date) FROM membership)",
} | book_sql(
    "SELECT variant, date, code FROM (SELECT variant, date, code, row_number() OVER (PARTITION BY variant, date ORDER BY mom DESC, code) AS p FROM (SELECT 'biased' AS variant, s.date, s.code, mom FROM scored s JOIN month_ends USING (date) JOIN lastm l ON l.code = s.code UNION ALL SELECT 'pit' AS variant, date, code, mom FROM ms) a WHERE mom IS NOT NULL) b WHERE p <= 5",
    "SELECT variant, date FROM month_ends, (VALUES ('biased'), ('pit')) v(variant)"))
def q12(t):
    last = t.membership.agg(F.max("snap_date").alias("snap_date"))
    biased = t.membership.join(F.broadcast(last), "snap_date").select("code")
    s = rets(t).withColumn("mom", W.trailing_return("close", 5)).join(F.broadcast(t.month_ends), "date")
    a = book(t, s.join(biased, "code"), "mom").withColumn("variant", F.lit("biased"))
    b = book(t, s.join(membership_asof(t.month_ends, t.membership), ["date", "code"]), "mom").withColumn("variant", F.lit("pit"))
    return report(a.unionByName(b))


@query("q15_oos_decay")
def q15(t):
    ic = X.rank_ic(blended(t), "score", "fwd").withColumn("era", F.when(F.year("date") <= 1994, "early").otherwise("late"))
    w = A.window_inference(ic, "ic", ("era",))
    return w.select("era", "n", *(F.round(c, 5).alias(c) for c in ("mean", "t", "p", "lo", "hi", "hit")))


@query("q15_composite_ic", "SELECT date, corr(a, b) AS ic FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1)/2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1)/2.0 AS b FROM (SELECT date, round(score, 9) AS score, fwd FROM zz WHERE score IS NOT NULL AND fwd IS NOT NULL) z) y GROUP BY date HAVING count(*) >= 5", "ic", extra=SCORES | Z)
def q15b(t):
    return X.rank_ic(blended(t).withColumn("score", F.round("score", 9)), "score", "fwd").select("date", "ic")


@query("q17_index_effect", "SELECT change, count(*) AS n FROM (SELECT s.next_snap, m.code, 'delete' AS change FROM membership m JOIN snapshots s ON s.snap_date = m.snap_date WHERE s.next_snap IS NOT NULL AND NOT EXISTS (SELECT 1 FROM membership x WHERE x.snap_date = s.next_snap AND x.code = m.code) UNION ALL SELECT m.snap_date, m.code, 'add' AS change FROM membership m JOIN snapshots s ON s.next_snap = m.snap_date WHERE NOT EXISTS (SELECT 1 FROM membership x WHERE x.snap_date = s.snap_date AND x.code = m.code)) z GROUP BY change")
def q17(t):
    return X.snapshot_changes(t.membership).groupBy("change").agg(F.count("*").alias("n"))


ROTATION = SCORES | {
    "pk": "SELECT c.pos, x.code AS pick FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS r FROM ms WHERE mom IS NOT NULL) x JOIN calendar c ON c.date = x.date WHERE r = 1",
    "rh": "SELECT c.pos, max_by(p.pick, p.pos) AS held FROM calendar c LEFT JOIN pk p ON p.pos + 2 <= c.pos GROUP BY c.pos",
    "vl": "SELECT 'a' AS variant, pos, net, sum(ln(1 + net)) OVER (ORDER BY pos) AS lw FROM (SELECT h.pos, coalesce(r.ret, 0) - CASE WHEN held <> lag(held) OVER (ORDER BY h.pos) THEN 0.0015 ELSE 0.0 END AS net FROM rh h LEFT JOIN rets r ON r.code = h.held AND r.pos = h.pos) x",
    "vp": book_sql("", "")["vp"],
}


@query("q18_index_rotation", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=ROTATION)
def q18(t):
    picks = X.argmax_asset(month_scores(t), "mom")
    d = B.rotation(picks, rets(t), t.calendar).join(F.broadcast(t.calendar), "pos").withColumn("variant", F.lit("a"))
    return report(d)


@query("q20_quality_value", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | {
    "qm": "SELECT code, pub_date, CASE WHEN count(roe) OVER w >= 2 THEN min(roe) OVER w END AS m FROM annual_reports WINDOW w AS (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
} | book_sql("SELECT 'a' AS variant, date, code FROM (SELECT s.date, s.code, row_number() OVER (PARTITION BY s.date ORDER BY ey DESC, s.code) AS p FROM ms s ASOF JOIN qm r ON r.code = s.code AND r.pub_date <= s.date WHERE m > 0.11 AND ey IS NOT NULL) a WHERE p <= 8", MONTHLY))
def q20(t):
    f = Window.partitionBy("code").orderBy("pub_date").rowsBetween(-2, 0)
    from panelspark.operators.asof import report_asof

    r = t.annual_reports.withColumn("m", F.when(F.count("roe").over(f) >= 2, F.min("roe").over(f))).select("code", "pub_date", "stat_date", "m")
    s = report_asof(month_scores(t), r, "m").where("m > 0.11 and ey is not null")
    return report(book(t, s, "ey", 8))


@query("q23_box_trading", "SELECT code, count(*) AS days, sum(CASE WHEN target = 1.0 THEN 1 ELSE 0 END) AS full_days FROM boxt GROUP BY code".replace("sum(CASE WHEN target = 1.0 THEN 1 ELSE 0 END)", "count(*) FILTER (target = 1.0)"), extra=BOX)
def q23(t):
    return boxed(t).groupBy("code").agg(F.count("*").alias("days"), F.count_if(F.col("target") == 1.0).alias("full_days"))


@query("q24_margin_timing", "SELECT variant AS series_id, log_wealth, max_drawdown, sharpe, ann_mean FROM vp", SUMMARY, extra=REV | {
    "vl": "SELECT series_id AS variant, pos, net, sum(ln(1 + net)) OVER (PARTITION BY series_id ORDER BY pos) AS lw FROM (SELECT series_id, pos, p2 * coalesce(r, 0) - CASE WHEN p1 - p2 > 0 THEN (p1 - p2) * 0.001 ELSE (p2 - p1) * 0.002 END AS net FROM (SELECT *, coalesce(lag(state, 1) OVER w, 0) AS p1, coalesce(lag(state, 2) OVER w, 0) AS p2, x / lag(x) OVER w - 1 AS r FROM rs WINDOW w AS (PARTITION BY series_id ORDER BY pos)) a) b",
    "vp": book_sql("", "")["vp"],
})
def q24(t):
    d = W.threshold_reversal_state(series(t)).withColumn("r", F.col("x") / F.lag("x").over(Window.partitionBy("series_id").orderBy("pos")) - 1)
    return report(W.lagged_position_cost(d, "state", "r", *RATES), "net", ("series_id",))


@query("q26_sector_creed", "SELECT series_id, count(*) AS episodes, count(recovered) AS recovered, avg(terminal) AS terminal, avg(lump) AS lump FROM (SELECT series_id, pos, max_by(v, row) AS terminal, max_by(close, row)/any_value(c0) AS lump, min(CASE WHEN row > pos AND v >= 1 THEN row - pos END) AS recovered FROM lv GROUP BY series_id, pos) x GROUP BY series_id", "terminal lump", extra=LAD)
def q26(t):
    from panelspark.queries.events import e9

    return e9(t).groupBy("series_id").agg(F.count("*").alias("episodes"), F.count("recovered").alias("recovered"), F.avg("terminal").alias("terminal"), F.avg("lump").alias("lump"))


@query("q30_dividend_hold", "SELECT q, count(*) AS n, avg(fwd) AS fwd FROM (SELECT fwd, CASE WHEN n >= 5 THEN greatest(0, CAST(ceil(r*5.0/greatest(n - 1, 1)) AS INT) - 1) END AS q FROM (SELECT s.fwd, row_number() OVER (PARTITION BY s.date ORDER BY y, s.code) - 1 AS r, count(*) OVER (PARTITION BY s.date) AS n FROM ms s JOIN yd ON yd.date = s.date AND yd.code = s.code WHERE y IS NOT NULL) a) b GROUP BY q", "fwd", extra=SCORES | {
    "yd": "SELECT x.code, x.date, sum(dps) / x.close AS y FROM bars x JOIN dividends d ON d.code = x.code AND d.ex_date > x.date - INTERVAL 365 DAY AND d.ex_date <= x.date GROUP BY x.code, x.date, x.close",
})
def q30(t):
    from panelspark.queries.joins import w23

    y = w23(t)
    s = month_scores(t).join(y, ["date", "code"]).where("y is not null").withColumn("q", X.quantile_bin("y", 5))
    return s.groupBy("q").agg(F.count("*").alias("n"), F.avg("fwd").alias("fwd"))


def drift_sql(events: str) -> dict[str, str]:
    """dv: abnormal returns 20 and 60 rows on from the row after each publication. events: (code, pub_date)."""
    return ABN | {
        "de": events,
        "dp": "SELECT e.code, e.pub_date, min(c.pos) AS entry_pos FROM (SELECT *, row_number() OVER (ORDER BY code, pub_date) AS id FROM de) e JOIN calendar c ON c.date > e.pub_date GROUP BY e.id, e.code, e.pub_date",
        "dv": "SELECT h.horizon, n.pub_date, b.s - a.s AS car FROM dp n CROSS JOIN (VALUES (20), (60)) h(horizon) JOIN pf a ON a.code = n.code AND a.pos = n.entry_pos JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos + h.horizon",
    }


DRIFT = "SELECT horizon, count(*) AS n, avg(car) AS mean, quantile_cont(car, 0.5) AS median, avg(car)/(stddev_samp(car)/sqrt(count(*))) AS t_event, avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) AS share FROM dv GROUP BY horizon"
SURGE = "SELECT code, CAST(stat_date + 30 AS DATE) AS pub_date FROM (SELECT *, lag(holders) OVER w AS prev, lag(stat_date) OVER w AS ps FROM holders WINDOW w AS (PARTITION BY code ORDER BY stat_date)) x WHERE prev > 0 AND holders / prev - 1 >= 0.2 AND stat_date - ps <= 120"


@query("q31_holder_surge", f"SELECT d.*, t_month FROM ({DRIFT}) d JOIN (SELECT horizon, avg(m)/(stddev_samp(m)/sqrt(count(*))) AS t_month FROM (SELECT horizon, date_trunc('month', pub_date) AS k, avg(car) AS m FROM dv GROUP BY 1, 2) x GROUP BY horizon) t USING (horizon)", "mean median t_event share t_month", extra=drift_sql(SURGE))
def q31(t):
    from panelspark.operators import events as E
    from panelspark.operators.asof import next_trading_row
    from panelspark.queries.events import abnormal
    from panelspark.queries.joins import w24

    ev = next_trading_row(w24(t).withColumn("pub_date", F.date_add("stat_date", 30)), t.calendar, "pub_date")
    c = E.event_cars(ev, abnormal(t), [20, 60]).withColumn("date", F.col("pub_date"))
    return A.event_summary(c, "car", ("horizon",)).select("horizon", "n", "mean", "median", "t_event", "share", "t_month")
