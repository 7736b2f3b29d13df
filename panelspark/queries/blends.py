"""Studies of factors and books by variant: five factors, legs added to value, cadence, universe, regime, survivorship."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import membership_asof
from panelspark.operators.order import correlations
from panelspark.plans import ml
from panelspark.queries import query
from panelspark.queries.books import RATES, SUMMARY, SUMMED, book_sql, summary
from panelspark.queries.factors import SCORES, month_scores, rets
from panelspark.queries.grids import WINDOW_SQL, windows
from panelspark.queries.live import FACTORS, FIVE, five_factors

SMALL = (0.004, 0.005)


@query("q1_five_factors", "SELECT strategy, count(ic) AS months, avg(ic) AS mean_ic, avg(ic)/stddev_samp(ic) AS ir, avg(ic)/stddev_samp(ic)*sqrt(count(ic)) AS t, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) AS hit, avg(excess) AS excess, avg(spread) AS spread FROM monthly GROUP BY strategy", "mean_ic ir t hit excess spread", extra={k: v for k, v in FIVE.items() if k != "oos"} | {
    "oos": "SELECT strategy, date, code, v, fwd - avg(fwd) OVER (PARTITION BY strategy, date) AS fwd FROM whole",
})
def q1_five(t):
    """Five factors over all months: rank correlation, what the best five names bring, best fifth less worst."""
    d = ml.build_dataset(five_factors(t), list(FACTORS))
    tall = d.select("date", "code", "fwd", F.explode(F.array(*(F.struct(F.lit(f).alias("strategy"), F.round(f, 9).alias("v")) for f in FACTORS))).alias("x")).select("x.strategy", "date", "code", "x.v", "fwd")
    return ml.evaluated(tall)


# Legs added to value

LEGS = ("ep", "turn_vol", "low_turn", "small")
LEG_SQL = {
    "lgf": "SELECT date, code, CASE WHEN pe_ttm > 0 THEN 1/pe_ttm END AS ep, CASE WHEN count(CASE WHEN turn > 0 THEN turn END) OVER w >= 10 THEN -stddev_samp(CASE WHEN turn > 0 THEN turn END) OVER w END AS turn_vol, CASE WHEN count(CASE WHEN turn > 0 THEN turn END) OVER w >= 10 THEN -avg(CASE WHEN turn > 0 THEN turn END) OVER w END AS low_turn, -amount AS small, close FROM dense WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "lgm": "SELECT x.date, x.code, ep, turn_vol, low_turn, small, fwd, m.code IS NOT NULL AS inm FROM (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS fwd FROM lgf JOIN month_ends USING (date)) x LEFT JOIN members m ON m.date = x.date AND m.code = x.code",
    "lgt": "SELECT date, code, fwd, inm, f, v FROM (SELECT date, code, fwd, inm, ep, turn_vol, low_turn, small FROM lgm) UNPIVOT INCLUDE NULLS (v FOR f IN (ep, turn_vol, low_turn, small))",
    "lgc": "SELECT date, f, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM lgt WHERE inm GROUP BY date, f",
    "lgw": "SELECT t.date, t.code, t.f, CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END AS c FROM lgt t JOIN lgc ON lgc.date = t.date AND lgc.f = t.f WHERE inm",
    "lgz": "SELECT date, code, f, CASE WHEN stddev_samp(c) OVER w > 1e-9 * abs(avg(c) OVER w) THEN (c - avg(c) OVER w) / stddev_samp(c) OVER w END AS z FROM lgw WINDOW w AS (PARTITION BY date, f)",
}


def leg_months(t) -> DataFrame:
    """(date, code, four legs, fwd, inm) at month ends, of all names."""
    w = Window.partitionBy("code").orderBy("date")
    d = W.densify_panel(t.bars, t.calendar, t.codes).withColumns({"ep": S.inverse_positive("pe_ttm"), "turn_vol": W.low_turnover_vol(), "low_turn": W.low_turnover(), "small": -F.col("amount")})
    d = d.join(F.broadcast(t.month_ends), "date").withColumn("fwd", F.lead("close").over(w) / F.col("close") - 1)
    members = membership_asof(t.month_ends, t.membership).select("date", "code", F.lit(True).alias("inm"))
    return d.join(members, ["date", "code"], "left").select("date", "code", *LEGS, "fwd", F.coalesce("inm", F.lit(False)).alias("inm"))


def leg_scores(t) -> DataFrame:
    """(date, code, z of each leg) of members."""
    d = leg_months(t).where("inm")
    for f in LEGS:
        d = X.standardize(d, f, f"z_{f}")
    return d.select("date", "code", *(f"z_{f}" for f in LEGS))


def blend_sql(name: str, variants: list, leg: str, rates: bool = False) -> dict[str, str]:
    """Books of the five best by value and a weighted further leg. variants: (variant, weight, buy, sell)."""
    table = "(VALUES " + ", ".join(f"('{v}', {w}, {x}, {y})" for v, w, x, y in variants) + ") v(variant, w, buy, sell)"
    books = book_sql(
        f"SELECT variant, date, code FROM (SELECT variant, date, code, row_number() OVER (PARTITION BY variant, date ORDER BY sc DESC, code) AS p FROM (SELECT variant, a.date, a.code, CASE WHEN a.z IS NULL AND (w = 0 OR b.z IS NULL) THEN NULL ELSE round((coalesce(a.z, 0) + w*coalesce(b.z, 0)) / (CASE WHEN a.z IS NULL THEN 0 ELSE 1 END + CASE WHEN b.z IS NULL THEN 0 ELSE w END), 9) END AS sc FROM lgz a JOIN lgz b ON b.date = a.date AND b.code = a.code, {table} WHERE a.f = 'ep' AND b.f = '{leg}') x WHERE sc IS NOT NULL) y WHERE p <= 5",
        f"SELECT variant, date FROM month_ends, {table}")
    books["vb"] = f"SELECT k.variant, k.exec_pos, coalesce(sum(CASE WHEN dw > 0 THEN dw*buy ELSE -dw*sell END), 0) AS cost FROM vk k JOIN {table} ON v.variant = k.variant LEFT JOIN vd d ON d.variant = k.variant AND d.block = k.block GROUP BY k.variant, k.exec_pos"
    return LEG_SQL | books


def blended_books(t, variants: list, leg: str) -> DataFrame:
    v = t.spark.createDataFrame([(n, float(w), x, y) for n, w, x, y in variants], "variant string, w double, buy double, sell double")
    d = leg_scores(t).crossJoin(F.broadcast(v))
    a, b = F.col("z_ep"), F.col(f"z_{leg}")
    weight = F.when(a.isNotNull(), 1.0).otherwise(0.0) + F.when(b.isNotNull(), F.col("w")).otherwise(0.0)
    d = d.withColumn("sc", F.round(F.when(weight > 0, (F.coalesce(a, F.lit(0.0)) + F.col("w") * F.coalesce(b, F.lit(0.0))) / weight), 9))
    m = d.withColumn("p", X.place("sc", True, ("variant", "date"))).where("p <= 5").select("variant", "date", "code")
    return summary(B.ew_portfolio(m, t.month_ends.crossJoin(F.broadcast(v.select("variant"))), rets(t), t.calendar, v.select("variant", "buy", "sell"))[0].join(F.broadcast(t.calendar), "pos"))


STABLE = [(f"w{w}", w, *RATES) for w in (0, 0.25, 0.5, 1, 2)]
SIZED = [(f"w{w} {tier}", w, *cost) for w in (0, 0.25, 0.5, 1) for tier, cost in (("large", RATES), ("small", SMALL))]


@query("q3_leg_weights", f"SELECT {SUMMED}, sharpe > (SELECT sharpe FROM vp WHERE variant = 'w0') AND max_drawdown >= (SELECT max_drawdown FROM vp WHERE variant = 'w0') AS adopted FROM vp", SUMMARY, extra=blend_sql("q3", STABLE, "turn_vol"))
def q3(t):
    """Stable turnover beside value at five weights; a weight is adopted if it is better in return for its risk and in drawdown."""
    d = blended_books(t, STABLE, "turn_vol")
    base = d.where("variant = 'w0'").select(F.col("sharpe").alias("s0"), F.col("max_drawdown").alias("d0"))
    d = d.crossJoin(F.broadcast(base))  # one row
    return d.withColumn("adopted", (F.col("sharpe") > F.col("s0")) & (F.col("max_drawdown") >= F.col("d0"))).drop("s0", "d0")


@query("q6_size_blends", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=blend_sql("q6", SIZED, "small"))
def q6(t):
    """A tilt to small names beside value, at the costs of two account sizes."""
    return blended_books(t, SIZED, "small")


LIQUID = LEG_SQL | {
    "lqu": "SELECT 'members' AS universe, date, code, f, v, fwd FROM lgt WHERE inm UNION ALL SELECT 'all' AS universe, date, code, f, v, fwd FROM lgt",
    "lqk": "SELECT universe, f, date, rank() OVER (PARTITION BY universe, f, date ORDER BY v) + (count(*) OVER (PARTITION BY universe, f, date, v) - 1)/2.0 AS a, rank() OVER (PARTITION BY universe, f, date ORDER BY fwd) + (count(*) OVER (PARTITION BY universe, f, date, fwd) - 1)/2.0 AS b FROM lqu WHERE v IS NOT NULL AND fwd IS NOT NULL",
    "lqi": "SELECT universe, f, date, round(corr(a, b), 9) AS x FROM lqk GROUP BY universe, f, date HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL",
}


def liquid_ic(t) -> DataFrame:
    d = leg_months(t)
    tall = d.select("date", "code", "fwd", F.explode(F.filter(F.array(F.lit("all"), F.when(F.col("inm"), "members")), lambda x: x.isNotNull())).alias("universe"), *LEGS)
    tall = tall.select("universe", "date", "code", "fwd", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in LEGS))).alias("x")).select("universe", "x.f", "date", "code", "x.v", "fwd")
    return X.rank_ic(tall, "v", "fwd", ("universe", "f", "date")).select("universe", "f", "date", F.round("ic", 9).alias("x"))


@query("q4_universes", f"SELECT *, coalesce(t >= 2, false) AS passes FROM (SELECT universe, f, label, count(*) AS n, avg(x) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(x) >= 1e-12 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END AS t, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM lqi JOIN {WINDOW_SQL} ON date BETWEEN lo AND hi WHERE label IN ('full', 'early', 'late') GROUP BY universe, f, label) z", "mean t hit", extra=LIQUID)
def q4(t):
    """Liquidity factors on members and on all names, whole and by half, and which pass t of 2."""
    d = A.in_windows(liquid_ic(t), "x", windows(t).where("label in ('full', 'early', 'late')"), ("universe", "f"))
    return d.withColumn("passes", F.coalesce(F.col("t") >= 2, F.lit(False)))


@query("q4_correlation", "SELECT a.f AS x, b.f AS y, count(*) AS n, corr(a.x, b.x) AS c FROM lqi a JOIN lqi b ON a.date = b.date AND a.f < b.f WHERE a.universe = 'members' AND b.universe = 'members' GROUP BY a.f, b.f HAVING count(*) >= 2", "c", extra=LIQUID)
def q4_corr(t):
    """How the liquidity factors' months go with those of value."""
    return correlations(liquid_ic(t).where("universe = 'members'"), "x", "date", "f")


# Cadence, universe, survivorship

CADENCES = [(f"{c} {u} top{n}", c, u, n) for c in ("W", "M", "Q") for u in ("members", "all") for n in (5, 10)]
CADENCE_SQL = "(VALUES " + ", ".join(f"('{v}', '{c}', '{u}', {n})" for v, c, u, n in CADENCES) + ") v(variant, cadence, universe, n)"
CADENCE = {
    "cds": "SELECT 'W' AS cadence, max(date) AS date FROM calendar GROUP BY date_trunc('week', date) UNION ALL SELECT 'M' AS cadence, date FROM month_ends UNION ALL SELECT 'Q' AS cadence, date FROM month_ends WHERE quarter(date) * 3 = month(date)",
    "cdu": "SELECT d.date, d.code, 1/pe_ttm AS ey, m.code IS NOT NULL AS inm FROM dense d LEFT JOIN members m ON m.date = d.date AND m.code = d.code WHERE pe_ttm > 0",
    "cdp": f"SELECT variant, n, s.date, u.code, row_number() OVER (PARTITION BY variant, s.date ORDER BY ey DESC, u.code) AS p FROM cds s JOIN {CADENCE_SQL} ON v.cadence = s.cadence JOIN cdu u ON u.date = s.date AND (universe = 'all' OR inm)",
}


@query("q10_cadences", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=CADENCE | book_sql("SELECT variant, date, code FROM cdp WHERE p <= n", f"SELECT variant, date FROM cds s JOIN {CADENCE_SQL} ON v.cadence = s.cadence"))
def q10(t):
    """Weekly, monthly and quarterly books, of members and of all names, of five and ten of them."""
    m = t.month_ends
    at = t.calendar.groupBy(F.date_trunc("week", "date").alias("__w")).agg(F.max("date").alias("date")).select(F.lit("W").alias("cadence"), "date")
    at = at.unionByName(m.select(F.lit("M").alias("cadence"), "date")).unionByName(m.where(F.quarter("date") * 3 == F.month("date")).select(F.lit("Q").alias("cadence"), "date"))
    v = t.spark.createDataFrame(CADENCES, "variant string, cadence string, universe string, n int")
    sig = at.join(F.broadcast(v), "cadence")
    members = membership_asof(t.calendar.select("date"), t.membership).select("date", "code", F.lit(True).alias("inm"))
    d = t.bars.where("pe_ttm > 0").select("date", "code", (1 / F.col("pe_ttm")).alias("ey")).join(members, ["date", "code"], "left")
    d = d.join(F.broadcast(sig), "date").where("universe = 'all' or inm").withColumn("p", X.place("ey", True, ("variant", "date"))).where(F.col("p") <= F.col("n"))
    return summary(B.ew_portfolio(d.select("variant", "date", "code"), sig.select("variant", "date"), rets(t), t.calendar, RATES)[0].join(F.broadcast(t.calendar), "pos"))


SURVIVORS = [(f"{u} top{n} {tier}", u, n, *cost) for u in ("biased", "pit") for n in (3, 5) for tier, cost in (("large", RATES), ("small", SMALL))]
SURVIVOR_SQL = "(VALUES " + ", ".join(f"('{v}', '{u}', {n}, {x}, {y})" for v, u, n, x, y in SURVIVORS) + ") v(variant, universe, n, buy, sell)"


def survivor_sql() -> dict[str, str]:
    books = book_sql(f"SELECT variant, date, code FROM (SELECT variant, n, a.date, a.code, row_number() OVER (PARTITION BY variant, a.date ORDER BY mom DESC, a.code) AS p FROM svu a JOIN {SURVIVOR_SQL} ON v.universe = a.universe WHERE mom IS NOT NULL) x WHERE p <= n", f"SELECT variant, date FROM month_ends, {SURVIVOR_SQL}")
    books["vb"] = f"SELECT k.variant, k.exec_pos, coalesce(sum(CASE WHEN dw > 0 THEN dw*buy ELSE -dw*sell END), 0) AS cost FROM vk k JOIN {SURVIVOR_SQL} ON v.variant = k.variant LEFT JOIN vd d ON d.variant = k.variant AND d.block = k.block GROUP BY k.variant, k.exec_pos"
    return SCORES | books | {
        "lastm": "SELECT code FROM membership WHERE snap_date = (SELECT max(snap_date) FROM membership)",
        "svu": "SELECT 'biased' AS universe, s.date, s.code, mom FROM scored s JOIN month_ends USING (date) JOIN lastm l ON l.code = s.code UNION ALL SELECT 'pit' AS universe, date, code, mom FROM ms",
    }


@query("q12_tiers", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=survivor_sql())
def q12(t):
    """Today's members over all history against those of each date, by number of names and account size."""
    last = t.membership.agg(F.max("snap_date").alias("snap_date"))
    biased = t.membership.join(F.broadcast(last), "snap_date").select("code")
    s = rets(t).withColumn("mom", W.trailing_return("close", 5)).join(F.broadcast(t.month_ends), "date")
    both = s.join(biased, "code").select(F.lit("biased").alias("universe"), "date", "code", "mom").unionByName(month_scores(t).select(F.lit("pit").alias("universe"), "date", "code", "mom"))
    v = t.spark.createDataFrame(SURVIVORS, "variant string, universe string, n int, buy double, sell double")
    d = both.where("mom is not null").join(F.broadcast(v), "universe").withColumn("p", X.place("mom", True, ("variant", "date"))).where(F.col("p") <= F.col("n"))
    return summary(B.ew_portfolio(d.select("variant", "date", "code"), t.month_ends.crossJoin(F.broadcast(v.select("variant"))), rets(t), t.calendar, v.select("variant", "buy", "sell"))[0].join(F.broadcast(t.calendar), "pos"))


# Regimes

REGIMES = ("base", "ma100", "ma200")


@query("q9_b9_regimes", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | {
    "rgm": "SELECT 'base' AS variant, date, 1.0 AS x FROM index_series UNION ALL SELECT 'ma100' AS variant, date, CASE WHEN count(*) OVER w >= 100 AND close < avg(close) OVER w THEN 0.0 ELSE 1.0 END AS x FROM index_series WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) UNION ALL SELECT 'ma200' AS variant, date, CASE WHEN count(*) OVER w >= 200 AND close < avg(close) OVER w THEN 0.0 ELSE 1.0 END AS x FROM index_series WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
} | book_sql("SELECT variant, a.date, code, x/5 AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey DESC, code) AS p FROM ms WHERE ey IS NOT NULL) a JOIN rgm ON rgm.date = a.date WHERE p <= 5", "SELECT variant, date FROM month_ends, (VALUES ('base'), ('ma100'), ('ma200')) v(variant)", weight="w"))
def q9(t):
    """The value book whole, and in cash while the index is below its mean of 100 or 200 rows."""
    w = Window.partitionBy("series_id").orderBy("date")
    e = t.index_series.withColumns({f"ma{n}": F.coalesce(W.moving_average_regime("close", n, w), F.lit(1.0)) for n in (100, 200)}).withColumn("base", F.lit(1.0))
    e = e.select("date", F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("x")) for v in REGIMES))).alias("s")).select("date", "s.variant", "s.x")
    d = month_scores(t).withColumn("p", X.place("ey")).where("p <= 5").select("date", "code").join(F.broadcast(e), "date").select("variant", "date", "code", (F.col("x") / 5).alias("w"))
    sig = t.month_ends.crossJoin(F.broadcast(t.spark.createDataFrame([(v,) for v in REGIMES], "variant string")))
    return summary(B.ew_portfolio(d, sig, rets(t), t.calendar, RATES, weight="w")[0].join(F.broadcast(t.calendar), "pos"))
