"""Scalars, windows along time and operators across securities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions import scalars as S
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import membership_asof
from panelspark.operators.order import sliding_quantiles
from panelspark.queries import query

CODES = "code, date"


def rets(t):
    return W.densify_panel(t.bars, t.calendar, t.codes).withColumn("ret", W.daily_return())


def month_scores(t):
    """Month-end members with two factor scores and the return to the next month end."""
    w = Window.partitionBy("code").orderBy("date")
    d = rets(t).withColumn("mom", W.trailing_return("close", 5)).withColumn("ey", S.inverse_positive("pe_ttm"))
    m = d.join(F.broadcast(t.month_ends), "date").withColumn("fwd", F.lead("close").over(w) / F.col("close") - 1)
    return m.join(membership_asof(t.month_ends, t.membership), ["date", "code"]).select("date", "code", "mom", "ey", "fwd", "turn", "amount")


SCORES = {
    "scored": "SELECT date, code, close / lag(close, 5) OVER (PARTITION BY code ORDER BY pos) - 1 AS mom, CASE WHEN pe_ttm > 0 THEN 1/pe_ttm END AS ey, close, turn, amount FROM dense",
    "ms": "SELECT s.date, s.code, mom, ey, fwd, turn, amount FROM (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS fwd FROM scored JOIN month_ends USING (date)) s JOIN members m ON m.date = s.date AND m.code = s.code",
}


@query("p1_densify_panel", "SELECT code, count(*) AS days, count(close) AS traded FROM dense GROUP BY code")
def p1(t):
    return W.densify_panel(t.bars, t.calendar, t.codes).groupBy("code").agg(F.count("*").alias("days"), F.count("close").alias("traded"))


@query("p2_pivot_panel", "SELECT date, max(CASE WHEN code LIKE 'sh%' THEN close END) AS sh, max(CASE WHEN code LIKE 'sz%' THEN close END) AS sz FROM bars GROUP BY date", "sh sz")
def p2(t):
    return t.bars.withColumn("ex", F.substr("code", F.lit(1), F.lit(2))).groupBy("date").pivot("ex", ["sh", "sz"]).agg(F.max("close"))


@query("p3_p4_board_limit", "SELECT code, date, CASE WHEN split_part(code,'.',2) LIKE '688%' THEN 'STAR' WHEN split_part(code,'.',2) LIKE '300%' OR split_part(code,'.',2) LIKE '301%' THEN 'ChiNext' ELSE 'Main' END AS board, CASE WHEN split_part(code,'.',2) LIKE '688%' THEN 0.2 WHEN (split_part(code,'.',2) LIKE '300%' OR split_part(code,'.',2) LIKE '301%') AND date >= DATE '2020-08-24' THEN 0.2 ELSE 0.1 END AS width FROM bars", "width")
def p3(t):
    return t.bars.select("code", "date", S.board_of("code").alias("board"), S.limit_width("code", "date").alias("width"))


LIMITS = {
    "widths": "SELECT *, CASE WHEN split_part(code,'.',2) LIKE '688%' THEN 0.2 ELSE 0.1 END AS width, lag(close) OVER (PARTITION BY code ORDER BY pos) AS pre FROM dense",
    "flags": "SELECT code, date, pos, close, pre, CASE WHEN close IS NOT NULL THEN CAST(coalesce(close >= round_even(pre*(1+width),2)*(1-0.0005), false) AS INT) - CAST(coalesce(close <= round_even(pre*(1-width),2)*(1+0.0005), false) AS INT) END AS flag FROM widths",
}


def flagged(t):
    d = rets(t).withColumn("pre", F.lag("close").over(W.by_code()))
    return d.withColumn("flag", S.limit_flag("close", "pre", F.when(S.board_of("code") == "STAR", 0.2).otherwise(0.1)))


@query("p5_limit_flags", "SELECT code, flag, count(*) AS n FROM flags GROUP BY code, flag", extra=LIMITS)
def p5(t):
    return flagged(t).groupBy("code", "flag").agg(F.count("*").alias("n"))


@query("p7_code_convert", "SELECT code, split_part(code,'.',2) || '.' || upper(split_part(code,'.',1)) AS ts, split_part(code,'.',2) || CASE WHEN code LIKE 'sh%' THEN '.XSHG' ELSE '.XSHE' END AS rq FROM codes")
def p7(t):
    return t.codes.select("code", S.swap_code("code").alias("ts"), S.swap_code("code", "rq").alias("rq"))


@query("p8_p11_value_size", "SELECT code, date, CASE WHEN pe_ttm > 0 THEN 1/pe_ttm END AS ey, CASE WHEN pb_mrq > 0 THEN 1/pb_mrq END AS bp, CASE WHEN pb_mrq > 0 AND pe_ttm > 0 THEN pb_mrq/pe_ttm END AS roe, CASE WHEN turn > 0 THEN amount/(turn/100)/1e6 END AS cap, CASE WHEN turn > 0 THEN -ln(amount/(turn/100)) END AS small FROM bars", "ey bp roe cap small")
def p8(t):
    cap = S.float_cap("amount", "turn")
    return t.bars.select("code", "date", S.inverse_positive("pe_ttm").alias("ey"), S.inverse_positive("pb_mrq").alias("bp"), S.roe_ratio("pb_mrq", "pe_ttm").alias("roe"), (cap / 1e6).alias("cap"), S.small_size(cap).alias("small"))


@query("p12_fees", "SELECT fill_id, CASE WHEN price*abs(shares) > 0 THEN greatest(price*abs(shares)*0.00025, 5.0) + price*abs(shares)*0.00001 ELSE 0.0 END AS buy, CASE WHEN price*abs(shares) > 0 THEN greatest(price*abs(shares)*0.00025, 5.0) + price*abs(shares)*0.00051 ELSE 0.0 END AS sell FROM fills", "buy sell")
def p12(t):
    """Fees of each fill as a purchase and as a sale; a fill without turnover costs nothing, so the minimum does not apply."""
    turnover, c = F.col("price") * F.abs("shares"), S.CostSpec()
    return t.fills.select("fill_id", c.buy_fee(turnover).alias("buy"), c.sell_fee(turnover).alias("sell"))


@query("p14_lot_target", "SELECT code, date, CAST(floor(1e6*0.1*1.0/(close*1.0005*100))*100 AS BIGINT) AS shares FROM bars")
def p14(t):
    return t.bars.select("code", "date", S.lot_target_shares(F.lit(1e6), F.lit(0.1), F.lit(1.0), "close", 0.0005).alias("shares"))


@query("p15_stop_exit", "SELECT code, date, CASE WHEN open > 0 AND close IS NOT NULL THEN CASE WHEN low <= open*0.9 THEN least(open*0.9, close) WHEN high >= open*1.1 THEN open*1.1 END END AS fill FROM bars", "fill")
def p15(t):
    return t.bars.select("code", "date", S.StopSpec(0.1, 0.1, "intraday").exit_price("open", "close", "low", "high").alias("fill"))


@query("p16_base_eligibility", "SELECT date, count(*) AS n FROM (SELECT d.*, count(close) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM dense d) x JOIN members m ON m.date = x.date AND m.code = x.code WHERE close IS NOT NULL AND NOT coalesce(is_st, false) AND k >= 20 GROUP BY x.date".replace("SELECT date,", "SELECT x.date,"))
def p16(t):
    d = rets(t).withColumn("k", W.prior_traded_days())
    d = d.join(membership_asof(t.calendar, t.membership).select("date", "code"), ["date", "code"])
    return d.where(S.eligible(F.col("close").isNotNull(), ~F.coalesce("is_st", F.lit(False)), F.col("k") >= 20)).groupBy("date").agg(F.count("*").alias("n"))


@query("p17_a24_floor_by_prefix", "SELECT b.code, count(*) AS n FROM bars b JOIN (SELECT substr(code,1,2) AS ex, quantile_cont(amount, 0.1) AS floor FROM bars GROUP BY 1) f ON f.ex = substr(b.code,1,2) WHERE amount >= floor GROUP BY b.code")
def p17(t):
    b = t.bars.withColumn("ex", F.substr("code", F.lit(1), F.lit(2)))
    floors = b.groupBy("ex").agg(F.percentile("amount", F.lit(0.1)).alias("floor"))
    return b.join(F.broadcast(floors), "ex").where("amount >= floor").groupBy("code").agg(F.count("*").alias("n"))


@query("p18_double_low", "SELECT code, date, close + pb_mrq AS score FROM bars", "score")
def p18(t):
    return t.bars.select("code", "date", S.double_low(F.col("close"), F.col("pb_mrq")).alias("score"))


@query("p19_era_filter", "SELECT label, count(*) AS n, avg(close) AS mean FROM bars JOIN (VALUES ('early', DATE '1992-01-01', DATE '1994-12-31'), ('late', DATE '1995-01-01', DATE '1998-12-31'), ('all', DATE '1992-01-01', DATE '1998-12-31')) w(label, lo, hi) ON date BETWEEN lo AND hi GROUP BY label", "mean")
def p19(t):
    eras = t.spark.createDataFrame([("early", "1992-01-01", "1994-12-31"), ("late", "1995-01-01", "1998-12-31"), ("all", "1992-01-01", "1998-12-31")], "label string, lo string, hi string")
    e = eras.select("label", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    return t.bars.join(F.broadcast(e), F.col("date").between(F.col("lo"), F.col("hi"))).groupBy("label").agg(F.count("*").alias("n"), F.avg("close").alias("mean"))


@query("p20_abnormal_return", "SELECT code, date, ret - avg(ret) OVER (PARTITION BY date) AS abn FROM rets WHERE ret IS NOT NULL", "abn")
def p20(t):
    return rets(t).where("ret is not null").select("code", "date", X.cross_demean("ret").alias("abn"))


@query("p21_month_end", "SELECT m.date, c.pos + 1 AS exec_pos FROM month_ends m JOIN calendar c ON c.date = m.date WHERE c.pos < (SELECT max(pos) FROM calendar)")
def p21(t):
    last = t.calendar.agg(F.max("pos").alias("last"))
    m = t.calendar.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date"), F.max("pos").alias("pos"))
    return m.crossJoin(F.broadcast(last)).where("pos < last").select("date", (F.col("pos") + 1).cast("long").alias("exec_pos"))


@query("w1_w3_returns", "SELECT code, date, ret, close / lag(close, 5) OVER w - 1 AS r5, lag(close, 2) OVER w / lag(close, 10) OVER w - 1 AS mom FROM rets WINDOW w AS (PARTITION BY code ORDER BY pos)", "ret r5 mom")
def w1(t):
    return rets(t).select("code", "date", "ret", W.trailing_return("close", 5).alias("r5"), W.momentum("close", 10, 2).alias("mom"))


@query("w4_w6_risk_liquidity", "SELECT code, date, CASE WHEN count(ret) OVER w >= 5 THEN -stddev_samp(ret) OVER w END AS low_vol, CASE WHEN count(CASE WHEN turn > 0 THEN turn END) OVER w >= 5 THEN -avg(CASE WHEN turn > 0 THEN turn END) OVER w END AS low_turn, CASE WHEN count(CASE WHEN turn > 0 THEN turn END) OVER w >= 5 THEN -stddev_samp(CASE WHEN turn > 0 THEN turn END) OVER w END AS turn_std, CASE WHEN count(CASE WHEN amount > 0 THEN abs(ret)/amount END) OVER w >= 5 THEN avg(CASE WHEN amount > 0 THEN abs(ret)/amount END) OVER w * 1e6 END AS amihud FROM rets WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "low_vol low_turn turn_std amihud")
def w4(t):
    return rets(t).select("code", "date", W.low_vol("ret", 10, 5).alias("low_vol"), W.low_turnover("turn", 10).alias("low_turn"), W.low_turnover_vol("turn", 10).alias("turn_std"), (W.amihud("ret", "amount", 10) * 1e6).alias("amihud"))


@query("w7_prior_traded", "SELECT code, date, count(close) OVER (PARTITION BY code ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM dense")
def w7(t):
    return rets(t).select("code", "date", W.prior_traded_days().alias("k"))


@query("w8_w9_rolling_quantiles", "SELECT code, date, CASE WHEN count(close*volume) OVER a >= 10 THEN quantile_cont(close*volume, 0.5) OVER a END AS med, CASE WHEN count(pe_ttm) OVER b >= 20 THEN quantile_cont(pe_ttm, 0.7) OVER b END AS q70 FROM dense WINDOW a AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), b AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", "med q70")
def w8(t):
    d = W.densify_panel(t.bars, t.calendar, t.codes).select("code", "date", "pos", (F.col("close") * F.col("volume")).alias("v"), "pe_ttm")
    return sliding_quantiles(d, {"med": ("v", 0.5, 20, 10), "q70": ("pe_ttm", 0.7, 60, 20)}).select("code", "date", "med", "q70")


@query("w10_pe_gates", "SELECT code, date, n >= 20 AS valid, n >= 20 AND coalesce(pe_ttm < 0 OR pe_ttm >= q70, false) AS high, n >= 20 AND coalesce(pe_ttm > 0 AND pe_ttm <= q30, false) AS low FROM (SELECT *, count(pe_ttm) OVER w AS n, quantile_cont(CASE WHEN pe_ttm > 0 THEN pe_ttm END, 0.7) OVER w AS q70, quantile_cont(CASE WHEN pe_ttm > 0 THEN pe_ttm END, 0.3) OVER w AS q30 FROM (SELECT code, date, pos, round(pe_ttm, 4) AS pe_ttm FROM dense) y WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) x")
def w10(t):
    d = W.densify_panel(t.bars, t.calendar, t.codes).select("code", "date", "pos", F.round("pe_ttm", 4).alias("pe_ttm"))
    d = d.withColumn("n", F.count("pe_ttm").over(W.by_code().rowsBetween(-59, 0))).withColumn("own", F.when(F.col("pe_ttm") > 0, F.col("pe_ttm")))
    d = sliding_quantiles(d, {"q70": ("own", 0.7, 60, 1), "q30": ("own", 0.3, 60, 1)})
    ok = F.col("n") >= 20
    return d.select("code", "date", ok.alias("valid"), S.eligible(ok, (F.col("pe_ttm") < 0) | (F.col("pe_ttm") >= F.col("q70"))).alias("high"), S.eligible(ok, (F.col("pe_ttm") > 0) & (F.col("pe_ttm") <= F.col("q30"))).alias("low"))


@query("w11_w12_moving_averages", "SELECT series_id, date, CASE WHEN count(*) OVER s >= 60 THEN CAST(close >= avg(close) OVER s AS INT) + 0.0 END AS regime, CASE WHEN count(*) OVER s >= 60 THEN CAST(avg(close) OVER f > avg(close) OVER s AS INT) END AS cross FROM index_series WINDOW s AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)".replace("AS cross", "AS above"), "regime")
def w11(t):
    w = Window.partitionBy("series_id").orderBy("date")
    return t.index_series.select("series_id", "date", W.moving_average_regime("close", 60, w).alias("regime"), W.double_ma_signal("close", 20, 60, w).alias("above"))


BOX = {
    "boxed": "SELECT *, CASE WHEN count(close) OVER w >= 10 THEN CASE WHEN (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) <= 0.1 THEN 1.0 WHEN (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) >= 0.9 THEN 0.3 END END AS sig FROM rets WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)",
    "boxt": "SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos), 1.0) AS target FROM boxed",
}


def boxed(t):
    return rets(t).withColumn("sig", W.rolling_box("close", 20, least=10)).withColumn("target", W.carried("sig"))


@query("w13_rolling_box", "SELECT code, date, target FROM boxt", "target", extra=BOX)
def w13(t):
    return boxed(t).select("code", "date", "target")


@query("w14_w15_marks_alive", "SELECT code, date, CASE WHEN pos <= hi THEN last_value(close IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos) END AS mark, pos BETWEEN lo AND hi AS alive FROM (SELECT *, min(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY code) AS lo, max(CASE WHEN close IS NOT NULL THEN pos END) OVER (PARTITION BY code) AS hi FROM dense) x", "mark")
def w14(t):
    return rets(t).select("code", "date", W.valuation_mark().alias("mark"), W.alive().alias("alive"))


HOLD = {"hs": "SELECT code, date, pos, CASE WHEN pe_ttm < 0 THEN 0 WHEN coalesce(ret, 0) < -0.2 THEN 1 END AS sig FROM rets"}


@query("w16_state_hold", "SELECT code, date, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos), 0) AS held FROM hs", extra=HOLD)
def w16(t):
    return rets(t).select("code", "date", W.state_hold(F.coalesce("ret", F.lit(0.0)) < -0.2, F.col("pe_ttm") < 0).alias("held"))


REV = {
    "ix": "SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS pos, close AS x FROM index_series",
    "rq": "SELECT *, CASE WHEN count(x) OVER w >= 20 THEN quantile_cont(x, 0.2) OVER w END AS lo, CASE WHEN count(x) OVER w >= 20 THEN quantile_cont(x, 0.8) OVER w END AS hi, x - lag(x, 5) OVER (PARTITION BY series_id ORDER BY pos) AS chg FROM ix WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "ra": "SELECT *, max(CASE WHEN x <= lo THEN pos END) OVER (PARTITION BY series_id ORDER BY pos) AS armed, max(CASE WHEN chg > 0 THEN pos END) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM rq",
    "rs": "SELECT *, coalesce(last_value(CASE WHEN x >= hi THEN 0 WHEN chg > 0 AND armed > coalesce(up, -1) THEN 1 END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos), 0) AS state FROM ra",
}


def series(t):
    return t.index_series.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("date"))).withColumnRenamed("close", "x")


@query("w17_threshold_reversal", "SELECT series_id, date, state FROM rs", extra=REV)
def w17(t):
    return W.threshold_reversal_state(series(t)).select("series_id", "date", "state")


@query("w18_e1_fresh_locks", "SELECT code, date, flag FROM (SELECT *, lag(flag) OVER (PARTITION BY code ORDER BY pos) AS prev FROM flags) x WHERE flag <> 0 AND coalesce(prev, 9) <> flag", extra=LIMITS)
def w18(t):
    d = flagged(t)
    return d.withColumn("up", W.fresh_streak("flag", 1)).withColumn("down", W.fresh_streak("flag", -1)).where("up or down").select("code", "date", "flag")


@query("w19_fresh_mask", "SELECT code, date FROM (SELECT code, date, coalesce(pe_ttm < 0, false) AS m, lag(coalesce(pe_ttm < 0, false), 1, false) OVER (PARTITION BY code ORDER BY pos) AS p FROM dense) x WHERE m AND NOT p")
def w19(t):
    return rets(t).withColumn("f", W.fresh_mask(F.col("pe_ttm") < 0)).where("f").select("code", "date")


EPI = {"ep": "SELECT * FROM (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM (SELECT *, CASE WHEN x <= 0.8*peak THEN 1 WHEN x >= 0.95*peak THEN 0 END AS mark FROM (SELECT *, max(x) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS peak FROM ix) a) b) c WHERE mark = 1 AND prev = 0"}


@query("w20_drawdown_episodes", "SELECT series_id, date, peak FROM ep", "peak", extra=REV | EPI)
def w20(t):
    return W.drawdown_episodes(series(t), "x", 0.2, 100).select("series_id", "date", "peak")


@query("w21_centered_peak", "SELECT series_id, date FROM (SELECT *, count(x) OVER w AS n, max(x) OVER w AS m FROM ix WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)) a WHERE n = 25 AND x = m", extra=REV)
def w21(t):
    return series(t).withColumn("p", W.centered_peak("x", 12, Window.partitionBy("series_id").orderBy("pos"))).where("p").select("series_id", "date")


@query("w28_forward_sum", "SELECT code, date, CASE WHEN count(ret) OVER w >= 3 THEN sum(ret) OVER w END AS fwd FROM rets WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)", "fwd")
def w28(t):
    return rets(t).select("code", "date", W.forward_sum("ret", 10, 3).alias("fwd"))


@query("w30_a6_drawdown", "SELECT series_id, min(d) AS max_drawdown FROM (SELECT series_id, x / max(x) OVER (PARTITION BY series_id ORDER BY pos) - 1 AS d FROM ix) a GROUP BY series_id", "max_drawdown", extra=REV)
def w30(t):
    return t.index_series.withColumn("d", W.drawdown("close")).groupBy("series_id").agg(F.min("d").alias("max_drawdown"))


@query("w32_b8_timing", "SELECT series_id, date, p2 * coalesce(r, 0) - CASE WHEN p1 - p2 > 0 THEN (p1 - p2) * 0.001 ELSE (p2 - p1) * 0.002 END AS net FROM (SELECT *, coalesce(lag(state, 1) OVER w, 0) AS p1, coalesce(lag(state, 2) OVER w, 0) AS p2, x / lag(x) OVER w - 1 AS r FROM rs WINDOW w AS (PARTITION BY series_id ORDER BY pos)) a", "net", extra=REV)
def w32(t):
    d = W.threshold_reversal_state(series(t)).withColumn("r", F.col("x") / F.lag("x").over(Window.partitionBy("series_id").orderBy("pos")) - 1)
    return W.lagged_position_cost(d, "state", "r", 0.001, 0.002).select("series_id", "date", "net")


@query("w33_first_entry", "SELECT code, date FROM (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM bars) x WHERE k = 1")
def w33(t):
    return t.bars.withColumn("f", W.first_entry()).where("f").select("code", "date")


@query("x1_winsorize", "SELECT b.date, code, least(greatest(pe_ttm, q1), q9) AS pe FROM bars b JOIN (SELECT date, quantile_cont(pe_ttm, 0.1) AS q1, quantile_cont(pe_ttm, 0.9) AS q9 FROM bars GROUP BY date) q ON q.date = b.date WHERE pe_ttm IS NOT NULL", "pe")
def x1(t):
    return X.winsorize(t.bars, "pe_ttm", 0.1, 0.9).where("pe_ttm is not null").select("date", "code", F.col("pe_ttm").alias("pe"))


Z = {
    "zq": "SELECT date, quantile_cont(mom, 0.01) AS m1, quantile_cont(mom, 0.99) AS m9, quantile_cont(ey, 0.01) AS e1, quantile_cont(ey, 0.99) AS e9 FROM ms GROUP BY date",
    "zc": "SELECT ms.date, code, fwd, CASE WHEN mom IS NOT NULL THEN least(greatest(mom, m1), m9) END AS m, CASE WHEN ey IS NOT NULL THEN least(greatest(ey, e1), e9) END AS e FROM ms JOIN zq ON zq.date = ms.date",
    "zz": "SELECT *, CASE WHEN zm IS NULL AND ze IS NULL THEN NULL ELSE (5*coalesce(ze, 0) - coalesce(zm, 0)) / (CASE WHEN ze IS NULL THEN 0 ELSE 5 END + CASE WHEN zm IS NULL THEN 0 ELSE 1 END) END AS score FROM (SELECT *, CASE WHEN stddev_samp(m) OVER (PARTITION BY date) > 1e-9 * abs(avg(m) OVER (PARTITION BY date)) THEN (m - avg(m) OVER (PARTITION BY date)) / stddev_samp(m) OVER (PARTITION BY date) END AS zm, CASE WHEN stddev_samp(e) OVER (PARTITION BY date) > 1e-9 * abs(avg(e) OVER (PARTITION BY date)) THEN (e - avg(e) OVER (PARTITION BY date)) / stddev_samp(e) OVER (PARTITION BY date) END AS ze FROM zc) a",
}


def blended(t):
    """The deployed signal: five parts earnings yield to one part short reversal, of members."""
    s = X.standardize(X.standardize(month_scores(t).withColumn("rev", -F.col("mom")), "rev", "zr"), "ey", "ze")
    return s.withColumn("score", X.blend(["ze", "zr"], [5.0, 1.0]))


@query("x2_x4_f6_blend", "SELECT date, code, score FROM zz", "score", extra=SCORES | Z)
def x4(t):
    return blended(t).select("date", "code", "score")


@query("x5_x6_top_bottom", "SELECT date, code, hi <= 3 AS top, lo <= 3 AS bottom FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS hi, row_number() OVER (PARTITION BY date ORDER BY amount, code) AS lo FROM bars) x WHERE hi <= 3 OR lo <= 3")
def x5(t):
    return t.bars.withColumn("hi", X.place("amount")).withColumn("lo", X.place("amount", False)).where("hi <= 3 or lo <= 3").select("date", "code", (F.col("hi") <= 3).alias("top"), (F.col("lo") <= 3).alias("bottom"))


def fold_sql(ranked: str, keys: str = "") -> str:
    """(keys, date, code) of books folded over their dates; ranked: (keys, dn, date, near, n), near the names by rank, dn the dates from 1."""
    k = f"{keys}, " if keys else ""
    r = "".join(f"r.{c.strip()}, " for c in keys.split(",")) if keys else ""
    on = "".join(f" AND r.{c.strip()} = st.{c.strip()}" for c in keys.split(",")) if keys else ""
    seed = f"SELECT DISTINCT {k}CAST(0 AS BIGINT) AS dn, CAST(NULL AS DATE) AS date, CAST([] AS VARCHAR[]) AS held FROM {ranked}"
    step = f"SELECT {k}dn, date, list_concat(stay, list_filter(near[1:n], lambda c: NOT list_contains(stay, c)))[1:n] FROM (SELECT {r}r.dn, r.date, r.near, r.n, list_filter(r.near, lambda c: list_contains(st.held, c))[1:r.n] AS stay FROM st JOIN {ranked} r ON r.dn = st.dn + 1{on}) q"
    return f"SELECT {k}date, unnest(held) AS code FROM (WITH RECURSIVE st AS ({seed} UNION ALL {step}) SELECT * FROM st) s WHERE dn > 0"


NEAR = {
    "placed": "SELECT date, code, CASE WHEN amount IS NOT NULL THEN row_number() OVER (PARTITION BY date, amount IS NULL ORDER BY amount DESC, code) END AS rk FROM ms",
    "folded": "SELECT date, row_number() OVER (ORDER BY date) AS dn, 5 AS n, coalesce(list(code ORDER BY rk) FILTER (WHERE rk <= 8), []) AS near FROM placed GROUP BY date",
}


@query("x7_hysteresis", fold_sql("folded"), extra=SCORES | NEAR)
def x7(t):
    """A book of five names by amount: a name stays down to rank 8, a new one comes in at rank 5 while there is room."""
    return X.hysteresis_book(month_scores(t), "amount", 5, 3)


@query("x8_rank_pct", "SELECT date, code, (rank() OVER (PARTITION BY date ORDER BY turn) + (count(*) OVER (PARTITION BY date, turn) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS pct FROM bars WHERE turn IS NOT NULL", "pct")
def x8(t):
    return t.bars.where("turn is not null").select("date", "code", X.rank_pct("turn").alias("pct"))


IC = {
    "ok": "SELECT * FROM ms WHERE ey IS NOT NULL AND fwd IS NOT NULL",
    "rk": "SELECT date, rank() OVER (PARTITION BY date ORDER BY ey) + (count(*) OVER (PARTITION BY date, ey) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS b FROM ok",
    "ics": "SELECT date, round(corr(a, b), 9) AS ic, count(*) AS n FROM rk GROUP BY date HAVING count(*) >= 5",
}


@query("x9_rank_ic", "SELECT date, ic, n FROM ics", "ic", extra=SCORES | IC)
def x9(t):
    return X.rank_ic(month_scores(t), "ey", "fwd")


@query("x10_ic_summary", "SELECT avg(ic) AS mean_ic, stddev_samp(ic) AS sd, count(*) AS n, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS hit, avg(ic)/stddev_samp(ic) AS ir, avg(ic)/stddev_samp(ic)*sqrt(count(*)) AS t FROM ics", "mean_ic sd hit ir t", extra=SCORES | IC)
def x10(t):
    return X.ic_summary(X.rank_ic(month_scores(t), "ey", "fwd"))


QR = {"qb": "SELECT date, fwd, CASE WHEN n >= 5 THEN greatest(0, CAST(ceil(r * 5.0 / greatest(n - 1, 1)) AS INT) - 1) END AS bin FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey, code) - 1 AS r, count(*) OVER (PARTITION BY date) AS n FROM ok) a"}


@query("x11_quantile_returns", "SELECT bin, avg(r) AS mean_ret, count(*) AS n_dates FROM (SELECT date, bin, avg(fwd) AS r FROM qb WHERE bin IS NOT NULL GROUP BY date, bin) a GROUP BY bin", "mean_ret", extra=SCORES | IC | QR)
def x11(t):
    return X.quantile_returns(month_scores(t), "ey", "fwd")


@query("x12_selection_excess", "SELECT date, avg(CASE WHEN p <= 5 THEN fwd END) AS top, avg(fwd) AS universe, avg(CASE WHEN p <= 5 THEN fwd END) - avg(fwd) AS excess FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ey DESC, code) AS p FROM ok) a GROUP BY date HAVING count(*) >= 5", "top universe excess", extra=SCORES | IC)
def x12(t):
    return X.selection_excess(month_scores(t), "ey", "fwd", 5).drop("spread")


@query("x13_terciles", "SELECT t, count(*) AS n FROM (SELECT CASE WHEN turn <= q1 THEN 0 WHEN turn <= q2 THEN 1 ELSE 2 END AS t FROM bars, (SELECT quantile_cont(turn, 1/3.0) AS q1, quantile_cont(turn, 2/3.0) AS q2 FROM bars) q) a GROUP BY t")
def x13(t):
    return X.pooled_terciles(t.bars, "turn", "t").groupBy("t").agg(F.count("*").alias("n"))


@query("x15_x16_sectors", "SELECT date, code, CASE WHEN bucket IS NULL THEN amount ELSE amount - avg(amount) OVER (PARTITION BY date, bucket) END AS neutral, row_number() OVER (PARTITION BY date, coalesce(bucket, '<none>') ORDER BY amount DESC, code) <= 2 AS kept FROM bars JOIN industry USING (code)", "neutral")
def x15(t):
    return t.bars.join(F.broadcast(t.industry), "code").select("date", "code", X.sector_demean("amount", "bucket").alias("neutral"), X.sector_cap("amount", "bucket", 2).isNotNull().alias("kept"))


@query("x18_inverse_vol", "SELECT date, code, i / sum(i) OVER (PARTITION BY date) AS w FROM (SELECT s.date, code, coalesce(1/coalesce(sg, md), 1.0) AS i FROM (SELECT date, code, CASE WHEN sigma >= 0.0001 THEN sigma END AS sg FROM sig) s JOIN (SELECT date, quantile_cont(CASE WHEN sigma >= 0.0001 THEN sigma END, 0.5) AS md FROM sig GROUP BY date) m ON m.date = s.date) a", "w", extra={"sig": "SELECT date, code, CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(ret) OVER w END AS sigma FROM rets WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"})
def x18(t):
    d = rets(t).withColumn("sigma", W.trailing(F.stddev_samp, "ret", 20, 2)).select("date", "code", "sigma")
    return X.inverse_vol_weights(d).select("date", "code", "w")


@query("x19_weight_cap", "SELECT date, code, CASE WHEN n*0.25 < 1 THEN w WHEN k < big THEN 0.25 ELSE w*(1 - big*0.25)/rest END AS w FROM (SELECT *, max(CASE WHEN k = big THEN s END) OVER (PARTITION BY date) AS rest FROM (SELECT *, min(CASE WHEN w*(1 - k*0.25)/s <= 0.25 + 1e-12 THEN k END) OVER (PARTITION BY date) AS big FROM (SELECT date, code, w, row_number() OVER (PARTITION BY date ORDER BY w DESC, code) - 1 AS k, count(*) OVER (PARTITION BY date) AS n, sum(w) OVER (PARTITION BY date ORDER BY w DESC, code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS s FROM (SELECT date, code, amount / sum(amount) OVER (PARTITION BY date) AS w FROM bars) a) b) c) d", "w")
def x19(t):
    d = t.bars.withColumn("w", X.basket_weights("amount"))
    return X.weight_cap(d).select("date", "code", "w")


@query("x20_basket_weights", "SELECT date, code, amount / sum(amount) OVER (PARTITION BY date) AS w, 1.0 / count(*) OVER (PARTITION BY date) AS equal FROM bars", "w equal")
def x20(t):
    return t.bars.select("date", "code", X.basket_weights("amount").alias("w"), X.basket_weights().alias("equal"))


@query("x21_argmax_asset", "SELECT date, min_by(code, (-mom, code)) AS pick FROM ms WHERE mom IS NOT NULL GROUP BY date".replace("min_by(code, (-mom, code))", "min(CASE WHEN r = 1 THEN code END)").replace("FROM ms WHERE", "FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS r FROM ms WHERE mom IS NOT NULL) x WHERE"), extra=SCORES)
def x21(t):
    return X.argmax_asset(month_scores(t), "mom")


@query("x22_worst_k", "SELECT code, date, close FROM bars ORDER BY close, code, date LIMIT 3", "close")
def x22(t):
    return t.bars.select("code", "date", "close").orderBy("close", "code", "date").limit(3)


@query("x23_u1_union_dates", "SELECT DISTINCT date AS d FROM (SELECT date FROM month_ends UNION SELECT ex_date AS date FROM dividends) x")
def x23(t):
    return t.month_ends.select(F.col("date").alias("d")).union(t.dividends.select("ex_date")).distinct()


@query("u2_u4_key_sets", "(SELECT code, 'both' AS part FROM (SELECT code FROM bars INTERSECT SELECT code FROM dividends) a) UNION ALL (SELECT code, 'left' AS part FROM (SELECT code FROM bars EXCEPT SELECT code FROM dividends) b)")
def u2(t):
    a, b = t.bars.select("code"), t.dividends.select("code")
    return a.intersect(b).withColumn("part", F.lit("both")).unionAll(a.distinct().join(b, "code", "left_anti").withColumn("part", F.lit("left")))


@query("u3_snapshot_changes", "SELECT s.next_snap AS snap_date, m.code, 'delete' AS change FROM membership m JOIN snapshots s ON s.snap_date = m.snap_date WHERE s.next_snap IS NOT NULL AND NOT EXISTS (SELECT 1 FROM membership x WHERE x.snap_date = s.next_snap AND x.code = m.code) UNION ALL SELECT m.snap_date, m.code, 'add' AS change FROM membership m JOIN snapshots s ON s.next_snap = m.snap_date WHERE NOT EXISTS (SELECT 1 FROM membership x WHERE x.snap_date = s.snap_date AND x.code = m.code)")
def u3(t):
    return X.snapshot_changes(t.membership)
