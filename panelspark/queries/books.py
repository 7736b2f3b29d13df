"""Rebalanced books, timing books and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import CostSpec, StopSpec
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.queries import query
from panelspark.queries.factors import BOX, LIMITS, SCORES, boxed, flagged, month_scores, rets

RATES = (0.001, 0.002)
BOOK = {
    "tg": "SELECT date, code, count(*) OVER (PARTITION BY date) AS n FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS r FROM ms WHERE amount IS NOT NULL) a WHERE r <= 5",
    "bk": "SELECT date, block, exec_pos, coalesce(lead(exec_pos) OVER (ORDER BY exec_pos), last) AS next_exec FROM (SELECT m.date, c.pos + 1 AS exec_pos, row_number() OVER (ORDER BY c.pos) AS block, (SELECT max(pos) FROM calendar) AS last FROM month_ends m JOIN calendar c ON c.date = m.date) z WHERE exec_pos <= last",
    "hd": "SELECT block, code, exec_pos, next_exec, 1.0/n AS w0 FROM tg JOIN bk ON bk.date = tg.date",
    "gd": "SELECT h.block, h.code, h.w0, h.next_exec, r.pos, exp(sum(ln(1 + coalesce(r.ret, 0))) OVER (PARTITION BY h.block, h.code ORDER BY r.pos)) AS g FROM hd h JOIN rets r ON r.code = h.code AND r.pos > h.exec_pos AND r.pos <= h.next_exec",
    "vd": "SELECT block, pos, sum(w0*g) AS v, max(next_exec) AS next_exec FROM gd GROUP BY block, pos",
    "gr": "SELECT pos, v / lag(v, 1, 1.0) OVER (PARTITION BY block ORDER BY pos) - 1 AS gross FROM vd",
    "we": "SELECT g.block + 1 AS block, g.code, g.w0*g.g/v.v AS w FROM gd g JOIN vd v ON v.block = g.block AND v.pos = g.pos WHERE g.pos = g.next_exec",
    "dl": "SELECT block, code, coalesce(h.w0, 0) - coalesce(e.w, 0) AS dw, h.w0 FROM hd h FULL JOIN we e USING (block, code)",
    "rb": "SELECT b.block, b.exec_pos, count(w0) AS n_held, coalesce(sum(abs(dw)), 0)/2 AS turnover, coalesce(sum(CASE WHEN dw > 0 THEN dw*0.001 ELSE -dw*0.002 END), 0) AS cost FROM bk b LEFT JOIN dl d ON d.block = b.block GROUP BY b.block, b.exec_pos",
    "dy": "SELECT c.pos, coalesce(g.gross, 0) AS gross, (1 + coalesce(g.gross, 0)) * (1 - coalesce(r.cost, 0)) - 1 AS net FROM calendar c LEFT JOIN gr g ON g.pos = c.pos LEFT JOIN rb r ON r.exec_pos = c.pos WHERE c.pos >= (SELECT min(exec_pos) FROM bk)",
}


SUMMARY = "log_wealth max_drawdown sharpe ann_mean"
SUMMED = f"variant, {', '.join(SUMMARY.split())}"


def book_sql(targets: str, signals: str, buy: float = RATES[0], sell: float = RATES[1], weight: str = "") -> dict[str, str]:
    """Derived tables of a book by variant; vp is its summary. targets: (variant, date, code[, weight]), signals: (variant, date)."""
    return {
        "vt": targets,
        "vs": signals,
        "vk": "SELECT variant, date, block, exec_pos, coalesce(lead(exec_pos) OVER (PARTITION BY variant ORDER BY exec_pos), last) AS next_exec FROM (SELECT s.variant, s.date, c.pos + 1 AS exec_pos, row_number() OVER (PARTITION BY s.variant ORDER BY c.pos) AS block, (SELECT max(pos) FROM calendar) AS last FROM vs s JOIN calendar c ON c.date = s.date) z WHERE exec_pos <= last",
        "vh": f"SELECT k.variant, k.block, t.code, k.exec_pos, k.next_exec, {f't.{weight}' if weight else '1.0 / count(*) OVER (PARTITION BY k.variant, k.block)'} AS w0 FROM vt t JOIN vk k ON k.variant = t.variant AND k.date = t.date",
        "vg": "SELECT h.variant, h.block, h.code, h.w0, h.next_exec, r.pos, exp(sum(ln(1 + coalesce(r.ret, 0))) OVER (PARTITION BY h.variant, h.block, h.code ORDER BY r.pos)) AS g FROM vh h JOIN rets r ON r.code = h.code AND r.pos > h.exec_pos AND r.pos <= h.next_exec",
        "vv": "SELECT variant, block, pos, sum(w0*g) + (1 - sum(w0)) AS v, max(next_exec) AS next_exec FROM vg GROUP BY variant, block, pos",
        "vr": "SELECT variant, pos, v / lag(v, 1, 1.0) OVER (PARTITION BY variant, block ORDER BY pos) - 1 AS gross FROM vv",
        "ve": "SELECT g.variant, g.block + 1 AS block, g.code, g.w0*g.g/v.v AS w FROM vg g JOIN vv v ON v.variant = g.variant AND v.block = g.block AND v.pos = g.pos WHERE g.pos = g.next_exec",
        "vd": "SELECT variant, block, code, coalesce(h.w0, 0) - coalesce(e.w, 0) AS dw FROM vh h FULL JOIN ve e USING (variant, block, code)",
        "vb": f"SELECT k.variant, k.exec_pos, coalesce(sum(CASE WHEN dw > 0 THEN dw*{buy} ELSE -dw*{sell} END), 0) AS cost FROM vk k LEFT JOIN vd d ON d.variant = k.variant AND d.block = k.block GROUP BY k.variant, k.exec_pos",
        "vy": "SELECT f.variant, c.pos, c.date, ln(1 + coalesce(g.gross, 0)) + ln(1 - coalesce(b.cost, 0)) AS l FROM (SELECT variant, min(exec_pos) AS lo FROM vk GROUP BY variant) f JOIN calendar c ON c.pos >= f.lo LEFT JOIN vr g ON g.variant = f.variant AND g.pos = c.pos LEFT JOIN vb b ON b.variant = f.variant AND b.exec_pos = c.pos",
        "vl": "SELECT variant, pos, date, exp(l) - 1 AS net, sum(l) OVER (PARTITION BY variant ORDER BY pos) AS lw FROM vy",
        "vp": "SELECT variant, max_by(lw, pos) AS log_wealth, min(exp(lw - greatest(hi, 0)) - 1) AS max_drawdown, avg(net)/stddev_samp(net)*sqrt(252.0) AS sharpe, avg(net)*252 AS ann_mean FROM (SELECT *, max(lw) OVER (PARTITION BY variant ORDER BY pos) AS hi FROM vl) z GROUP BY variant",
    }


def summary(d, by=("variant",), ret: str = "net"):
    return A.perf_summary(d, ret, by).select(*by, F.log("wealth").alias("log_wealth"), "max_drawdown", "sharpe", "ann_mean")


def top_book(t, n: int = 5, score: str = "amount", rates=RATES):
    m = month_scores(t).withColumn("p", X.place(score)).where(F.col("p") <= n).select(F.lit("a").alias("variant"), "date", "code")
    return B.ew_portfolio(m, t.month_ends.select(F.lit("a").alias("variant"), "date"), rets(t), t.calendar, rates)


@query("b1_b2_ew_portfolio", "SELECT pos, gross, net FROM dy", "gross net", extra=SCORES | BOOK)
def b1(t):
    return top_book(t)[0].select("pos", "gross", "net")


@query("b1_rebalances", "SELECT exec_pos, n_held, turnover, cost FROM rb", "turnover cost", extra=SCORES | BOOK)
def b1r(t):
    return top_book(t)[1].select("exec_pos", "n_held", "turnover", "cost")


CHEAP = BOOK | {"tg": BOOK["tg"].replace("amount DESC", "turn").replace("amount IS", "turn IS"), "rb": BOOK["rb"].replace("dw*0.001", "dw*0.0005").replace("dw*0.002", "dw*0.0005")}


@query("b3_bottom_n", "SELECT pos, net FROM dy", "net", extra=SCORES | CHEAP)
def b3(t):
    m = month_scores(t).withColumn("p", X.place("turn", False)).where("p <= 5").select(F.lit("a").alias("variant"), "date", "code")
    return B.ew_portfolio(m, t.month_ends.select(F.lit("a").alias("variant"), "date"), rets(t), t.calendar, (0.0005, 0.0005))[0].select("pos", "net")


@query("b4_limit_blocked", "SELECT b.date, code FROM (SELECT block, code, n.now, p.was FROM tb n FULL JOIN (SELECT block + 1 AS block, code, was FROM tb) p USING (block, code)) x JOIN bk b USING (block) LEFT JOIN (SELECT code, pos AS exec_pos, flag FROM flags) f USING (code, exec_pos) WHERE (now AND (was OR coalesce(flag, 0) <> 1)) OR (was AND coalesce(flag, 0) = -1)", extra=SCORES | BOOK | LIMITS | {"tb": "SELECT b.block, g.code, TRUE AS now, TRUE AS was FROM tg g JOIN bk b ON b.date = g.date"})
def b4(t):
    m = month_scores(t).withColumn("p", X.place("amount")).where("p <= 5").select(F.lit("a").alias("variant"), "date", "code")
    blocks = B.rebalance_blocks(t.month_ends.select(F.lit("a").alias("variant"), "date"), t.calendar)
    return B.limit_blocked(m, blocks, flagged(t)).select("date", "code")


FRAC = {
    "fc": "SELECT *, coalesce(ret, 0) AS r, sum(chg) OVER (PARTITION BY code ORDER BY pos) AS seg FROM (SELECT *, CASE WHEN target <> lag(target) OVER (PARTITION BY code ORDER BY pos) THEN 1 ELSE 0 END AS chg FROM boxt) a",
    "fg": "SELECT *, target*g/(1 - target + target*g) AS f FROM (SELECT *, exp(sum(CASE WHEN k = 1 THEN 0 ELSE ln(1 + r) END) OVER (PARTITION BY code, seg ORDER BY pos)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY code, seg ORDER BY pos) AS k FROM fc) a) b",
    "fn": "SELECT *, CASE WHEN chg = 1 THEN target - bf*(1 + r)/(1 + bf*r) ELSE 0 END AS traded FROM (SELECT *, coalesce(lag(f) OVER (PARTITION BY code ORDER BY pos), 0) AS bf FROM fg) a",
    "fp": "SELECT *, bf*r AS gross, bf*r - CASE WHEN traded > 0 THEN traded*0.001 ELSE -traded*0.002 END AS net FROM fn",
}


@query("b5_fractional_target", "SELECT code, date, gross, traded, net FROM fp", "gross traded net", extra=BOX | FRAC)
def b5(t):
    d = B.fractional_target(boxed(t), rates=RATES)
    return d.select("code", "date", "gross", "traded", "net")


@query("b6_ew_excess", "SELECT date, avg(net - r) AS excess FROM fp JOIN (SELECT code, min(pos) AS lo, max(pos) AS hi FROM dense WHERE close IS NOT NULL GROUP BY code) a USING (code) WHERE pos BETWEEN lo AND hi GROUP BY date", "excess", extra=BOX | FRAC)
def b6(t):
    d = B.fractional_target(boxed(t), rates=RATES).withColumn("alive", W.alive()).where("alive")
    return d.groupBy("date").agg(F.avg(F.col("net") - F.coalesce("ret", F.lit(0.0))).alias("excess"))


@query("b7_rotation", "SELECT d.pos, r.ret AS gross FROM (SELECT c.pos, (SELECT max_by(p.pick, p.pos) FROM pk p WHERE p.pos + 2 <= c.pos) AS held FROM calendar c) d JOIN rets r ON r.code = d.held AND r.pos = d.pos WHERE r.ret IS NOT NULL".replace("(SELECT c.pos, (SELECT max_by(p.pick, p.pos) FROM pk p WHERE p.pos + 2 <= c.pos) AS held FROM calendar c)", "(SELECT c.pos, max_by(p.pick, p.pos) AS held FROM calendar c JOIN pk p ON p.pos + 2 <= c.pos GROUP BY c.pos)"), "gross", extra=SCORES | {"pk": "SELECT c.pos, x.code AS pick FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, code) AS r FROM ms WHERE mom IS NOT NULL) x JOIN calendar c ON c.date = x.date WHERE r = 1"})
def b7(t):
    picks = X.argmax_asset(month_scores(t), "mom")
    return B.rotation(picks, rets(t).withColumn("ret", F.coalesce("ret", F.lit(float("-9")))), t.calendar).where("gross > -9 and held is not null").select("pos", "gross")


@query("b9_regime_scaled", "SELECT i.date, close * CASE WHEN n >= 60 AND close < ma THEN 0.0 ELSE 1.0 END AS scaled FROM (SELECT *, count(*) OVER w AS n, avg(close) OVER w AS ma FROM index_series WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) i", "scaled")
def b9(t):
    w = Window.partitionBy("series_id").orderBy("date")
    return t.index_series.withColumn("x", F.coalesce(W.moving_average_regime("close", 60, w), F.lit(1.0))).select("date", (F.col("close") * F.col("x")).alias("scaled"))


@query("b10_sleeve_mix", "SELECT pos, 0.6*coalesce(avg(CASE WHEN code LIKE 'sh%' THEN ret END), 0) + 0.4*coalesce(avg(CASE WHEN code LIKE 'sz%' THEN ret END), 0) AS ret FROM rets GROUP BY pos", "ret")
def b10(t):
    """Two sleeves, each the mean return of all names of an exchange."""
    d = rets(t).groupBy(F.substr("code", F.lit(1), F.lit(2)).alias("sleeve"), "pos").agg(F.avg("ret").alias("ret"))
    return B.sleeve_mix(d, t.spark.createDataFrame([("sh", 0.6), ("sz", 0.4)], "sleeve string, w double"), ret="ret")


@query("b11_parameter_sweep", "SELECT variant, count(*) AS days, avg(net) AS mean FROM vl GROUP BY variant", "mean", extra=SCORES | book_sql(
    "SELECT variant, date, code FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, code) AS r FROM ms WHERE amount IS NOT NULL) a, (VALUES ('top3', 3), ('top5', 5), ('top10', 10)) v(variant, n) WHERE r <= n",
    "SELECT variant, date FROM month_ends, (VALUES ('top3'), ('top5'), ('top10')) v(variant)"))
def b11(t):
    v = t.spark.createDataFrame([("top3", 3), ("top5", 5), ("top10", 10)], "variant string, n int")
    m = month_scores(t).withColumn("p", X.place("amount")).crossJoin(F.broadcast(v)).where(F.col("p") <= F.col("n")).select("variant", "date", "code")
    sig = t.month_ends.crossJoin(F.broadcast(v.select("variant")))
    return B.ew_portfolio(m, sig, rets(t), t.calendar, RATES)[0].groupBy("variant").agg(F.count("*").alias("days"), F.avg("net").alias("mean"))


@query("b12_tier_feasibility", "SELECT tier, sum(CASE WHEN floor(tier*0.2/(close*100))*100 > 0 THEN 1 ELSE 0 END) AS afford, count(*) AS names FROM bars, (VALUES (10000.0), (100000.0), (1000000.0)) v(tier) GROUP BY tier", "tier")
def b12(t):
    from panelspark.functions.scalars import lot_target_shares

    tiers = t.spark.createDataFrame([(1e4,), (1e5,), (1e6,)], "tier double")
    return t.bars.crossJoin(F.broadcast(tiers)).groupBy("tier").agg(F.sum((lot_target_shares(F.col("tier"), F.lit(0.2), F.lit(1.0), "close") > 0).cast("long")).alias("afford"), F.count("*").alias("names"))


@query("b13_short_hedge", "SELECT code, date, ret - 0.5*coalesce(r, 0) - 0.5*0.02/252 AS h FROM rets LEFT JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM index_series) i USING (date) WHERE ret IS NOT NULL", "h")
def b13(t):
    i = t.index_series.select("date", (F.col("close") / F.lag("close").over(Window.partitionBy("series_id").orderBy("date")) - 1).alias("r"))
    return rets(t).where("ret is not null").join(F.broadcast(i), "date", "left").select("code", "date", B.hedged("ret", "r", 0.5, 0.02).alias("h"))


@query("b15_b21_ledger", "SELECT account, date, cash, value, cash + value AS equity FROM (SELECT a.account, d.date, 1e6 - (SELECT coalesce(sum(shares*price + fee), 0) FROM fills f WHERE f.account = a.account AND f.date <= d.date) AS cash, (SELECT coalesce(sum(f.shares*coalesce(m.close, 0)), 0) FROM fills f LEFT JOIN marks m ON m.code = f.code AND m.date = d.date WHERE f.account = a.account AND f.date <= d.date) AS value FROM (SELECT DISTINCT account FROM fills) a, (SELECT DISTINCT date FROM marks) d) z".replace("(SELECT a.account, d.date, 1e6 - (SELECT coalesce(sum(shares*price + fee), 0) FROM fills f WHERE f.account = a.account AND f.date <= d.date) AS cash, (SELECT coalesce(sum(f.shares*coalesce(m.close, 0)), 0) FROM fills f LEFT JOIN marks m ON m.code = f.code AND m.date = d.date WHERE f.account = a.account AND f.date <= d.date) AS value FROM (SELECT DISTINCT account FROM fills) a, (SELECT DISTINCT date FROM marks) d)", "(SELECT a.account, d.date, 1e6 - coalesce(sum(f.shares*f.price + f.fee), 0) AS cash, coalesce(sum(f.shares*coalesce(m.close, 0)), 0) AS value FROM (SELECT DISTINCT account FROM fills) a CROSS JOIN (SELECT DISTINCT date FROM marks) d LEFT JOIN fills f ON f.account = a.account AND f.date <= d.date LEFT JOIN marks m ON m.code = f.code AND m.date = d.date GROUP BY 1, 2)"), "cash value equity")
def b15(t):
    return B.ledger(t.fills, t.marks)


@query("b16_ledger_parity", "SELECT max(abs(equity - other)) < 1e-4 AS equal, count(*) AS n FROM (SELECT a.account, d.date, 1e6 - coalesce(sum(f.shares*f.price + f.fee), 0) + coalesce(sum(f.shares*coalesce(m.close, 0)), 0) AS equity, 1e6 + coalesce(sum(f.shares*(coalesce(m.close, 0) - f.price) - f.fee), 0) AS other FROM (SELECT DISTINCT account FROM fills) a CROSS JOIN (SELECT DISTINCT date FROM marks) d JOIN fills f ON f.account = a.account AND f.date <= d.date LEFT JOIN marks m ON m.code = f.code AND m.date = d.date GROUP BY 1, 2) x")
def b16(t):
    a = B.ledger(t.fills, t.marks).select("account", "date", "equity")
    b = B.equity_by_marks(t.fills, t.marks).withColumnRenamed("equity", "other")
    return a.join(b, ["account", "date"]).agg((F.max(F.abs(F.col("equity") - F.col("other"))) < 1e-4).alias("equal"), F.count("*").alias("n"))


@query("b17_cost_basis")
def b17(t):
    return B.cost_basis(t.fills).select("account", "code", "shares", F.round("basis", 6).alias("basis"))


@query("b18_stop_outcome", "SELECT code, pos, count(fill) > 0 AS stopped, coalesce(min(row) FILTER (fill IS NOT NULL), max(row) FILTER (close IS NOT NULL)) AS exit_row, coalesce(arg_min(fill, row) FILTER (fill IS NOT NULL), arg_max(close, row) FILTER (close IS NOT NULL)) AS exit_price FROM (SELECT e.code, e.pos, r.pos AS row, r.close, CASE WHEN r.close <= e.close*(1 - 0.1) OR r.close >= e.close*(1 + 0.2) THEN r.close END AS fill FROM flags e JOIN dense r ON r.code = e.code AND r.pos BETWEEN e.pos + 1 AND e.pos + 20 WHERE e.flag = 1) x GROUP BY code, pos", "exit_price", extra=LIMITS)
def b18(t):
    e = flagged(t).where("flag = 1").select("code", "pos", F.col("close").alias("basis"))
    return B.stop_outcome(e, rets(t), StopSpec(0.1, 0.2), 20).drop("basis")


@query("b19_u5_target_changes", "SELECT code, 'entered' AS change FROM tg WHERE date = (SELECT max(date) FROM bk) AND code NOT IN (SELECT code FROM tg WHERE date = (SELECT max(date) FROM bk WHERE date < (SELECT max(date) FROM bk))) UNION ALL SELECT code, 'exited' AS change FROM tg WHERE date = (SELECT max(date) FROM bk WHERE date < (SELECT max(date) FROM bk)) AND code NOT IN (SELECT code FROM tg WHERE date = (SELECT max(date) FROM bk))", extra=SCORES | BOOK)
def b19(t):
    v = t.month_ends.select(F.lit("a").alias("variant"), "date")
    k = B.rebalance_blocks(v, t.calendar).withColumn("back", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("exec_pos")))).where("back <= 2").select("date", "back")
    m = month_scores(t).withColumn("p", X.place("amount")).where("p <= 5").join(F.broadcast(k), "date")
    now, before = m.where("back = 1").select("code"), m.where("back = 2").select("code")
    return now.join(before, "code", "left_anti").withColumn("change", F.lit("entered")).unionAll(before.join(now, "code", "left_anti").withColumn("change", F.lit("exited")))


BUY, SELL = CostSpec().rates


@query("p13_rates", f"SELECT account, sum(CASE WHEN shares > 0 THEN shares*price*{BUY!r} ELSE -shares*price*{SELL!r} END) AS cost FROM fills GROUP BY account", "cost")
def p13(t):
    return t.fills.groupBy("account").agg(F.sum(F.when(F.col("shares") > 0, F.col("shares") * F.col("price") * BUY).otherwise(-F.col("shares") * F.col("price") * SELL)).alias("cost"))
