"""Studies that compare books, events and data sets: all variants of a study run in one job, a variant being a column."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import StopSpec, inverse_positive, lot_target_shares
from panelspark.operators import asof as J
from panelspark.operators import events as E
from panelspark.operators import ingest as I
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.order import sliding_quantiles
from panelspark.queries import query
from panelspark.queries.books import FRAC, RATES, SUMMARY, SUMMED, book_sql, summary
from panelspark.queries.factors import LIMITS, SCORES, Z, blended, flagged, month_scores, rets
from panelspark.queries.joins import w23
from panelspark.sources import files


def daily(t, targets, signals, rates=RATES):
    """Daily returns by variant, with their dates."""
    return B.ew_portfolio(targets.select("variant", "date", "code"), signals.select("variant", "date"), rets(t), t.calendar, rates)[0].join(F.broadcast(t.calendar), "pos")


def variants(t, rows, schema):
    return F.broadcast(t.spark.createDataFrame(rows, schema))  # a handful of rows


# Books


WIDE = {
    "ms": "SELECT s.date, s.code, mom, ey, fwd, s.turn, s.amount FROM (SELECT *, lead(close) OVER (PARTITION BY code ORDER BY date) / close - 1 AS fwd FROM scored JOIN month_ends USING (date)) s JOIN dense x ON x.date = s.date AND x.code = s.code WHERE x.close IS NOT NULL AND NOT coalesce(x.is_st, false)",
    "wr": "SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS p FROM (SELECT date, code, round(score, 9) AS score FROM zz WHERE score IS NOT NULL) a",
    "wt": "SELECT variant, date, code FROM wr, (VALUES ('top05', 5), ('top10', 10), ('top20', 20)) v(variant, n) WHERE p <= n",
    "wk": "SELECT date, pos + 1 AS exec_pos, row_number() OVER (ORDER BY pos) AS block FROM calendar JOIN month_ends USING (date) WHERE pos < (SELECT max(pos) FROM calendar)",
    "wb": "SELECT t.variant, k.block, t.code, TRUE AS now, TRUE AS was FROM wt t JOIN wk k ON k.date = t.date",
}
Q11 = SCORES | WIDE | Z | LIMITS | book_sql(
    "SELECT variant, k.date, code FROM (SELECT variant, block, code, n.now, p.was FROM wb n FULL JOIN (SELECT variant, block + 1 AS block, code, was FROM wb) p USING (variant, block, code)) x JOIN wk k USING (block) LEFT JOIN (SELECT code, pos AS exec_pos, flag FROM flags) f USING (code, exec_pos) WHERE (now AND (was OR coalesce(flag, 0) <> 1)) OR (was AND coalesce(flag, 0) = -1)",
    "SELECT variant, date FROM month_ends, (VALUES ('top05'), ('top10'), ('top20')) v(variant)",
)


@query("q11_wide_universe", f"SELECT {SUMMED}, hhi FROM vp JOIN (SELECT variant, avg(h) AS hhi FROM (SELECT variant, date, sum(s*s) AS h FROM (SELECT variant, date, k / sum(k) OVER (PARTITION BY variant, date) AS s FROM (SELECT variant, date, coalesce(bucket, '<none>') AS b, count(*) AS k FROM vt JOIN industry USING (code) GROUP BY 1, 2, 3) a) c GROUP BY variant, date) d GROUP BY variant) e USING (variant)", f"{SUMMARY} hhi", extra=Q11)
def q11(t):
    """The blend over all names that are not under special treatment, 5, 10 and 20 of them; what is locked at the exec row isn't filled.

    Gives each book's results and its concentration by sector. The given tables have 25 names, hence the small books.
    """
    d = rets(t).withColumn("mom", W.trailing_return("close", 5)).withColumn("ey", inverse_positive("pe_ttm"))
    s = d.join(F.broadcast(t.month_ends), "date").where(F.col("close").isNotNull() & ~F.coalesce("is_st", F.lit(False))).withColumn("rev", -F.col("mom"))
    s = X.standardize(X.standardize(s, "rev", "zr"), "ey", "ze").withColumn("p", X.place(F.round(X.blend(["ze", "zr"], [5.0, 1.0]), 9)))
    v = variants(t, [("top05", 5), ("top10", 10), ("top20", 20)], "variant string, n int")
    signals = t.month_ends.crossJoin(v.select("variant"))
    wanted = s.crossJoin(v).where("p <= n").select("variant", "date", "code")
    got = files.written(B.limit_blocked(wanted, B.rebalance_blocks(signals, t.calendar), flagged(t)), "targets")
    k = got.join(F.broadcast(t.industry), "code").groupBy("variant", "date", F.coalesce("bucket", F.lit("<none>")).alias("b")).agg(F.count("*").alias("k"))
    share = F.col("k") / F.sum("k").over(Window.partitionBy("variant", "date"))
    hhi = k.withColumn("s", share).groupBy("variant", "date").agg(F.sum(F.col("s") * F.col("s")).alias("h")).groupBy("variant").agg(F.avg("h").alias("hhi"))
    return summary(daily(t, got, signals)).join(hhi, "variant")


CAPS = SCORES | book_sql(
    "SELECT variant, date, code FROM (SELECT variant, date, code, row_number() OVER (PARTITION BY variant, date ORDER BY v DESC, code) AS p FROM (SELECT variant, s.date, s.code, CASE WHEN variant = 'demean' THEN CASE WHEN bucket IS NULL THEN ey ELSE round(ey - m, 12) END ELSE CASE WHEN r <= cap THEN ey END END AS v FROM (SELECT ms.date, ms.code, ey, bucket, avg(ey) OVER (PARTITION BY ms.date, bucket) AS m, row_number() OVER (PARTITION BY ms.date, coalesce(bucket, '<none>'), ey IS NULL ORDER BY ey DESC, ms.code) AS r FROM ms JOIN industry ON industry.code = ms.code) s, (VALUES ('demean', 0), ('cap5', 5), ('cap4', 4), ('cap3', 3), ('cap2', 2)) c(variant, cap)) a WHERE v IS NOT NULL) b WHERE p <= 8",
    "SELECT variant, date FROM month_ends, (VALUES ('demean'), ('cap5'), ('cap4'), ('cap3'), ('cap2')) c(variant)",
)


@query("q7_sector_caps", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=CAPS)
def q7c(t):
    """Eight names by earnings yield: less the sector's mean, or with at most 5, 4, 3 or 2 of a sector."""
    s = month_scores(t).join(F.broadcast(t.industry), "code")
    s = s.withColumn("dm", F.when(F.col("bucket").isNull(), F.col("ey")).otherwise(F.round(X.sector_demean("ey", "bucket"), 12)))
    s = s.withColumn("r", X.place("ey", True, ("date", F.coalesce("bucket", F.lit("<none>")))))
    v = variants(t, [("demean", 0), ("cap5", 5), ("cap4", 4), ("cap3", 3), ("cap2", 2)], "variant string, cap int")
    s = s.crossJoin(v).withColumn("v", F.when(F.col("variant") == "demean", F.col("dm")).when(F.col("r") <= F.col("cap"), F.col("ey")))
    return summary(daily(t, s.withColumn("p", X.place("v", True, ("variant", "date"))).where("p <= 8"), t.month_ends.crossJoin(v.select("variant"))))


YIELDS = {
    "yd": "SELECT b.code, b.date, s.v / b.close AS y FROM bars b LEFT JOIN (SELECT x.code, x.date, sum(dps) AS v FROM bars x JOIN dividends d ON d.code = x.code AND d.ex_date > x.date - INTERVAL 365 DAY AND d.ex_date <= x.date GROUP BY x.code, x.date) s ON s.code = b.code AND s.date = b.date",
    "yb": "SELECT variant, x.code, x.date, x.close, coalesce(last_value(CASE WHEN y <= lo THEN 0 WHEN y >= hi THEN 1 END IGNORE NULLS) OVER (PARTITION BY variant, x.code ORDER BY x.pos), 0) AS held FROM dense x JOIN industry i ON i.code = x.code AND i.bucket = '60' LEFT JOIN yd ON yd.code = x.code AND yd.date = x.date CROSS JOIN (VALUES ('2:1', 0.002, 0.001), ('3:1', 0.003, 0.001), ('4:2', 0.004, 0.002), ('one', 0.002, 0.001)) v(variant, hi, lo) WHERE variant <> 'one' OR x.code = (SELECT min(code) FROM industry WHERE bucket = '60')",
}
Q27 = YIELDS | book_sql("SELECT variant, date, code FROM yb JOIN month_ends USING (date) WHERE held = 1 AND close IS NOT NULL", "SELECT variant, date FROM month_ends, (VALUES ('2:1'), ('3:1'), ('4:2'), ('one')) v(variant)")


@query("q27_dividend_band", f"SELECT {SUMMED}, days_held FROM vp JOIN (SELECT variant, sum(held) AS days_held FROM yb GROUP BY variant) USING (variant)".replace("sum(held)", "CAST(sum(held) AS BIGINT)"), SUMMARY, extra=Q27)
def q27(t):
    """A sector's names bought on a high trailing yield and sold on a low one, for a grid of bands and for its first name alone."""
    v = variants(t, [("2:1", 0.002, 0.001), ("3:1", 0.003, 0.001), ("4:2", 0.004, 0.002), ("one", 0.002, 0.001)], "variant string, hi double, lo double")
    sector = t.industry.where("bucket = '60'").select("code")
    first = sector.agg(F.min("code").alias("first"))
    d = rets(t).join(F.broadcast(sector), "code").join(w23(t), ["code", "date"], "left").crossJoin(v).crossJoin(F.broadcast(first)).where("variant <> 'one' or code = first")
    w = Window.partitionBy("variant", "code").orderBy("pos")
    d = files.written(d.withColumn("held", W.state_hold(F.col("y") >= F.col("hi"), F.col("y") <= F.col("lo"), w=w)).select("variant", "code", "date", "close", "held"), "bands")
    picks = d.join(F.broadcast(t.month_ends), "date").where("held = 1 and close is not null")
    s = summary(daily(t, picks, t.month_ends.crossJoin(v.select("variant"))))
    return s.join(d.groupBy("variant").agg(F.sum("held").cast("long").alias("days_held")), "variant")


RUNS = [("base", 5, True, 1.0, 1.0), ("ten", 10, True, 1.0, 1.0), ("nofloor", 5, False, 1.0, 1.0), ("price", 5, True, 1.0, 0.0), ("premium", 5, True, 0.0, 1.0), ("all", 1000000, True, 1.0, 1.0)]
RUN_SQL = ", ".join(f"('{v}', {n}, {str(f).lower()}, {a}, {b})" for v, n, f, a, b in RUNS)
LOW = {
    "fl": "SELECT substr(code, 1, 2) AS ex, quantile_cont(amount, 0.1) AS floor FROM bars GROUP BY 1",
    "lowr": f"SELECT variant, n, b.date, b.code, row_number() OVER (PARTITION BY variant, b.date ORDER BY round(a*b.close + c*100*b.pb_mrq, 6), b.code) AS p FROM bars b JOIN month_ends m ON m.date = b.date JOIN fl ON fl.ex = substr(b.code, 1, 2) CROSS JOIN (VALUES {RUN_SQL}) v(variant, n, floored, a, c) WHERE b.close IS NOT NULL AND b.pb_mrq IS NOT NULL AND (NOT floored OR round(b.amount, 6) >= round(fl.floor, 6))",
}
Q37 = LOW | book_sql("SELECT variant, date, code FROM lowr WHERE p <= n", f"SELECT variant, date FROM month_ends, (VALUES {RUN_SQL}) v(variant, n, floored, a, c)", 0.0005, 0.0005)


def low_ranks(t):
    """Month-end names in order of double-low scores for each run; p counts from the lowest."""
    b = t.bars.withColumn("ex", F.substr("code", F.lit(1), F.lit(2)))
    floors = b.groupBy("ex").agg(F.percentile("amount", F.lit(0.1)).alias("floor"))  # a row for each exchange
    v = variants(t, RUNS, "variant string, n int, floored boolean, a double, c double")
    d = b.join(F.broadcast(t.month_ends), "date").join(F.broadcast(floors), "ex").crossJoin(v).where("close is not null and pb_mrq is not null and (not floored or round(amount, 6) >= round(floor, 6))")
    return d.withColumn("p", X.place(F.round(F.col("a") * F.col("close") + F.col("c") * 100 * F.col("pb_mrq"), 6), False, ("variant", "date"))), v.select("variant")


@query("q37_cb_double_low", f"SELECT {SUMMED}, round(log_wealth, 9) > (SELECT round(log_wealth, 9) FROM vp WHERE variant = 'all') AS ahead, round(sharpe, 9) > (SELECT round(sharpe, 9) FROM vp WHERE variant = 'all') AS steadier, (SELECT avg(CASE WHEN abs(close_a - close_b)/close_b > 0.005 THEN 1.0 ELSE 0.0 END) FROM two_source) < 0.2 AS checked FROM vp", SUMMARY, extra=Q37)
def q37(t):
    """The lowest by price plus premium: five runs against all names, and a verdict in three parts (ahead, steadier, sources agree), to nine digits, so that rounding makes no run better than itself."""
    d, names = low_ranks(t)
    s = summary(daily(t, d.where("p <= n"), t.month_ends.crossJoin(names), (0.0005, 0.0005)))
    base = s.where("variant = 'all'").select(F.round("log_wealth", 9).alias("w"), F.round("sharpe", 9).alias("s"))
    check = J.close_mismatch(t.two_source).select((F.col("rate") < 0.2).alias("checked"))
    d = s.crossJoin(F.broadcast(base)).crossJoin(F.broadcast(check))
    return d.select(*s.columns, (F.round("log_wealth", 9) > F.col("w")).alias("ahead"), (F.round("sharpe", 9) > F.col("s")).alias("steadier"), "checked")


PAPER = LOW | {"inc": "SELECT date AS inception FROM calendar WHERE pos = (SELECT CAST(floor(max(pos)/2) AS BIGINT) FROM calendar)", "psig": "SELECT 'paper' AS variant, date FROM month_ends CROSS JOIN inc WHERE date >= inception"}
Q38 = PAPER | book_sql("SELECT 'paper' AS variant, l.date, code FROM lowr l JOIN psig s ON s.date = l.date WHERE l.variant = 'base' AND p <= n", "SELECT variant, date FROM psig", 0.0005, 0.0005) | {
    "lasts": "SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM vk",
    "bothb": "SELECT l.back, t.code FROM vt t JOIN lasts l ON l.date = t.date WHERE l.back <= 2",
    "seen": "SELECT code, max(date) AS last FROM bars GROUP BY code",
}


@query("q38_cb_paper", f"SELECT {SUMMED}, inception, (SELECT count(*) FROM bothb a WHERE back = 1 AND code NOT IN (SELECT code FROM bothb WHERE back = 2)) AS entered, (SELECT count(*) FROM bothb a WHERE back = 2 AND code NOT IN (SELECT code FROM bothb WHERE back = 1)) AS exited, (SELECT count(*) FROM seen WHERE last < (SELECT max(date) FROM calendar)) AS stale FROM vp CROSS JOIN inc", SUMMARY, extra=Q38)
def q38(t):
    """The record of the five lowest since a frozen inception, with the last changes of the book and the names whose data are stale."""
    c = t.calendar
    inc = c.join(F.broadcast(c.agg(F.floor(F.max("pos") / 2).cast("long").alias("pos"))), "pos").select(F.col("date").alias("inception"))
    sig = t.month_ends.crossJoin(F.broadcast(inc)).where("date >= inception").select(F.lit("paper").alias("variant"), "date")
    d = low_ranks(t)[0].where("variant = 'base' and p <= n").select("date", "code").join(F.broadcast(sig), "date").select("variant", "date", "code")
    d = files.written(d, "targets")
    k = B.rebalance_blocks(sig, c).withColumn("back", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("date")))).where("back <= 2").select("date", "back")
    two = d.join(F.broadcast(k), "date").groupBy("code").agg(F.max(F.col("back") == 1).alias("now"), F.max(F.col("back") == 2).alias("was"))
    changes = two.agg(F.count_if(F.col("now") & ~F.col("was")).alias("entered"), F.count_if(F.col("was") & ~F.col("now")).alias("exited"))
    last = c.agg(F.max("date").alias("today"))
    stale = t.bars.groupBy("code").agg(F.max("date").alias("last")).crossJoin(F.broadcast(last)).agg(F.count_if(F.col("last") < F.col("today")).alias("stale"))
    return summary(daily(t, d, sig, (0.0005, 0.0005))).crossJoin(F.broadcast(inc)).crossJoin(F.broadcast(changes)).crossJoin(F.broadcast(stale))


TIERS = [(1e5, "1e5"), (1e6, "1e6"), (1e7, "1e7")]
Q39 = SCORES | Z | {"inc": PAPER["inc"]} | {
    "tv": "SELECT tier || '|' || mode AS variant, tier, money, mode FROM (VALUES ('1e5', 1e5), ('1e6', 1e6), ('1e7', 1e7)) a(tier, money), (VALUES ('backtest'), ('live')) b(mode)",
    "tp": "SELECT z.date, z.code, b.close, row_number() OVER (PARTITION BY z.date ORDER BY round(z.score, 9) DESC, z.code) AS p FROM zz z JOIN bars b ON b.date = z.date AND b.code = z.code WHERE z.score IS NOT NULL",
} | book_sql(
    "SELECT variant, date, code FROM tp CROSS JOIN tv WHERE p <= 5 AND floor(CAST(money AS DOUBLE)*0.2*1.0/(close*(1 + 0.0)*100))*100 > 0",
    "SELECT variant, date FROM month_ends CROSS JOIN tv CROSS JOIN inc WHERE mode = 'backtest' OR date >= inception",
)


@query("q39_paper_live", f"SELECT {SUMMED}, held FROM vp JOIN (SELECT s.variant, count(t.code) AS held FROM vs s LEFT JOIN vt t ON t.variant = s.variant AND t.date = s.date GROUP BY s.variant) USING (variant)", SUMMARY, extra=Q39)
def q39(t):
    """The deployed blend for accounts of several sizes, who hold what a fifth of them buys a lot of: over all history, and since inception."""
    v = variants(t, [(f"{name}|{mode}", money, mode) for money, name in TIERS for mode in ("backtest", "live")], "variant string, money double, mode string")
    c = t.calendar
    inc = c.join(F.broadcast(c.agg(F.floor(F.max("pos") / 2).cast("long").alias("pos"))), "pos").select(F.col("date").alias("inception"))
    sig = t.month_ends.crossJoin(v).crossJoin(F.broadcast(inc)).where("mode = 'backtest' or date >= inception").select("variant", "date")
    s = blended(t).where("score is not null").join(t.bars.select("date", "code", "close"), ["date", "code"])
    s = s.withColumn("p", X.place(F.round("score", 9))).where("p <= 5").crossJoin(v).where(lot_target_shares(F.col("money"), F.lit(0.2), F.lit(1.0), "close") > 0)
    s = files.written(s.select("variant", "date", "code"), "targets")
    held = sig.join(s, ["variant", "date"], "left").groupBy("variant").agg(F.count("code").alias("held"))
    return summary(daily(t, s, sig)).join(held, "variant")


Q18 = SCORES | {
    "mo": "SELECT variant, x.date, x.code, CASE WHEN variant = 'mom20' THEN m20 ELSE m60 END AS m FROM (SELECT date, code, close / lag(close, 20) OVER (PARTITION BY code ORDER BY pos) - 1 AS m20, close / lag(close, 60) OVER (PARTITION BY code ORDER BY pos) - 1 AS m60 FROM dense) x JOIN month_ends USING (date), (VALUES ('mom20'), ('mom60')) v(variant)",
    "five": "SELECT code FROM (SELECT code, row_number() OVER (ORDER BY sum(amount) DESC, code) AS r FROM bars GROUP BY code) a WHERE r <= 5",
    "firsts": "SELECT min(date) AS date FROM month_ends",
} | book_sql(
    "SELECT variant, date, code FROM (SELECT variant, date, code, row_number() OVER (PARTITION BY variant, date ORDER BY m DESC, code) AS r FROM mo JOIN five USING (code) WHERE m IS NOT NULL) a WHERE r = 1 UNION ALL SELECT code AS variant, date, code FROM five CROSS JOIN firsts",
    "SELECT variant, date FROM month_ends, (VALUES ('mom20'), ('mom60')) v(variant) UNION ALL SELECT code AS variant, date FROM five CROSS JOIN firsts",
)


@query("q18_rotation_vs_hold", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=Q18)
def q18(t):
    """The strongest of the five most traded names over 20 or 60 rows, monthly, against holding each of the five."""
    top = t.bars.groupBy("code").agg(F.sum("amount").alias("s")).orderBy(F.desc("s"), "code").limit(5).select("code")
    top = files.written(top, "five")
    d = rets(t).join(F.broadcast(top), "code")
    d = d.withColumns({f"mom{k}": W.trailing_return("close", k) for k in (20, 60)}).join(F.broadcast(t.month_ends), "date")
    long = d.select("date", "code", F.explode(F.create_map(*(x for k in (20, 60) for x in (F.lit(f"mom{k}"), F.col(f"mom{k}")))))).withColumnsRenamed({"key": "variant", "value": "m"})
    picks = X.argmax_asset(long, "m", by=("variant", "date")).withColumnRenamed("pick", "code")
    hold = top.select(F.col("code").alias("variant"), "code").crossJoin(F.broadcast(t.month_ends.agg(F.min("date").alias("date"))))
    v = variants(t, [("mom20",), ("mom60",)], "variant string")
    signals = t.month_ends.crossJoin(v).select("variant", "date").unionByName(hold.select("variant", "date"))
    return summary(daily(t, picks.unionByName(hold), signals))


# Events and single names


OWN = {
    "ow": "SELECT code, date, close, round(pe_ttm, 4) AS pe, row_number() OVER (PARTITION BY code ORDER BY date) AS pos FROM bars",
    "oq": "SELECT *, count(pe) OVER w AS n, round(quantile_cont(CASE WHEN pe > 0 THEN pe END, 0.3) OVER w, 6) AS q30 FROM ow WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 1199 PRECEDING AND CURRENT ROW)",
    "rq3": "SELECT code, pub_date, n >= 3 AND m > 0.11 AS ok FROM (SELECT code, pub_date, count(roe) OVER w AS n, min(roe) OVER w AS m FROM annual_reports WINDOW w AS (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) x",
    "om": "SELECT o.code, o.date, o.pos, o.close, coalesce(r.ok, false) AND n >= 750 AND coalesce(pe > 0 AND pe <= q30, false) AS m FROM oq o ASOF LEFT JOIN rq3 r ON r.code = o.code AND r.pub_date <= o.date",
    "qe": "SELECT code, date, pos, close FROM (SELECT *, lag(m, 1, false) OVER (PARTITION BY code ORDER BY pos) AS p FROM om) x WHERE m AND NOT p",
    "qa": "SELECT e.code, e.date, e.pos, e.close AS p0, w.pos AS row, w.close FROM qe e JOIN ow w ON w.code = e.code AND w.pos BETWEEN e.pos + 1 AND e.pos + 120",
    "qy": "SELECT code, pos, date, 0.999*pn/p0 - 1 AS lump, (0.999*pn/p0 + coalesce(0.999*pn/f0, 1) + coalesce(0.999*pn/f1, 1))/3 - 1 AS pyramid, 1 + CAST(f0 IS NOT NULL AS INT) + CAST(f1 IS NOT NULL AS INT) AS filled FROM (SELECT code, pos, date, any_value(p0) AS p0, max_by(close, row) AS pn, min_by(close, row) FILTER (close <= 0.925*p0) AS f0, min_by(close, row) FILTER (close <= 0.85*p0) AS f1 FROM qa GROUP BY code, pos, date) a",
}


def own_rows(t):
    return t.bars.withColumn("pos", F.row_number().over(Window.partitionBy("code").orderBy("date"))).select("code", "date", "pos", "close", F.round("pe_ttm", 4).alias("pe"))


def own_history(t, window: int):
    """own_rows with n, the multiples in a name's last `window` rows, and q30, the low one among the positive ones."""
    frame = Window.partitionBy("code").orderBy("pos").rowsBetween(-(window - 1), 0)
    d = own_rows(t).withColumn("n", F.count("pe").over(frame)).withColumn("own", F.when(F.col("pe") > 0, F.col("pe")))
    return sliding_quantiles(d, {"q30": ("own", 0.3, window, 1)}).withColumn("q30", F.round("q30", 6))


def quality_events(t, window: int = 1200, least: int = 750):
    """First rows of a name's spells of quality (three reports over 11 %) and of value (its multiple low in its own history)."""
    d = own_history(t, window)
    f = Window.partitionBy("code").orderBy("pub_date").rowsBetween(-2, 0)
    ok = t.annual_reports.select("code", "pub_date", "stat_date", ((F.count("roe").over(f) >= 3) & (F.min("roe").over(f) > 0.11)).alias("ok"))
    d = J.report_asof(d, ok, "ok")
    m = F.coalesce("ok", F.lit(False)) & (F.col("n") >= least) & F.coalesce((F.col("pe") > 0) & (F.col("pe") <= F.col("q30")), F.lit(False))
    return d.withColumn("f", W.fresh_mask(m, Window.partitionBy("code").orderBy("pos"))).where("f").select("code", "date", "pos", "close")


@query("q20_event_set", "SELECT code, date, pos FROM qe", extra=OWN)
def q20(t):
    return quality_events(t).select("code", "date", "pos")


def staged(t):
    ev = files.written(quality_events(t), "events")
    return E.pyramid_vs_lump(ev.select("code", "pos"), own_rows(t).select("code", "pos", "close"), 120, 0.001).join(ev.select("code", "pos", "date"), ["code", "pos"])


@query("q21_quality_pyramid", "SELECT CASE WHEN date < DATE '1997-01-01' THEN 'early' ELSE 'late' END AS era, filled, count(*) AS n, avg(lump) AS lump, avg(pyramid) AS pyramid, avg(pyramid - lump) AS edge, avg(CASE WHEN pyramid > lump THEN 1.0 ELSE 0.0 END) AS share FROM qy GROUP BY 1, 2", "lump pyramid edge share", extra=OWN)
def q21(t):
    """Staged buying against one purchase at the quality and value events, by tranches filled and by era."""
    d = staged(t).withColumn("era", F.when(F.col("date") < "1997-01-01", "early").otherwise("late")).withColumn("edge", F.col("pyramid") - F.col("lump"))
    return d.groupBy("era", "filled").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("lump", "pyramid", "edge")), F.avg((F.col("edge") > 0).cast("double")).alias("share"))


STOPS = [0.03, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3]
Q14 = SCORES | {
    "se": "SELECT code, pos, close AS basis, date FROM (SELECT x.code, d.pos, d.close, x.date, row_number() OVER (PARTITION BY x.date ORDER BY ey DESC, x.code) AS p FROM ms x JOIN dense d ON d.date = x.date AND d.code = x.code WHERE ey IS NOT NULL) a WHERE p <= 5",
    "so": "SELECT e.code, e.pos, e.basis, e.date, level, trigger, r.pos AS row, r.close, CASE WHEN e.basis > 0 AND r.close IS NOT NULL THEN CASE WHEN trigger = 'close' AND r.close <= e.basis*(1 - level) THEN r.close WHEN trigger = 'intraday' AND r.low <= e.basis*(1 - level) THEN least(e.basis*(1 - level), r.close) END END AS fill FROM se e JOIN dense r ON r.code = e.code AND r.pos BETWEEN e.pos + 1 AND e.pos + 20 CROSS JOIN (VALUES " + ", ".join(f"({x})" for x in STOPS) + ") l(level) CROSS JOIN (VALUES ('close'), ('intraday')) g(trigger)",
    "sx": "SELECT code, pos, date, CAST(level AS DOUBLE) AS level, trigger, count(fill) > 0 AS stopped, coalesce(arg_min(fill, row) FILTER (fill IS NOT NULL), arg_max(close, row) FILTER (close IS NOT NULL)) / any_value(basis) - 1 AS ret FROM so GROUP BY code, pos, date, level, trigger",
}


@query("q14_stops", "SELECT trigger, level, CASE WHEN date < DATE '1995-01-01' THEN 'early' ELSE 'late' END AS era, count(*) AS n, avg(CASE WHEN stopped THEN 1.0 ELSE 0.0 END) AS stopped, avg(ret) AS mean, min(ret) AS worst, CASE WHEN count(*) >= 2 AND stddev_samp(ret) >= 1e-12 THEN avg(ret)/(stddev_samp(ret)/sqrt(count(*))) END AS t FROM sx WHERE ret IS NOT NULL GROUP BY 1, 2, 3", "level stopped mean worst t", extra=Q14)
def q14(t):
    """Eight stop levels by two triggers over 20 rows from each purchase of the five best by earnings yield, by era: one pass over the paths. Where all were stopped at the level itself, there is no dispersion and no t."""
    d = rets(t).select("date", "code", "pos", "close", "low")
    e = month_scores(t).withColumn("p", X.place("ey")).where("p <= 5").select("date", "code").join(d, ["date", "code"]).select("code", "pos", "date", F.col("close").alias("basis"))
    path = J.positional_range(e, d.select("code", "pos", "close", "low"), "pos", 20)
    specs = [(g, x) for g in ("close", "intraday") for x in STOPS]
    fills = [StopSpec(x, None, g).exit_price("basis", "close", "low", F.lit(None).cast("double")) for g, x in specs]
    hits = [F.min(F.when(f.isNotNull(), F.struct("row", f.alias("fill"))))["fill"].alias(f"h{i}") for i, f in enumerate(fills)]
    mark = F.max(F.when(F.col("close").isNotNull(), F.struct("row", "close")))["close"].alias("m")
    g = path.groupBy("code", "pos", "date", "basis").agg(mark, *hits)
    rows = F.explode(F.array(*(F.struct(F.lit(tr).alias("trigger"), F.lit(x).alias("level"), F.col(f"h{i}").alias("h")) for i, (tr, x) in enumerate(specs))))
    o = g.select("date", "basis", "m", rows.alias("s")).select("date", "s.trigger", "s.level", F.col("s.h").isNotNull().alias("stopped"), (F.coalesce("s.h", "m") / F.col("basis") - 1).alias("ret")).where("ret is not null")
    o = o.withColumn("era", F.when(F.col("date") < "1995-01-01", "early").otherwise("late"))
    return o.groupBy("trigger", "level", "era").agg(F.count("*").alias("n"), F.avg(F.col("stopped").cast("double")).alias("stopped"), F.avg("ret").alias("mean"), F.min("ret").alias("worst"), A.t_of("ret").alias("t"))


CHANGES = "SELECT s.next_snap AS snap_date, m.code, 'delete' AS change FROM membership m JOIN snapshots s ON s.snap_date = m.snap_date WHERE s.next_snap IS NOT NULL AND NOT EXISTS (SELECT 1 FROM membership x WHERE x.snap_date = s.next_snap AND x.code = m.code) UNION ALL SELECT m.snap_date, m.code, 'add' AS change FROM membership m JOIN snapshots s ON s.next_snap = m.snap_date WHERE NOT EXISTS (SELECT 1 FROM membership x WHERE x.snap_date = s.snap_date AND x.code = m.code)"
Q17 = {
    "chg": CHANGES,
    "um": "SELECT c.date, coalesce(avg(r.ret), 0) AS m FROM calendar c LEFT JOIN members m ON m.date = c.date LEFT JOIN rets r ON r.date = m.date AND r.code = m.code GROUP BY c.date",
    "lp": "SELECT code, pos, sum(ln(1 + greatest(coalesce(ret - m, 0), -0.999999))) OVER (PARTITION BY code ORDER BY pos) AS s FROM rets JOIN um USING (date)",
    "ch": "SELECT change, snap_date, e.code, h.horizon, e.entry_pos, least(e.entry_pos + h.horizon, (SELECT max(pos) FROM calendar)) AS fin FROM (SELECT change, snap_date, x.code, min(c.pos) AS entry_pos FROM chg x JOIN calendar c ON c.date > x.snap_date GROUP BY change, snap_date, x.code) e CROSS JOIN (VALUES (5), (20), (60)) h(horizon)",
    "cc": "SELECT ch.*, exp(b.s - a.s) - 1 AS car, z.last < ch.fin AS dead FROM ch JOIN lp a ON a.code = ch.code AND a.pos = ch.entry_pos JOIN lp b ON b.code = ch.code AND b.pos = ch.fin JOIN (SELECT code, max(pos) FILTER (close IS NOT NULL) AS last FROM dense GROUP BY code) z ON z.code = ch.code",
}


@query("q17_index_caar", "SELECT change, horizon, CAST(sum(n) AS BIGINT) AS n, sum(c)/sum(n) AS caar, count(*) AS batches, avg(c/n)/(stddev_samp(c/n)/sqrt(count(*))) AS batch_t, CAST(sum(dead) AS BIGINT) AS dead, sum(hits)/sum(n) AS hit FROM (SELECT change, horizon, snap_date, count(*) AS n, sum(car) AS c, count(*) FILTER (dead) AS dead, count(*) FILTER (car > 1e-9) AS hits FROM cc GROUP BY 1, 2, 3) x GROUP BY change, horizon", "caar batch_t hit", extra=Q17)
def q17(t):
    """Names added to and deleted from the membership: compounded abnormal return from the next row, t over snapshots, names that stopped trading, hits (over 1e-9, so that rounding is none)."""
    from panelspark.queries.stats import a1

    p = rets(t).join(F.broadcast(a1(t)), "date").withColumn("abn", F.col("ret") - F.col("m"))  # a row a trading day
    ev = J.next_trading_row(X.snapshot_changes(t.membership), t.calendar, "snap_date")
    c = E.frozen_log_car(ev, p, [5, 20, 60])
    last = p.groupBy("code").agg(F.max(F.when(F.col("close").isNotNull(), F.col("pos"))).alias("last"))
    end = t.calendar.agg(F.max("pos").alias("end"))
    c = c.join(last, "code").crossJoin(F.broadcast(end)).withColumn("dead", F.col("last") < F.least(F.col("entry_pos") + F.col("horizon"), F.col("end")))
    b = c.groupBy("change", "horizon", "snap_date").agg(F.count("*").alias("n"), F.sum("car").alias("c"), F.count_if("dead").alias("d"), F.count_if(F.col("car") > 1e-9).alias("h"))
    x = F.col("c") / F.col("n")
    return b.groupBy("change", "horizon").agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("caar"), F.count("*").alias("batches"), A.t_of(x).alias("batch_t"), F.sum("d").alias("dead"), (F.sum("h") / F.sum("n")).alias("hit"))


OWNBOX = {
    "fx": "SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY pos) - 1 AS ret, CASE WHEN count(close) OVER w >= 120 THEN CASE WHEN (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) <= 0.1 THEN 1.0 WHEN (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) >= 0.9 THEN 0.3 END END AS sig FROM ow WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)",
    "boxt": "SELECT code, date, pos, ret, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY code ORDER BY pos), 1.0) AS target FROM fx",
}


@query("q23_box_vs_hold", "SELECT code, count(*) AS days, count(*) FILTER (traded <> 0) AS trades, sum(ln(1 + r)) AS hold, sum(ln(1 + gross)) AS gross, sum(ln(1 + net)) AS net, avg(target) AS exposure, avg(net - r) * 252 AS excess FROM fp GROUP BY code", "hold gross net exposure excess", extra=OWN | OWNBOX | FRAC)
def q23(t):
    """The box trader on each name's own rows, 120 of them before: log growth gross and net against holding, trades, exposure, yearly excess."""
    w = Window.partitionBy("code").orderBy("pos")
    d = own_rows(t).withColumn("ret", F.col("close") / F.lag("close").over(w) - 1).withColumn("target", W.carried(W.rolling_box("close", 120), w=w))
    d = B.fractional_target(d, rates=RATES).withColumn("r", F.coalesce("ret", F.lit(0.0)))
    grown = lambda c: F.sum(F.log1p(c)).alias({"r": "hold"}.get(c, c))
    return d.groupBy("code").agg(F.count("*").alias("days"), F.count_if(F.col("traded") != 0).alias("trades"), grown("r"), grown("gross"), grown("net"), F.avg("target").alias("exposure"), (F.avg(F.col("net") - F.col("r")) * 252).alias("excess"))


@query("w9_w10_own_history", "SELECT code, date, n >= 750 AS valid, CASE WHEN n >= 750 THEN q30 END AS q30 FROM oq", "q30", extra=OWN)
def w9(t):
    """A name's low multiple in its own last 1,200 rows, at least 750 of them with one."""
    d = own_history(t, 1200)
    return d.select("code", "date", (F.col("n") >= 750).alias("valid"), F.when(F.col("n") >= 750, F.col("q30")).alias("q30"))


@query("w11_regime_200", "SELECT series_id, date, CASE WHEN count(*) OVER s >= 200 THEN CAST(close >= avg(close) OVER s AS INT) + 0.0 END AS regime FROM index_series WINDOW s AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)", "regime")
def w11(t):
    return t.index_series.select("series_id", "date", W.moving_average_regime("close", 200, Window.partitionBy("series_id").orderBy("date")).alias("regime"))


# Data sets


@query("q42_dataset_build", "SELECT substr(code, 1, 2) AS ex, count(*) AS rows, count(DISTINCT code) AS codes, min(date) AS first, max(date) AS last, sum(close) / count(*) AS mean, count(DISTINCT code) >= 0.9 * (SELECT count(DISTINCT substr(m.code, 1, 2) || m.code) FROM membership m WHERE substr(m.code, 1, 2) = substr(b.code, 1, 2)) AS covered, CAST((SELECT count(*) FROM calendar) AS BIGINT) - count(DISTINCT date) AS missing_days FROM bars b GROUP BY substr(code, 1, 2)".replace("count(DISTINCT code) >= 0.9 * (SELECT count(DISTINCT substr(m.code, 1, 2) || m.code) FROM membership m WHERE substr(m.code, 1, 2) = substr(b.code, 1, 2))", "count(DISTINCT code) >= 0.9 * any_value(want)").replace("FROM bars b GROUP", "FROM bars b JOIN (SELECT substr(code, 1, 2) AS ex, count(DISTINCT code) AS want FROM membership GROUP BY 1) w ON w.ex = substr(b.code, 1, 2) GROUP"), "mean")
def q42(t):
    """Landed text tables of two batches typed, merged by key with the later batch ahead, gated and written by exchange; the report is read from what was written."""
    text = t.bars.select("code", *(F.col(c).cast("string").alias(c) for c in ("date", "close", "volume")))
    first = text.withColumn("close", F.when(F.day(F.col("date").cast("date")) == 1, "--").otherwise(F.col("close"))).withColumn("batch", F.lit(1))
    second = text.where(F.day(F.col("date").cast("date")) <= 10).withColumn("batch", F.lit(2))  # a later pull of part of each month, with what could not be read
    rows = I.upsert_keep_last(I.typed(first.unionByName(second), ("close", "volume"), ("date",)), ["code", "date"])
    path = files.fresh_path(t.spark, "dataset")
    files.sink_parquet(rows.withColumn("ex", F.substr("code", F.lit(1), F.lit(2))).drop("batch"), path, ("ex",))
    got = t.spark.read.parquet(path)
    want = t.membership.groupBy(F.substr("code", F.lit(1), F.lit(2)).alias("ex")).agg(F.count_distinct("code").alias("want"))
    days = t.calendar.agg(F.count("*").alias("days"))
    g = got.where("date is not null and close is not null").groupBy("ex").agg(F.count("*").alias("rows"), F.count_distinct("code").alias("codes"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("close").alias("mean"), F.count_distinct("date").alias("d"))
    g = g.join(F.broadcast(want), "ex").crossJoin(F.broadcast(days))
    return g.select("ex", "rows", "codes", "first", "last", "mean", (F.col("codes") >= 0.9 * F.col("want")).alias("covered"), (F.col("days") - F.col("d")).alias("missing_days"))


@query("q43_minute_accumulation", "SELECT event_type AS symbol, period, count(*) AS rows, sum(n) AS ticks, max(high) AS high FROM (SELECT event_type, 'hour' AS period, date_trunc('hour', ts) AS start, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 3 UNION ALL SELECT event_type, 'day' AS period, date_trunc('day', ts) AS start, count(*) AS n, max(value) AS high FROM events GROUP BY 1, 3) x GROUP BY 1, 2".replace("sum(n)", "CAST(sum(n) AS BIGINT)"), "high")
def q43(t):
    """Bars of every symbol in two periods; a pull that overlaps the stored history adds only the bars it lacks."""
    e = t.events.select(F.col("event_type").alias("symbol"), "ts", "value")
    e = e.select("symbol", "value", F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.date_trunc(p, "ts").alias("start")) for p in ("hour", "day")))).alias("x"))
    b = e.groupBy("symbol", "x.period", "x.start").agg(F.count("*").alias("n"), F.max("value").alias("high"))
    pull = b.withColumn("day", F.ntile(3).over(Window.partitionBy("symbol", "period").orderBy("start")))
    kept = I.accumulate(pull.where("day <= 2").drop("day"), pull.where("day >= 2").drop("day"), ["symbol", "period", "start"])
    return kept.groupBy("symbol", "period").agg(F.count("*").alias("rows"), F.sum("n").alias("ticks"), F.max("high").alias("high"))
