"""Joins in time and the report windows that feed them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import asof as J
from panelspark.queries import query
from panelspark.queries.factors import rets


@query("j1_membership_asof", "SELECT date, code FROM members")
def j1(t):
    return J.membership_asof(t.calendar.select("date"), t.membership)


@query("j2_restrict", "SELECT b.date, b.code, CASE WHEN m.code IS NOT NULL THEN b.close END AS close FROM bars b LEFT JOIN members m ON m.date = b.date AND m.code = b.code", "close")
def j2(t):
    return J.restrict_to_universe(t.bars.select("date", "code", "close"), J.membership_asof(t.calendar.select("date"), t.membership), ["close"])


@query("j3_member_union", "SELECT date, count(*) AS n FROM (SELECT date, code FROM members UNION SELECT b.date, b.code FROM bars b WHERE b.code LIKE 'sh.6880%') x GROUP BY date")
def j3(t):
    a = J.membership_asof(t.calendar.select("date"), t.membership).select("date", "code")
    return a.union(t.bars.where("code like 'sh.6880%'").select("date", "code")).distinct().groupBy("date").agg(F.count("*").alias("n"))


@query("j4_exposure_asof", "SELECT c.date, coalesce(max_by(CASE WHEN day(m.date) % 2 = 0 THEN 1.0 ELSE 0.5 END, m.date), 1.0) AS exposure FROM calendar c LEFT JOIN month_ends m ON m.date <= c.date GROUP BY c.date", "exposure")
def j4(t):
    e = t.month_ends.select("date", F.when(F.day("date") % 2 == 0, 1.0).otherwise(0.5).alias("exposure"))
    return J.exposure_asof(t.calendar.select("date"), e)


@query("j5_report_asof", "SELECT b.code, b.date, r.roe FROM bars b ASOF LEFT JOIN annual_reports r ON r.code = b.code AND r.pub_date <= b.date", "roe")
def j5(t):
    return J.report_asof(t.bars.select("code", "date"), t.annual_reports, "roe")


@query("j6_value_asof", "SELECT r.code, r.pub_date, b.pe_ttm FROM annual_reports r ASOF LEFT JOIN bars b ON b.code = r.code AND b.date <= r.pub_date", "pe_ttm")
def j6(t):
    return J.asof_join(t.annual_reports.select("code", "pub_date"), t.bars.select("code", "date", "pe_ttm"), ["code"], "pub_date", "date").select("code", "pub_date", "pe_ttm")


@query("j7_next_trading_row", "SELECT r.code, r.pub_date, min(c.date) AS entry_date, min(c.pos) AS entry_pos FROM annual_reports r JOIN calendar c ON c.date > r.pub_date GROUP BY r.code, r.pub_date")
def j7(t):
    return J.next_trading_row(t.annual_reports.select("code", "pub_date"), t.calendar, "pub_date")


@query("j8_next_or_same", "SELECT r.code, r.ex_date, min(c.date) AS entry_date, min(c.pos) AS entry_pos FROM dividends r JOIN calendar c ON c.date >= r.ex_date GROUP BY r.code, r.ex_date")
def j8(t):
    return J.next_trading_row(t.dividends.select("code", "ex_date"), t.calendar, "ex_date", strict=False)


@query("j9_interval_return", "SELECT h.code, h.stat_date, b.close / a.close - 1 AS r FROM (SELECT *, lag(stat_date) OVER (PARTITION BY code ORDER BY stat_date) AS prev FROM holders) h ASOF LEFT JOIN bars b ON b.code = h.code AND b.date <= h.stat_date ASOF LEFT JOIN bars a ON a.code = h.code AND a.date <= h.prev", "r")
def j9(t):
    h = t.holders.withColumn("prev", F.lag("stat_date").over(Window.partitionBy("code").orderBy("stat_date"))).select("code", "stat_date", "prev")
    b = t.bars.select("code", "date", "close")
    x = J.asof_join(h, b, ["code"], "stat_date", "date").withColumnRenamed("close", "c1").drop("date")
    return J.asof_join(x, b, ["code"], "prev", "date").select("code", "stat_date", (F.col("c1") / F.col("close") - 1).alias("r"))


@query("j10_positional_range", "SELECT d.code, d.ex_date, count(x.close) AS n, max(x.close) AS hi FROM dividends d JOIN calendar c ON c.date = d.ex_date JOIN dense x ON x.code = d.code AND x.pos BETWEEN c.pos + 1 AND c.pos + 5 GROUP BY d.code, d.ex_date", "hi")
def j10(t):
    e = t.dividends.join(F.broadcast(t.calendar.withColumnRenamed("date", "ex_date")), "ex_date").select("code", "ex_date", "pos")
    return J.positional_range(e, rets(t).select("code", "pos", "close"), "pos", 5).groupBy("code", "ex_date").agg(F.count("close").alias("n"), F.max("close").alias("hi"))


@query("j11_two_source", "SELECT count(*) AS rows, avg(CASE WHEN abs(close_a-close_b)/close_b > 0.005 THEN 1.0 ELSE 0.0 END) AS rate, max(abs(close_a-close_b)/close_b) AS worst FROM two_source", "rate worst")
def j11(t):
    return J.close_mismatch(t.two_source)


@query("j12_revision_match", "SELECT code, effective_date, CASE WHEN k > 1 AND new_price < old_price THEN mx >= 0.5*(old_price/new_price - 1) END AS matched FROM (SELECT r.code, r.effective_date, r.old_price, r.new_price, r.k, max(v.j) AS mx FROM (SELECT a.*, (SELECT min(v.k) FROM (SELECT code, date, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM bars) v WHERE v.code = a.code AND v.date >= a.effective_date) AS k FROM (SELECT code, pub_date AS effective_date, 10.0 AS old_price, 8.0 AS new_price FROM annual_reports) a) r LEFT JOIN (SELECT code, row_number() OVER w AS k, close / lag(close) OVER w - 1 AS j FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) v ON v.code = r.code AND v.k BETWEEN r.k - 3 AND r.k + 3 GROUP BY ALL) z")
def j12(t):
    r = t.annual_reports.select("code", F.col("pub_date").alias("effective_date"), F.lit(10.0).alias("old_price"), F.lit(8.0).alias("new_price"))
    return J.revision_jump_matched(t.bars.select("code", "date", F.col("close").alias("value")), r).select("code", "effective_date", "matched")


@query("j14_attribute_join", "SELECT b.code, i.bucket, count(*) AS n FROM bars b LEFT JOIN industry i ON i.code = b.code GROUP BY b.code, i.bucket")
def j14(t):
    return t.bars.join(F.broadcast(t.industry), "code", "left").groupBy("code", "bucket").agg(F.count("*").alias("n"))


@query("j16_ffill_calendar", "SELECT c.date, coalesce(max_by(m.d, m.date), 0.0) AS v FROM calendar c LEFT JOIN (SELECT date, day(date) + 0.5 AS d FROM month_ends) m ON m.date <= c.date GROUP BY c.date", "v")
def j16(t):
    return J.ffill_onto_calendar(t.calendar.select("date"), t.month_ends.select("date", (F.day("date") + 0.5).alias("v")), "v")


@query("j17_day_one", "SELECT l.code, l.list_date, s.close / l.issue_price - 1 AS pop FROM listings l JOIN supplier_days s ON s.code = l.code AND s.date = l.list_date", "pop")
def j17(t):
    one = t.supplier_days.groupBy("code").agg(F.min_by("close", "date").alias("close"))
    return t.listings.join(one, "code").select("code", "list_date", (F.col("close") / F.col("issue_price") - 1).alias("pop"))


@query("w22_rolling_report_min", "SELECT code, pub_date, n >= 3 AND m > 0.11 AS ok FROM (SELECT code, pub_date, count(roe) OVER w AS n, min(roe) OVER w AS m FROM annual_reports WINDOW w AS (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) x")
def w22(t):
    f = Window.partitionBy("code").orderBy("pub_date").rowsBetween(-2, 0)
    return t.annual_reports.select("code", "pub_date", ((F.count("roe").over(f) >= 3) & (F.min("roe").over(f) > 0.11)).alias("ok"))


@query("w23_trailing_yield", "SELECT b.code, b.date, (SELECT sum(dps) FROM dividends d WHERE d.code = b.code AND d.ex_date > b.date - INTERVAL 365 DAY AND d.ex_date <= b.date) / b.close AS y FROM bars b".replace("(SELECT sum(dps) FROM dividends d WHERE d.code = b.code AND d.ex_date > b.date - INTERVAL 365 DAY AND d.ex_date <= b.date) / b.close AS y FROM bars b", "s.v / b.close AS y FROM bars b LEFT JOIN (SELECT x.code, x.date, sum(dps) AS v FROM bars x JOIN dividends d ON d.code = x.code AND d.ex_date > x.date - INTERVAL 365 DAY AND d.ex_date <= x.date GROUP BY x.code, x.date) s ON s.code = b.code AND s.date = b.date"), "y")
def w23(t):
    ev = t.dividends.select("code", F.col("ex_date").alias("date"), "dps", F.lit(None).cast("double").alias("close"))
    both = ev.unionByName(t.bars.select("code", "date", F.lit(None).cast("double").alias("dps"), "close"))
    w = Window.partitionBy("code").orderBy(F.unix_date("date")).rangeBetween(-364, 0)
    return both.withColumn("v", F.sum("dps").over(w)).where("close is not null").select("code", "date", (F.col("v") / F.col("close")).alias("y"))


@query("w24_report_delta", "SELECT code, stat_date, holders / prev - 1 AS surge FROM (SELECT *, lag(holders) OVER w AS prev, lag(stat_date) OVER w AS ps FROM holders WINDOW w AS (PARTITION BY code ORDER BY stat_date)) x WHERE prev > 0 AND holders / prev - 1 >= 0.2 AND stat_date - ps <= 120", "surge")
def w24(t):
    w = Window.partitionBy("code").orderBy("stat_date")
    d = t.holders.withColumn("prev", F.lag("holders").over(w)).withColumn("ps", F.lag("stat_date").over(w)).withColumn("surge", F.try_divide("holders", "prev") - 1)
    return d.where("prev > 0 and surge >= 0.2 and date_diff(stat_date, ps) <= 120").select("code", "stat_date", "surge")


@query("w25_report_decline", "SELECT code, pub_date, m - roe AS fall FROM (SELECT code, pub_date, roe, avg(roe) OVER (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY code ORDER BY pub_date) AS k FROM annual_reports) x WHERE k > 3 AND m >= 0.11 AND m - roe >= 0.005", "fall")
def w25(t):
    w = Window.partitionBy("code").orderBy("pub_date")
    d = t.annual_reports.withColumn("m", F.avg("roe").over(w.rowsBetween(-3, -1))).withColumn("k", F.row_number().over(w))
    return d.where("k > 3 and m >= 0.11 and m - roe >= 0.005").select("code", "pub_date", (F.col("m") - F.col("roe")).alias("fall"))


@query("w26_capex_transition", "SELECT code, pub_date FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pub_date) AS f FROM (SELECT code, pub_date, capex, max(capex) OVER w AS hi, min(capex) OVER w AS lo, count(*) OVER w AS n FROM annual_reports WINDOW w AS (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) x WHERE n = 3 AND lo > 0 AND capex <= 0.9*hi) y WHERE f = 1")
def w26(t):
    f = Window.partitionBy("code").orderBy("pub_date").rowsBetween(-3, -1)
    d = t.annual_reports.withColumn("hi", F.max("capex").over(f)).withColumn("lo", F.min("capex").over(f)).withColumn("n", F.count("*").over(f)).where("n = 3 and lo > 0 and capex <= 0.9 * hi")
    return d.groupBy("code").agg(F.min("pub_date").alias("pub_date"))


@query("w27_roe_anchor", "SELECT b.code, b.date, b.close / (f.c0 * pow(1 + r.m, (b.date - f.d0) / 365.25)) - 1 AS dev FROM bars b ASOF JOIN (SELECT code, pub_date, avg(roe) OVER (PARTITION BY code ORDER BY pub_date) AS m FROM annual_reports) r ON r.code = b.code AND r.pub_date <= b.date JOIN (SELECT code, min(date) AS d0, min_by(close, date) AS c0 FROM bars GROUP BY code) f ON f.code = b.code", "dev")
def w27(t):
    m = t.annual_reports.withColumn("m", F.avg("roe").over(Window.partitionBy("code").orderBy("pub_date").rowsBetween(Window.unboundedPreceding, 0))).select("code", "stat_date", "pub_date", "m")
    base = t.bars.groupBy("code").agg(F.min("date").alias("d0"), F.min_by("close", "date").alias("c0"))
    d = J.report_asof(t.bars.select("code", "date", "close"), m, "m").where("m is not null").join(base, "code")
    return d.select("code", "date", (F.col("close") / (F.col("c0") * F.pow(1 + F.col("m"), F.date_diff("date", "d0") / 365.25)) - 1).alias("dev"))


@query("w31_paid_share", "SELECT code, min(ex_date) AS paid FROM (SELECT d.code, d.ex_date, sum(d.dps) OVER (PARTITION BY d.code ORDER BY d.ex_date) AS s, f.c0 FROM dividends d JOIN (SELECT code, min_by(close, date) AS c0 FROM bars GROUP BY code) f ON f.code = d.code) x WHERE s >= 0.002 * c0 GROUP BY code")
def w31s(t):
    """The payback clock of 0.2 % of the first price, which dividends do reach here."""
    base = t.bars.groupBy("code").agg(F.min_by("close", "date").alias("c0"))
    s = F.sum("dps").over(Window.partitionBy("code").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0))
    return t.dividends.join(base, "code").withColumn("s", s).where("s >= 0.002 * c0").groupBy("code").agg(F.min("ex_date").alias("paid"))


@query("w31_payback_clock", "SELECT code, min(ex_date) AS paid FROM (SELECT d.code, d.ex_date, sum(d.dps) OVER (PARTITION BY d.code ORDER BY d.ex_date) AS s, f.c0 FROM dividends d JOIN (SELECT code, min_by(close, date) AS c0 FROM bars GROUP BY code) f ON f.code = d.code) x WHERE s >= c0 GROUP BY code")
def w31(t):
    base = t.bars.groupBy("code").agg(F.min_by("close", "date").alias("c0"))
    s = F.sum("dps").over(Window.partitionBy("code").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0))
    return t.dividends.join(base, "code").withColumn("s", s).where("s >= c0").groupBy("code").agg(F.min("ex_date").alias("paid"))
