"""Event studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import events as E
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import next_trading_row
from panelspark.queries import query
from panelspark.queries.factors import EPI, LIMITS, REV, flagged, series

ABN = LIMITS | {
    "ab": "SELECT f.*, ret - avg(ret) OVER (PARTITION BY f.date) AS abn FROM (SELECT *, close / pre - 1 AS ret FROM flags) f",
    "ev": "SELECT code, pos, date FROM (SELECT *, lag(flag) OVER (PARTITION BY code ORDER BY pos) AS prev FROM flags) x WHERE flag = 1 AND coalesce(prev, 9) <> 1",
    "pf": "SELECT code, pos, sum(coalesce(abn, 0)) OVER w AS s, count(abn) OVER w AS c FROM ab WINDOW w AS (PARTITION BY code ORDER BY pos)",
    "en": "SELECT e.code, e.pos, e.date, min(a.pos) AS entry_pos FROM ev e LEFT JOIN ab a ON a.code = e.code AND a.pos BETWEEN e.pos + 1 AND e.pos + 10 AND a.flag <> 1 GROUP BY e.code, e.pos, e.date",
    "cr": "SELECT n.code, n.pos, n.date, h.horizon, b.s - a.s - 0.002 AS car, b.c - a.c AS n_days FROM en n CROSS JOIN (VALUES (1), (5), (20)) h(horizon) JOIN pf a ON a.code = n.code AND a.pos = n.entry_pos LEFT JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos + h.horizon",
}


def abnormal(t):
    return flagged(t).withColumn("abn", X.cross_demean("ret"))


def locks(t):
    p = abnormal(t)
    e = p.withColumn("f", W.fresh_streak("flag", 1)).where("f").select("code", "pos", "date")
    return E.resolve_entries(e, p.select("code", "pos", "flag", "abn"), 1, 10), p


def cars(t):
    e, p = locks(t)
    return E.event_cars(e, p, [1, 5, 20], 0.002)


@query("e2_resolve_entries", "SELECT n.code, n.pos, n.entry_pos, n.entry_pos - n.pos AS wait, b.s - a.s AS missed FROM en n JOIN pf a ON a.code = n.code AND a.pos = n.pos LEFT JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos", "missed", extra=ABN)
def e2(t):
    return locks(t)[0].select("code", "pos", "entry_pos", "wait", "missed")


@query("e3_fixed_lag_entry", "SELECT r.code, r.pub_date, min(c.pos) AS entry_pos FROM annual_reports r JOIN calendar c ON c.date > r.pub_date GROUP BY r.code, r.pub_date")
def e3(t):
    return next_trading_row(t.annual_reports.select("code", "pub_date"), t.calendar, "pub_date").select("code", "pub_date", "entry_pos")


@query("e4_event_cars", "SELECT code, pos, horizon, car, n_days FROM cr", "car", extra=ABN)
def e4(t):
    return cars(t).select("code", "pos", "horizon", "car", "n_days")


FROZEN = {"lx": "SELECT code, pos, sum(ln(1 + greatest(coalesce(abn, 0), -0.999999))) OVER (PARTITION BY code ORDER BY pos) AS s FROM ab"}


@query("e5_frozen_log_car", "SELECT h.horizon, count(*) AS n, avg(exp(b.s - a.s) - 1) AS mean FROM en n CROSS JOIN (VALUES (5), (20)) h(horizon) JOIN lx a ON a.code = n.code AND a.pos = n.entry_pos JOIN lx b ON b.code = n.code AND b.pos = least(n.entry_pos + h.horizon, (SELECT max(pos) FROM calendar)) GROUP BY h.horizon", "mean", extra=ABN | FROZEN)
def e5(t):
    e, p = locks(t)
    return E.frozen_log_car(e, p, [5, 20]).groupBy("horizon").agg(F.count("*").alias("n"), F.avg("car").alias("mean"))


OWN = {
    "ow": "SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS pos FROM bars",
    "pa": "SELECT e.code, e.pos, e.close AS p0, w.pos AS row, w.close FROM ow e JOIN ow w ON w.code = e.code AND w.pos BETWEEN e.pos + 1 AND e.pos + 20",
    "py": "SELECT code, pos, any_value(p0) AS p0, max_by(close, row) AS pn, min_by(close, row) FILTER (close <= 0.925*p0) AS f0, min_by(close, row) FILTER (close <= 0.85*p0) AS f1 FROM pa GROUP BY code, pos",
}


@query("e7_e8_pyramid_vs_lump", "SELECT code, pos, 0.999*pn/p0 - 1 AS lump, (0.999*pn/p0 + coalesce(0.999*pn/f0, 1) + coalesce(0.999*pn/f1, 1))/3 - 1 AS pyramid, 1 + CAST(f0 IS NOT NULL AS INT) + CAST(f1 IS NOT NULL AS INT) AS filled FROM py", "lump pyramid", extra=OWN)
def e7(t):
    """Every traded row as an entry."""
    own = t.bars.withColumn("pos", F.row_number().over(Window.partitionBy("code").orderBy("date"))).select("code", "pos", "close")
    return E.pyramid_vs_lump(own.select("code", "pos"), own, 20, 0.001)


LAD = REV | EPI | {
    "lp": "SELECT e.series_id, e.pos, e.peak, e.x AS c0, i.pos AS row, i.x AS close, e.x AS p0, first_value(CASE WHEN i.x <= 0.7*e.peak THEN i.x END IGNORE NULLS) OVER w AS p1 FROM ep e JOIN ix i ON i.series_id = e.series_id AND i.pos BETWEEN e.pos AND e.pos + 100 WINDOW w AS (PARTITION BY e.series_id, e.pos ORDER BY i.pos)",
    "lv": "SELECT *, (close/p0 + coalesce(close/p1, 1.0))/2 AS v FROM lp",
}


@query("e9_e11_ladder", "SELECT series_id, pos, max_by(v, row) AS terminal, max_by(close, row)/any_value(c0) AS lump, max(row - pos) AS n_days, min(CASE WHEN row > pos AND v >= 1 THEN row - pos END) AS recovered FROM lv GROUP BY series_id, pos", "terminal lump", extra=LAD)
def e9(t):
    s = series(t)
    ep = W.drawdown_episodes(s, "x", 0.2, 100).withColumnRenamed("x", "close")
    return E.ladder_outcome(ep, s.withColumnRenamed("x", "close"), 100, (0.8, 0.7)).drop("fills")


@query("e12_q33_ipo_exit", "SELECT l.code, o/issue_price - 1 AS at_open, c5/issue_price - 1 AS at_5, c20/issue_price - 1 AS at_20 FROM listings l JOIN (SELECT code, max(open) FILTER (k = 1) AS o, max(close) FILTER (k = 5) AS c5, max(close) FILTER (k = 20) AS c20 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM supplier_days) x GROUP BY code) d USING (code)", "at_open at_5 at_20")
def e12(t):
    return E.ipo_exit_table(t.supplier_days, t.listings, (5, 20))


@query("e13_q34_limit_ladder", "SELECT code, level, CASE WHEN high/open - 1 >= level THEN level ELSE close/open - 1 END AS ret FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM supplier_days) x, (VALUES (0.02), (0.1), (0.3)) l(level) WHERE k = 1", "level ret")
def e13(t):
    return E.limit_ladder(E.listing_days(t.supplier_days).where("day = 1"), (0.02, 0.1, 0.3))


@query("e14_q35_touch_ladder", "SELECT code, d AS days, level, CASE WHEN c IS NOT NULL THEN CASE WHEN h >= o*(1 + level) THEN level ELSE c/o - 1 END END AS ret FROM (SELECT code, max(open) FILTER (k = 1) AS o, unnest([5, 20]) AS d, unnest([max(high) FILTER (k <= 5), max(high) FILTER (k <= 20)]) AS h, unnest([max(close) FILTER (k = 5), max(close) FILTER (k = 20)]) AS c FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM supplier_days) x GROUP BY code) z, (VALUES (0.1), (0.5)) l(level)", "level ret")
def e14(t):
    return E.ipo_touch_ladder(t.supplier_days, (5, 20), (0.1, 0.5))


@query("e15_best_level", "SELECT max_by(level, mean) AS level FROM (SELECT level, avg(CASE WHEN high/open - 1 >= level THEN level ELSE close/open - 1 END) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date) AS k FROM supplier_days) x, (VALUES (0.02), (0.1), (0.3)) l(level) WHERE k = 1 GROUP BY level) m", "level")
def e15(t):
    return e13(t).groupBy("level").agg(F.avg("ret").alias("mean")).agg(F.max_by("level", "mean").alias("level"))


@query("q19_e16_limit_up", "SELECT horizon, count(*) AS n, avg(car) AS mean, quantile_cont(car, 0.5) AS median, avg(car)/(stddev_samp(car)/sqrt(count(*))) AS t_event, avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) AS share, coalesce(avg(car) > 0 AND avg(car)/(stddev_samp(car)/sqrt(count(*))) > 2, false) AS adopted FROM cr WHERE car IS NOT NULL GROUP BY horizon", "mean median t_event share", extra=ABN)
def q19(t):
    s = A.event_summary(cars(t), "car", ("horizon",)).drop("t_month")
    return E.verdict(s, "mean", "t_event")
