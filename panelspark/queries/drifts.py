"""Drift after reports by sample and threshold, deviations from an anchor, own-history timing by bucket, ladders over bucket indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import events as E
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import next_trading_row
from panelspark.operators.order import sliding_quantiles
from panelspark.queries import query
from panelspark.queries.books import RATES, SUMMARY, SUMMED, book_sql, summary
from panelspark.queries.events import ABN, abnormal
from panelspark.queries.factors import SCORES, month_scores, rets
from panelspark.queries.grids import WINDOW_SQL, windows
from panelspark.queries.joins import w25, w27
from panelspark.queries.samples import in_samples, told, told_sql


def after(t, events: DataFrame, horizons: tuple[int, ...] = (20, 60)) -> DataFrame:
    """events (code, pub_date, ..) with horizon, car and date: abnormal returns from the row after each publication."""
    c = E.event_cars(next_trading_row(events, t.calendar, "pub_date"), abnormal(t), list(horizons))
    return c.withColumn("date", F.col("pub_date")).withColumn("car", F.round("car", 9))


def after_sql(events: str) -> dict[str, str]:
    """dx: events with horizon, date and car."""
    return ABN | {
        "de": events,
        "dq": "SELECT e.code, e.pub_date, min(c.pos) AS entry_pos FROM (SELECT DISTINCT code, pub_date FROM de) e JOIN calendar c ON c.date > e.pub_date GROUP BY e.code, e.pub_date",
        "dx": "SELECT h.horizon, e.*, e.pub_date AS date, round(b.s - a.s, 9) AS car FROM de e JOIN dq n ON n.code = e.code AND n.pub_date = e.pub_date CROSS JOIN (VALUES (20), (60)) h(horizon) JOIN pf a ON a.code = n.code AND a.pos = n.entry_pos LEFT JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos + h.horizon",
    }


TOLD = "mean median t_event share t_month"
FELL = "SELECT code, pub_date, round(m - roe, 9) AS fall FROM (SELECT code, pub_date, roe, avg(roe) OVER (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m, row_number() OVER (PARTITION BY code ORDER BY pub_date) AS k FROM annual_reports) x WHERE k > 3 AND m >= 0.11 AND m - roe >= 0.005"


@query("q29_samples", told_sql("ds", "horizon, sample"), TOLD, extra=after_sql(FELL) | {
    "dt": "SELECT quantile_cont(fall, 1/3.0) AS q1, quantile_cont(fall, 2/3.0) AS q2 FROM (SELECT fall FROM dx WHERE horizon = 20) z",
    "ds": "SELECT horizon, date, car, unnest(['all', CASE WHEN fall <= q1 THEN 'mild' WHEN fall <= q2 THEN 'middle' ELSE 'severe' END, CASE WHEN date < DATE '1999-01-01' THEN 'early' ELSE 'late' END]) AS sample FROM dx JOIN dt ON TRUE",
})
def q29(t):
    """Drift after a fall of the return on equity, by its size and by era."""
    c = after(t, w25(t).withColumn("fall", F.round("fall", 9)))
    low, high = A.exact_quantiles(c.where("horizon = 20"), "fall", [1 / 3, 2 / 3])
    f = F.col("fall")
    return told(in_samples(c, {"all": F.lit(True), "mild": f <= F.lit(low), "middle": (f > F.lit(low)) & (f <= F.lit(high)), "severe": f > F.lit(high), "early": F.col("date") < "1999-01-01", "late": F.col("date") >= "1999-01-01"}), ("horizon", "sample"))


CUTS = (0.95, 0.9, 0.8, 0.6)


@query("q32_sensitivity", told_sql("dx", "horizon, cut"), f"cut {TOLD}", extra=after_sql("SELECT cut, code, min(pub_date) AS pub_date FROM (SELECT code, pub_date, capex, max(capex) OVER w AS hi, min(capex) OVER w AS lo, count(*) OVER w AS n FROM annual_reports WINDOW w AS (PARTITION BY code ORDER BY pub_date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) x, (VALUES " + ", ".join(f"({c}::DOUBLE)" for c in CUTS) + ") v(cut) WHERE n = 3 AND lo > 0 AND capex <= cut*hi GROUP BY cut, code"))
def q32(t):
    """Drift after the first report with spending below a share of its peak, for four shares."""
    f = Window.partitionBy("code").orderBy("pub_date").rowsBetween(-3, -1)
    d = t.annual_reports.withColumns({"hi": F.max("capex").over(f), "lo": F.min("capex").over(f), "n": F.count("*").over(f)}).where("n = 3 and lo > 0")
    d = d.withColumn("cut", F.explode(F.array(*map(F.lit, CUTS)))).where(F.col("capex") <= F.col("cut") * F.col("hi"))
    return told(after(t, d.groupBy("cut", "code").agg(F.min("pub_date").alias("pub_date"))), ("horizon", "cut"))


PAID = (0.0005, 0.001, 0.002, 1.0)


@query("q32_payback", "SELECT part, count(*) AS names, count(years) AS paid, avg(years) AS years, quantile_cont(years, 0.5) AS median FROM (SELECT part, f.code, min(CASE WHEN s >= part*c0 THEN date_diff('day', d0, ex_date) END) / 365.25 AS years FROM (SELECT code, min(date) AS d0, min_by(close, date) AS c0 FROM bars GROUP BY code) f CROSS JOIN (VALUES " + ", ".join(f"({p}::DOUBLE)" for p in PAID) + ") v(part) LEFT JOIN (SELECT code, ex_date, sum(dps) OVER (PARTITION BY code ORDER BY ex_date) AS s FROM dividends) d ON d.code = f.code GROUP BY part, f.code) z GROUP BY part", "part years median")
def q32_payback(t):
    """Years until dividends have paid back a part of the first price; the whole price is not reached here."""
    base = t.bars.groupBy("code").agg(F.min("date").alias("d0"), F.min_by("close", "date").alias("c0")).withColumn("part", F.explode(F.array(*map(F.lit, PAID))))
    paid = t.dividends.withColumn("s", F.sum("dps").over(Window.partitionBy("code").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0))).select("code", "ex_date", "s")
    d = base.join(paid, "code", "left").groupBy("part", "code").agg((F.min(F.when(F.col("s") >= F.col("part") * F.col("c0"), F.date_diff("ex_date", "d0"))) / 365.25).alias("years"))
    return d.groupBy("part").agg(F.count("*").alias("names"), F.count("years").alias("paid"), F.avg("years").alias("years"), F.percentile("years", F.lit(0.5)).alias("median"))


# Deviation from an anchor

ANCHOR = "SELECT b.code, b.date, round(b.close / (f.c0 * pow(1 + r.m, (b.date - f.d0) / 365.25)) - 1, 9) AS dev FROM bars b ASOF JOIN (SELECT code, pub_date, avg(roe) OVER (PARTITION BY code ORDER BY pub_date) AS m FROM annual_reports) r ON r.code = b.code AND r.pub_date <= b.date JOIN (SELECT code, min(date) AS d0, min_by(close, date) AS c0 FROM bars GROUP BY code) f ON f.code = b.code"


@query("q28_anchor_ic", f"SELECT label, count(*) AS n, avg(x) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(x) >= 1e-12 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END AS t, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM aic JOIN {WINDOW_SQL} ON date BETWEEN lo AND hi GROUP BY label", "mean t hit", extra=SCORES | {
    "dev": ANCHOR,
    "ark": "SELECT s.date, rank() OVER (PARTITION BY s.date ORDER BY -dev) + (count(*) OVER (PARTITION BY s.date, dev) - 1)/2.0 AS a, rank() OVER (PARTITION BY s.date ORDER BY fwd) + (count(*) OVER (PARTITION BY s.date, fwd) - 1)/2.0 AS b FROM ms s JOIN dev ON dev.date = s.date AND dev.code = s.code WHERE fwd IS NOT NULL AND dev IS NOT NULL",
    "aic": "SELECT date, round(corr(a, b), 9) AS x FROM ark GROUP BY date HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL",
})
def q28(t):
    """Whether names below their anchor return more: rank correlation in regimes, halves and years."""
    d = w27(t).join(month_scores(t), ["date", "code"]).withColumn("v", -F.round("dev", 9))
    return A.in_windows(X.rank_ic(d, "v", "fwd").select("date", F.round("ic", 9).alias("x")), "x", windows(t), ())


LEAST = 10


@query("x14_quintile_shape", "SELECT q, count(*) AS n_periods, avg(m) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(m) >= 1e-12 THEN avg(m)/(stddev_samp(m)/sqrt(count(*))) END AS t FROM (SELECT q, date_trunc('month', date) AS k, avg(car) AS m FROM shq GROUP BY 1, 2) c GROUP BY q", "mean t", extra=ABN | {
    "dev": ANCHOR,
    "sha": "SELECT d.code, d.date, c.pos, dev, row_number() OVER (PARTITION BY d.date ORDER BY dev, d.code) - 1 AS r, count(*) OVER (PARTITION BY d.date) AS n FROM dev d JOIN month_ends USING (date) JOIN calendar c ON c.date = d.date WHERE dev IS NOT NULL",
    "shq": f"SELECT greatest(0, CAST(ceil(r*5.0/greatest(n - 1, 1)) AS INT) - 1) AS q, h.date, round(b.s - a.s, 9) AS car FROM sha h JOIN pf a ON a.code = h.code AND a.pos = h.pos JOIN pf b ON b.code = h.code AND b.pos = h.pos + 20 WHERE n >= {LEAST}",
})
def x14(t):
    """Mean abnormal return of the 20 rows after each month end by fifth of the deviation, t across months; months with too few names are left out."""
    d = w27(t).withColumn("dev", F.round("dev", 9)).where("dev is not null").join(F.broadcast(t.month_ends), "date").join(F.broadcast(t.calendar), "date")
    d = d.withColumn("q", X.quantile_bin("dev", 5)).withColumn("n", F.count("*").over(Window.partitionBy("date"))).where(F.col("n") >= LEAST)
    c = E.event_cars(d.select("code", "date", "q", F.col("pos").alias("entry_pos")), abnormal(t), [20]).withColumn("car", F.round("car", 9)).where("car is not null")
    return A.clustered_t(c, "car", by=("q",)).select("q", "n_periods", "mean", "t")


# Own history by bucket

ARMS, SLEEVES = ("inverse", "mirror", "all"), ("all", "00", "30", "60", "68")


@query("q22_arms", f"SELECT {SUMMED} FROM vp", SUMMARY, extra={
    "pq": "SELECT code, date, close, round(pe_ttm, 4) AS pe, pos FROM dense",
    "pw": "SELECT *, CASE WHEN count(CASE WHEN pe > 0 THEN pe END) OVER w >= 5 THEN round(quantile_cont(CASE WHEN pe > 0 THEN pe END, 0.7) OVER w, 6) END AS q70, CASE WHEN count(CASE WHEN pe > 0 THEN pe END) OVER w >= 5 THEN round(quantile_cont(CASE WHEN pe > 0 THEN pe END, 0.3) OVER w, 6) END AS q30 FROM pq WINDOW w AS (PARTITION BY code ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
    "ph": "SELECT code, date, close, coalesce(last_value(CASE WHEN pe > 0 AND pe <= q30 THEN 0 WHEN pe < 0 OR pe >= q70 THEN 1 END IGNORE NULLS) OVER w, 0) AS inverse, coalesce(last_value(CASE WHEN pe < 0 OR pe >= q70 THEN 0 WHEN pe > 0 AND pe <= q30 THEN 1 END IGNORE NULLS) OVER w, 0) AS mirror FROM pw WINDOW w AS (PARTITION BY code ORDER BY pos)",
    "pv": "SELECT a.arm || ' ' || s.sleeve AS variant, p.date, p.code FROM ph p JOIN month_ends USING (date) JOIN industry i ON i.code = p.code CROSS JOIN (VALUES ('inverse'), ('mirror'), ('all')) a(arm) CROSS JOIN (VALUES ('all'), ('00'), ('30'), ('60'), ('68')) s(sleeve) WHERE close IS NOT NULL AND (arm = 'all' OR (arm = 'inverse' AND inverse = 1) OR (arm = 'mirror' AND mirror = 1)) AND (sleeve = 'all' OR sleeve = bucket)",
} | book_sql("SELECT variant, date, code FROM pv", "SELECT a.arm || ' ' || s.sleeve AS variant, date FROM month_ends CROSS JOIN (VALUES ('inverse'), ('mirror'), ('all')) a(arm) CROSS JOIN (VALUES ('all'), ('00'), ('30'), ('60'), ('68')) s(sleeve)"))
def q22(t):
    """Held on a high multiple and sold on a low one, the mirror of that, and holding all; whole and by bucket."""
    d = W.densify_panel(t.bars, t.calendar, t.codes).select("code", "date", "pos", "close", F.round("pe_ttm", 4).alias("pe")).withColumn("own", F.when(F.col("pe") > 0, F.col("pe")))
    d = sliding_quantiles(d, {"q70": ("own", 0.7, 60, 5), "q30": ("own", 0.3, 60, 5)}).withColumns({c: F.round(c, 6) for c in ("q70", "q30")})
    high, low = (F.col("pe") < 0) | (F.col("pe") >= F.col("q70")), (F.col("pe") > 0) & (F.col("pe") <= F.col("q30"))
    d = d.withColumns({"inverse": W.state_hold(high, low), "mirror": W.state_hold(low, high)}).join(F.broadcast(t.month_ends), "date").where("close is not null").join(F.broadcast(t.industry), "code")
    arms = F.filter(F.array(F.lit("all"), F.when(F.col("inverse") == 1, "inverse"), F.when(F.col("mirror") == 1, "mirror")), lambda x: x.isNotNull())
    sleeves = F.filter(F.array(F.lit("all"), F.col("bucket")), lambda x: x.isNotNull())
    m = d.select("date", "code", F.explode(arms).alias("arm"), sleeves.alias("s")).select("date", "code", "arm", F.explode("s").alias("sleeve")).select(F.concat_ws(" ", "arm", "sleeve").alias("variant"), "date", "code")
    v = t.spark.createDataFrame([(f"{a} {s}",) for a in ARMS for s in SLEEVES], "variant string")
    return summary(B.ew_portfolio(m, t.month_ends.crossJoin(F.broadcast(v)), rets(t), t.calendar, RATES)[0].join(F.broadcast(t.calendar), "pos"))


# Ladders over bucket indices

HORIZON, PEAK = 250, 250
CREED = {
    "bx": "SELECT bucket AS series_id, b.date, c.pos, avg(close) AS x FROM bars b JOIN industry i ON i.code = b.code JOIN calendar c ON c.date = b.date WHERE bucket IS NOT NULL GROUP BY bucket, b.date, c.pos",
    "bp": f"SELECT *, max(x) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {PEAK - 1} PRECEDING AND CURRENT ROW) AS peak FROM bx",
    "bm": "SELECT *, CASE WHEN x <= 0.8*peak THEN 1 WHEN x >= 0.95*peak THEN 0 END AS mark FROM bp",
    "bo": "SELECT * FROM (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM bm) z WHERE mark = 1 AND prev = 0",
    "bl": f"SELECT e.series_id, e.pos, e.x AS c0, i.pos AS row, i.x AS close, e.x AS p0, first_value(CASE WHEN i.x <= 0.7*e.peak THEN i.x END IGNORE NULLS) OVER w AS p1, first_value(CASE WHEN i.x <= 0.6*e.peak THEN i.x END IGNORE NULLS) OVER w AS p2 FROM bo e JOIN bx i ON i.series_id = e.series_id AND i.pos BETWEEN e.pos AND e.pos + {HORIZON} WINDOW w AS (PARTITION BY e.series_id, e.pos ORDER BY i.pos)",
    "bv": "SELECT *, (close/p0 + coalesce(close/p1, 1.0) + coalesce(close/p2, 1.0))/3 AS v FROM bl",
    "be": "SELECT series_id, pos, max_by(v, row) AS terminal, max_by(close, row)/any_value(c0) AS lump, max(row) AS last, max(1 + CAST(p1 IS NOT NULL AS INT) + CAST(p2 IS NOT NULL AS INT)) AS fills, min(CASE WHEN row > pos AND v >= 1 THEN row - pos END) AS recovered FROM bv GROUP BY series_id, pos",
    "bb": "SELECT c.pos, i.close FROM index_series i JOIN calendar c ON c.date = i.date",
}


@query("q26_buckets", "SELECT series_id, count(*) AS episodes, count(recovered) AS whole_again, avg(recovered) AS days, avg(fills) AS fills, avg(terminal) AS terminal, avg(lump) AS lump, avg(z.close / a.close) AS benchmark FROM be JOIN bb a ON a.pos = be.pos JOIN bb z ON z.pos = be.last GROUP BY series_id", "days fills terminal lump benchmark", extra=CREED)
def q26(t):
    """Buying a bucket's index in three steps as it falls: how often and how soon the account is whole again, against one purchase and against all names."""
    s = t.bars.join(F.broadcast(t.industry), "code").where("bucket is not null").groupBy(F.col("bucket").alias("series_id"), "date").agg(F.avg("close").alias("close")).join(F.broadcast(t.calendar), "date")
    ep = W.drawdown_episodes(s, "close", 0.2, PEAK)
    out = E.ladder_outcome(ep, s, HORIZON).withColumn("last", F.col("pos") + F.col("n_days"))
    i = t.index_series.join(F.broadcast(t.calendar), "date").select("pos", "close")
    out = out.join(F.broadcast(i.withColumnRenamed("close", "i0")), "pos").join(F.broadcast(i.select(F.col("pos").alias("last"), F.col("close").alias("i1"))), "last")  # a row a trading day
    return out.groupBy("series_id").agg(F.count("*").alias("episodes"), F.count("recovered").alias("whole_again"), F.avg("recovered").alias("days"), F.avg("fills").alias("fills"), F.avg("terminal").alias("terminal"), F.avg("lump").alias("lump"), F.avg(F.col("i1") / F.col("i0")).alias("benchmark"))
