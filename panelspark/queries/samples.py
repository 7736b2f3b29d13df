"""Studies by sub-sample: each event or day is reported in every sample that it belongs to, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators import events as E
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import windows as W
from panelspark.operators import xsection as X
from panelspark.operators.asof import asof_join, membership_asof, next_trading_row
from panelspark.queries import query
from panelspark.queries.books import RATES, SUMMARY, SUMMED, book_sql, summary
from panelspark.queries.events import ABN, abnormal
from panelspark.queries.factors import SCORES, Z, blended, rets, series
from panelspark.queries.joins import w24
from panelspark.queries.studies import SURGE, cap_sql, drift_sql

TOLD = "n mean median t_event share t_month"


def in_samples(df: DataFrame, samples: dict[str, Column]) -> DataFrame:
    """A row for each sample that a row belongs to; the same few for all, so rows grow by their number at most."""
    names = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in samples.items())), lambda x: x.isNotNull())
    return df.withColumn("sample", F.explode(names))


def told(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return A.event_summary(df, "car", by).select(*by, *TOLD.split())


def told_sql(rows: str, by: str) -> str:
    """event_summary of rows (by, date, car)."""
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))
    spread = lambda v: f"CASE WHEN count(*) >= 2 AND stddev_samp({v}) >= 1e-12 THEN avg({v})/(stddev_samp({v})/sqrt(count(*))) END"
    return f"SELECT a.*, t_month FROM (SELECT {by}, count(*) AS n, avg(car) AS mean, quantile_cont(car, 0.5) AS median, {spread('car')} AS t_event, avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) AS share FROM {rows} WHERE car IS NOT NULL GROUP BY {by}) a JOIN (SELECT {by}, {spread('m')} AS t_month FROM (SELECT {by}, date_trunc('month', date) AS p, avg(car) AS m FROM {rows} WHERE car IS NOT NULL GROUP BY {by}, p) z GROUP BY {by}) b ON {on}"


# Locked closes, up and down

COST, WAIT, VERDICT = 0.002, 10, 20
LOCKED = ABN | {
    "lev": "SELECT code, pos, date, dir FROM (SELECT *, lag(flag) OVER (PARTITION BY code ORDER BY pos) AS prev FROM flags) x, (VALUES (1), (-1)) d(dir) WHERE flag = dir AND coalesce(prev, 9) <> dir",
    "len": f"SELECT e.code, e.pos, e.date, e.dir, min(a.pos) AS entry_pos FROM lev e JOIN ab a ON a.code = e.code AND a.pos BETWEEN e.pos + 1 AND e.pos + {WAIT} AND a.flag <> e.dir GROUP BY e.code, e.pos, e.date, e.dir",
    "lmi": "SELECT n.*, n.entry_pos - n.pos AS wait, round(b.s - a.s, 9) AS missed FROM len n JOIN pf a ON a.code = n.code AND a.pos = n.pos JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos",
    "lcr": "SELECT n.*, h.horizon, round(b.s - a.s, 9) AS car, m.code IS NOT NULL AS inm FROM lmi n CROSS JOIN (VALUES (1), (5), (20)) h(horizon) JOIN pf a ON a.code = n.code AND a.pos = n.entry_pos LEFT JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos + h.horizon LEFT JOIN members m ON m.code = n.code AND m.date = n.date",
    "lte": "SELECT quantile_cont(missed, 1/3.0) AS q1, quantile_cont(missed, 2/3.0) AS q2 FROM lmi WHERE dir = 1",
    "lke": f"SELECT dir, horizon, 'gross' AS kind, code, date, wait, missed, inm, car FROM lcr UNION ALL SELECT dir, horizon, 'net' AS kind, code, date, wait, missed, inm, car - {COST} AS car FROM lcr",
    "lsa": "SELECT dir, horizon, kind, 'all' AS sample, date, car FROM lke UNION ALL SELECT dir, horizon, kind, unnest(list_filter([CASE WHEN code LIKE '%.688%' THEN 'width 20' ELSE 'width 10' END, CASE WHEN wait = 1 THEN 'wait 1' ELSE 'wait 2+' END, CASE WHEN missed <= q1 THEN 'missed small' WHEN missed <= q2 THEN 'missed mid' ELSE 'missed large' END, CASE WHEN date < DATE '1998-01-01' THEN 'early' ELSE 'late' END, CASE WHEN inm THEN 'member' ELSE 'other' END], lambda v: v IS NOT NULL)) AS sample, date, car FROM lke JOIN lte ON TRUE WHERE dir = 1 AND kind = 'net' AND horizon = 20",
}


def locked_cars(t):
    """(dir, code, pos, date, wait, missed, horizon, car) of fresh locks either way, entered at the first close free of them."""
    p = abnormal(t)

    def leg(d: int) -> DataFrame:
        e = p.withColumn("f", W.fresh_streak("flag", d)).where("f").select("code", "pos", "date")
        e = E.resolve_entries(e, p.select("code", "pos", "flag", "abn"), d, WAIT).where("entry_pos is not null")
        return E.event_cars(e.withColumn("missed", F.round("missed", 9)), p, [1, 5, VERDICT]).select(F.lit(d).alias("dir"), "code", "pos", "date", "wait", "missed", "horizon", F.round("car", 9).alias("car"))

    return leg(1).unionByName(leg(-1))


@query("q19_samples", told_sql("lsa", "dir, horizon, kind, sample"), "mean median t_event share t_month", extra=LOCKED)
def q19_samples(t):
    """Abnormal returns after locked closes: gross and net, up and down; for the verdict's horizon by width, wait, missed run, era and membership."""
    d = locked_cars(t)
    up = d.where(f"dir = 1 and horizon = {VERDICT}")
    low, high = A.exact_quantiles(up, "missed", [1 / 3, 2 / 3])  # one row an event, whether it has run its course or not
    members = membership_asof(t.calendar.select("date"), t.membership).select("date", "code", F.lit(True).alias("inm"))
    net = d.withColumn("car", F.col("car") - COST).withColumn("kind", F.lit("net"))
    whole = d.withColumn("kind", F.lit("gross")).unionByName(net).withColumn("sample", F.lit("all"))
    m = F.col("missed")
    parts = in_samples(net.where(f"dir = 1 and horizon = {VERDICT}").join(members, ["date", "code"], "left"), {
        "width 20": F.col("code").contains(".688"), "width 10": ~F.col("code").contains(".688"), "wait 1": F.col("wait") == 1, "wait 2+": F.col("wait") > 1,
        "missed small": m <= F.lit(low), "missed mid": (m > F.lit(low)) & (m <= F.lit(high)), "missed large": m > F.lit(high),
        "early": F.col("date") < "1998-01-01", "late": F.col("date") >= "1998-01-01", "member": F.col("inm"), "other": F.col("inm").isNull(),
    }).drop("inm")
    return told(whole.unionByName(parts), ("dir", "horizon", "kind", "sample"))


@query("q19_robustness", f"SELECT tag, n_periods, mean, t FROM (SELECT tag, count(*) AS n_periods, avg(m) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(m) >= 1e-12 THEN avg(m)/(stddev_samp(m)/sqrt(count(*))) END AS t FROM (SELECT tag, date_trunc('month', date) AS p, avg(least(greatest(car, lo), hi)) AS m FROM lwn, (SELECT 'winsorized 1' AS tag, quantile_cont(car, 0.01) AS lo, quantile_cont(car, 0.99) AS hi FROM lwn UNION ALL SELECT 'winsorized 5', quantile_cont(car, 0.05), quantile_cont(car, 0.95) FROM lwn) q GROUP BY 1, 2) x GROUP BY tag) y UNION ALL SELECT 'signs', count(*) FILTER (car <> 0), avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END) FILTER (car <> 0), NULL FROM lwn UNION ALL SELECT 'years', count(*), avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), NULL FROM (SELECT year(date) AS y, avg(car) AS m FROM lwn GROUP BY 1) z", "mean t", extra=LOCKED | {
    "lwn": f"SELECT date, car - {COST} AS car FROM lcr WHERE dir = 1 AND horizon = {VERDICT} AND car IS NOT NULL",
})
def q19_robustness(t):
    """The verdict's return cut at its ends, how often it is positive, and in how many years."""
    d = locked_cars(t).where(f"dir = 1 and horizon = {VERDICT} and car is not null").select("date", (F.col("car") - COST).alias("car"))
    rows = lambda tag, df: df.select(F.lit(tag).alias("tag"), "n_periods", "mean", "t")
    none = F.lit(None).cast("double").alias("t")
    cut = [rows(f"winsorized {k}", A.winsorized_clustered_t(d, "car", k / 100, 1 - k / 100)) for k in (1, 5)]
    signs = d.where("car <> 0").agg(F.count("*").alias("n_periods"), F.avg((F.col("car") > 0).cast("double")).alias("mean"), none)
    years = d.groupBy(F.year("date").alias("y")).agg(F.avg("car").alias("m")).agg(F.count("*").alias("n_periods"), F.avg((F.col("m") > 0).cast("double")).alias("mean"), none)
    return cut[0].unionByName(cut[1]).unionByName(rows("signs", signs)).unionByName(rows("years", years))


# Timing by a balance

TIMED = [("frozen", 0.2, 0.8), ("20/70", 0.2, 0.7), ("20/90", 0.2, 0.9), ("40/70", 0.4, 0.7), ("40/90", 0.4, 0.9)]
SPANS = [("all", "1990-01-01", "2100-12-31"), ("early", "1990-01-01", "1997-12-31"), ("late", "1998-01-01", "2100-12-31")]
SPAN_SQL = "(VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in SPANS) + ") e(era, lo, hi)"


def timed_sql() -> dict[str, str]:
    one = lambda v, a, s: f"SELECT '{v}' AS variant, *, CASE WHEN count(x) OVER w >= 20 THEN quantile_cont(x, {a}) OVER w END AS lo, CASE WHEN count(x) OVER w >= 20 THEN quantile_cont(x, {s}) OVER w END AS hi, x - lag(x, 5) OVER (ORDER BY pos) AS chg FROM mx WINDOW w AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"
    w = "PARTITION BY variant ORDER BY pos"
    return {
        "mx": "SELECT date, row_number() OVER (ORDER BY date) AS pos, close AS x FROM index_series",
        "mq": " UNION ALL ".join(one(*v) for v in TIMED),
        "ma": f"SELECT *, max(CASE WHEN x <= lo THEN pos END) OVER ({w}) AS armed, max(CASE WHEN chg > 0 THEN pos END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM mq",
        "ms0": f"SELECT *, coalesce(last_value(CASE WHEN x >= hi THEN 0 WHEN chg > 0 AND armed > coalesce(up, -1) THEN 1 END IGNORE NULLS) OVER ({w}), 0) AS state FROM ma",
        "mst": "SELECT variant, date, pos, state FROM ms0 UNION ALL SELECT 'entry only' AS variant, date, pos, max(state) OVER (ORDER BY pos) AS state FROM ms0 WHERE variant = 'frozen' UNION ALL SELECT 'exit only' AS variant, date, pos, CASE WHEN coalesce(x >= hi, false) THEN 0 ELSE 1 END AS state FROM ms0 WHERE variant = 'frozen'",
        "uni": "SELECT date, avg(ret) AS r FROM rets GROUP BY date",
        "mnet": f"SELECT variant, date, pos, coalesce(r, 0) AS r, p2, p2 * coalesce(r, 0) - CASE WHEN p1 > p2 THEN (p1 - p2) * {RATES[0]} ELSE (p2 - p1) * {RATES[1]} END AS net FROM (SELECT s.*, r, coalesce(lag(state, 1) OVER (PARTITION BY variant ORDER BY pos), 0) AS p1, coalesce(lag(state, 2) OVER (PARTITION BY variant ORDER BY pos), 0) AS p2 FROM mst s JOIN uni u ON u.date = s.date) a",
        "mera": f"SELECT * FROM mnet JOIN {SPAN_SQL} ON date BETWEEN lo AND hi",
    }


@query("q24_arms", "SELECT a.*, t_month FROM (SELECT variant, era, sum(ln(1 + net)) AS timed, sum(ln(1 + r)) AS hold, avg(net)/stddev_samp(net)*sqrt(252.0) AS sharpe, avg(r)/stddev_samp(r)*sqrt(252.0) AS sharpe_hold, avg(p2) AS days_in FROM mera GROUP BY variant, era) a JOIN (SELECT variant, era, avg(m)/(stddev_samp(m)/sqrt(count(*))) AS t_month FROM (SELECT variant, era, date_trunc('month', date) AS p, avg(net - r) AS m FROM mera GROUP BY 1, 2, 3) z GROUP BY variant, era) b ON a.variant = b.variant AND a.era = b.era", "timed hold sharpe sharpe_hold days_in t_month", extra=timed_sql())
def q24_arms(t):
    """A market timed by a balance against holding it: the frozen rule, its entries and exits alone, other thresholds, and eras. Wealth as log growth."""
    s = series(t).select("series_id", "date", "pos", "x")
    arms = [W.threshold_reversal_state(s, arm=a, sell=b).select(F.lit(v).alias("variant"), "date", "pos", "state", "x", "q_hi") for v, a, b in TIMED]
    frozen, w = arms[0], Window.partitionBy("variant").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    legs = [frozen.withColumn("state", F.max("state").over(w)).withColumn("variant", F.lit("entry only")), frozen.withColumn("state", 1 - F.coalesce(F.col("x") >= F.col("q_hi"), F.lit(False)).cast("int")).withColumn("variant", F.lit("exit only"))]
    d = arms[0]
    for x in arms[1:] + legs:
        d = d.unionByName(x)
    r = rets(t).groupBy("date").agg(F.avg("ret").alias("r"))
    d = W.lagged_position_cost(d.join(F.broadcast(r), "date"), "state", "r", *RATES, keys=("variant",)).withColumn("r", F.coalesce("r", F.lit(0.0)))
    eras = t.spark.createDataFrame(SPANS, "era string, lo string, hi string").select("era", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    d = d.join(F.broadcast(eras), F.col("date").between(F.col("lo"), F.col("hi"))).withColumn("active", F.col("net") - F.col("r"))
    by = ("variant", "era")
    g = d.groupBy(*by).agg(F.sum(F.log1p("net")).alias("timed"), F.sum(F.log1p("r")).alias("hold"), A.sharpe_of("net").alias("sharpe"), A.sharpe_of("r").alias("sharpe_hold"), F.avg("pos2").alias("days_in"))
    return g.join(A.clustered_t(d, "active", by=by).select(*by, F.col("t").alias("t_month")), list(by))


# Selection by weighting

CELLS = [("value equal", "v", 0), ("value inverse 60", "v", 60), ("blend equal", "b", 0), ("blend inverse 60", "b", 60), ("value inverse 20", "v", 20), ("value inverse 120", "v", 120)]


def cells_sql() -> dict[str, str]:
    sized = cap_sql("SELECT variant, date, code, i / sum(i) OVER (PARTITION BY variant, date) AS w FROM (SELECT s.variant, s.date, s.code, coalesce(1/coalesce(sg, md), 1.0) AS i FROM csz s JOIN (SELECT variant, date, quantile_cont(sg, 0.5) AS md FROM csz GROUP BY variant, date) m ON m.date = s.date AND m.variant = s.variant) a")
    sized = {k: v.replace("PARTITION BY date", "PARTITION BY variant, date").replace("SELECT date, code, CASE", "SELECT variant, date, code, CASE") for k, v in sized.items()}
    sigma = ", ".join(f"CASE WHEN count(ret) OVER w{n} >= 2 THEN stddev_samp(ret) OVER w{n} END AS s{n}" for n in (20, 60, 120))
    frames = ", ".join(f"w{n} AS (PARTITION BY code ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (20, 60, 120))
    rows = " UNION ALL ".join(f"SELECT '{v}' AS variant, date, code, {f'CASE WHEN s{n} >= 0.0001 THEN s{n} END' if n else 'CAST(1 AS DOUBLE)'} AS sg FROM cpk WHERE {'pv' if k == 'v' else 'pb'} <= 5" for v, k, n in CELLS)
    return SCORES | Z | sized | {
        "csg": f"SELECT date, code, {sigma} FROM rets WINDOW {frames}",
        "cpk": "SELECT z.*, s20, s60, s120 FROM (SELECT m.date, m.code, CASE WHEN ey IS NOT NULL THEN row_number() OVER (PARTITION BY m.date, ey IS NULL ORDER BY ey DESC, m.code) END AS pv, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY m.date, score IS NULL ORDER BY round(score, 9) DESC, m.code) END AS pb FROM ms m JOIN zz ON zz.date = m.date AND zz.code = m.code) z JOIN csg g ON g.date = z.date AND g.code = z.code",
        "csz": rows,
    } | book_sql("SELECT variant, date, code, w FROM wc", "SELECT variant, date FROM month_ends, (VALUES " + ", ".join(f"('{v}')" for v, _, _ in CELLS) + ") v(variant)", weight="w")


@query("q8_cells", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=cells_sql())
def q8_cells(t):
    """Two selections by two weightings, and the weighting's memory: 20, 60 or 120 rows."""
    sigma = rets(t).withColumns({f"s{n}": W.trailing(F.stddev_samp, "ret", n, 2) for n in (20, 60, 120)}).select("date", "code", "s20", "s60", "s120")
    d = blended(t).withColumns({"pv": X.place("ey"), "pb": X.place(F.round("score", 9))}).join(sigma, ["date", "code"])
    cell = lambda v, k, n: F.when(F.col("pv" if k == "v" else "pb") <= 5, F.struct(F.lit(v).alias("variant"), (F.col(f"s{n}") if n else F.lit(1.0)).alias("sigma")))
    d = d.select("date", "code", F.explode(F.filter(F.array(*(cell(*c) for c in CELLS)), lambda x: x.isNotNull())).alias("x")).select("x.variant", "date", "code", "x.sigma")
    by = ("variant", "date")
    m = X.weight_cap(X.inverse_vol_weights(d, by=by), by=by).select("variant", "date", "code", "w")
    sig = t.month_ends.crossJoin(F.broadcast(t.spark.createDataFrame([(v,) for v, _, _ in CELLS], "variant string")))
    return summary(B.ew_portfolio(m, sig, rets(t), t.calendar, RATES, weight="w")[0].join(F.broadcast(t.calendar), "pos"))


# Holders

HELD = drift_sql(SURGE.replace("SELECT code, CAST(stat_date + 30 AS DATE) AS pub_date FROM", "SELECT code, CAST(stat_date + 30 AS DATE) AS pub_date, round(holders / prev - 1, 9) AS surge, ps, stat_date FROM")) | {
    "hpx": "SELECT e.*, b1.close / b0.close - 1 AS ival FROM de e JOIN bars b0 ON b0.code = e.code AND b0.date = e.ps JOIN bars b1 ON b1.code = e.code AND b1.date = e.stat_date",
    "hte": "SELECT quantile_cont(surge, 1/3.0) AS q1, quantile_cont(surge, 2/3.0) AS q2 FROM (SELECT x.surge FROM hpx x JOIN dp ON dp.code = x.code AND dp.pub_date = x.pub_date) z",
    "hcr": "SELECT h.horizon, x.pub_date AS date, surge, ival, round(b.s - a.s, 9) AS car FROM hpx x JOIN dp n ON n.code = x.code AND n.pub_date = x.pub_date CROSS JOIN (VALUES (20), (60)) h(horizon) JOIN pf a ON a.code = n.code AND a.pos = n.entry_pos LEFT JOIN pf b ON b.code = n.code AND b.pos = n.entry_pos + h.horizon",
    "hsa": "SELECT horizon, 'all' AS sample, date, car FROM hcr UNION ALL SELECT horizon, unnest([CASE WHEN surge <= q1 THEN 'mild' WHEN surge <= q2 THEN 'middle' ELSE 'severe' END, CASE WHEN ival > 0 THEN 'rally' ELSE 'decline' END, CASE WHEN date < DATE '1998-01-01' THEN 'early' ELSE 'late' END]) AS sample, date, car FROM hcr JOIN hte ON TRUE",
}


@query("q31_samples", told_sql("hsa", "horizon, sample"), "mean median t_event share t_month", extra=HELD)
def q31_samples(t):
    """Drift after a surge of holders, by its size, by what the price did while they came, and by era."""
    h = t.holders.select("code", "stat_date", "holders")
    w = Window.partitionBy("code").orderBy("stat_date")
    h = h.withColumns({"prev": F.lag("holders").over(w), "ps": F.lag("stat_date").over(w)}).withColumn("surge", F.round(F.col("holders") / F.col("prev") - 1, 9))
    ev = w24(t).select("code", "stat_date").join(h.select("code", "stat_date", "ps", "surge"), ["code", "stat_date"])
    closes = t.bars.select("code", F.col("date").alias("at"), "close")
    for name, on in (("c0", "ps"), ("c1", "stat_date")):  # the last close up to each report's own date
        ev = asof_join(ev, closes.withColumnRenamed("close", name), ["code"], on, "at").drop("at")
    ev = ev.withColumn("ival", F.col("c1") / F.col("c0") - 1).withColumn("pub_date", F.date_add("stat_date", 30)).drop("c0", "c1")
    c = E.event_cars(next_trading_row(ev, t.calendar, "pub_date"), abnormal(t), [20, 60]).withColumn("date", F.col("pub_date")).withColumn("car", F.round("car", 9))
    low, high = A.exact_quantiles(c.where("horizon = 20"), "surge", [1 / 3, 2 / 3])
    s = F.col("surge")
    d = in_samples(c, {
        "all": F.lit(True), "mild": s <= F.lit(low), "middle": (s > F.lit(low)) & (s <= F.lit(high)), "severe": s > F.lit(high), "rally": F.col("ival") > 0, "decline": F.col("ival") <= 0,
        "early": F.col("date") < "1998-01-01", "late": F.col("date") >= "1998-01-01",
    })
    return told(d, ("horizon", "sample"))
