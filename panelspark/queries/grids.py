"""Studies of many variants: each is one job, with a variant or a window as a column."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import asof as J
from panelspark.operators import portfolio as B
from panelspark.operators import stats as A
from panelspark.operators import xsection as X
from panelspark.operators.asof import membership_asof
from panelspark.operators.order import correlations
from panelspark.queries import query
from panelspark.queries.books import RATES, SUMMARY, SUMMED, book_sql, summary
from panelspark.queries.factors import SCORES, Z, blended, fold_sql, month_scores, rets
from panelspark.queries.live import FACTORS, FIVE, five_factors
from panelspark.queries.reports import OWN, own_history
from panelspark.queries.stats import IXR, ixr
from panelspark.plans import ml

# Decay of the deployed signal

#: Windows of the panel's years: all, three regimes, two halves, and each year.
WINDOWS = [("full", "1990-01-01", "2100-12-31"), ("first", "1990-01-01", "1996-12-31"), ("second", "1997-01-01", "1998-12-31"), ("third", "1999-01-01", "2100-12-31"), ("early", "1990-01-01", "1997-12-31"), ("late", "1998-01-01", "2100-12-31")]
WINDOWS += [(f"y{y}", f"{y}-01-01", f"{y}-12-31") for y in range(1992, 2003)]


def windows(t):
    return t.spark.createDataFrame(WINDOWS, "label string, lo string, hi string").select("label", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))


WINDOW_SQL = "(VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in WINDOWS) + ") w(label, lo, hi)"


def legs(t):
    """(leg, date, code, v, fwd): the deployed score and its two parts."""
    parts = (("composite", F.round("score", 9)), ("value", F.col("ey")), ("reversal", F.col("rev")))
    return blended(t).select("date", "code", "fwd", F.explode(F.array(*(F.struct(F.lit(k).alias("leg"), v.alias("v")) for k, v in parts))).alias("x")).select("x.leg", "date", "code", "x.v", "fwd")


def leg_ic(t):
    return X.rank_ic(legs(t), "v", "fwd", ("leg", "date")).select("leg", "date", F.col("ic").alias("x"))


LEGS = SCORES | Z | {
    "lg": "SELECT date, code, fwd, 'composite' AS leg, round(score, 9) AS v FROM zz UNION ALL SELECT date, code, fwd, 'value' AS leg, ey AS v FROM ms UNION ALL SELECT date, code, fwd, 'reversal' AS leg, -mom AS v FROM ms",
    "lk": "SELECT *, rank() OVER (PARTITION BY leg, date ORDER BY v) + (count(*) OVER (PARTITION BY leg, date, v) - 1)/2.0 AS a, rank() OVER (PARTITION BY leg, date ORDER BY fwd) + (count(*) OVER (PARTITION BY leg, date, fwd) - 1)/2.0 AS b, row_number() OVER (PARTITION BY leg, date ORDER BY v DESC, code) AS p, row_number() OVER (PARTITION BY leg, date ORDER BY v, code) - 1 AS r, count(*) OVER (PARTITION BY leg, date) AS n FROM lg WHERE v IS NOT NULL AND fwd IS NOT NULL",
    "lic": "SELECT leg, date, round(corr(a, b), 9) AS x FROM lk GROUP BY leg, date HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL",
    "lsel": "SELECT date, avg(CASE WHEN p <= 5 THEN fwd END) - avg(fwd) AS excess, avg(CASE WHEN greatest(0, ceil(r*5.0/greatest(n - 1, 1)) - 1) = 4 THEN fwd END) - avg(CASE WHEN greatest(0, ceil(r*5.0/greatest(n - 1, 1)) - 1) = 0 THEN fwd END) AS spread FROM lk WHERE leg = 'composite' GROUP BY date HAVING count(*) >= 5",
    "lx": "SELECT leg, date, x FROM lic UNION ALL SELECT 'excess' AS leg, date, excess AS x FROM lsel UNION ALL SELECT 'spread' AS leg, date, spread AS x FROM lsel",
}


@query("q15_decay", f"SELECT leg, label, count(*) AS n, avg(x) AS mean, CASE WHEN count(*) >= 2 AND stddev_samp(x) >= 1e-12 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) END AS t, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM lx JOIN {WINDOW_SQL} ON date BETWEEN lo AND hi WHERE x IS NOT NULL GROUP BY leg, label", "mean t hit", extra=LEGS)
def q15_decay(t):
    """Rank correlations of the score and its parts, the excess of its best names and its spread, in regimes, halves and years."""
    sel = X.selection_excess(legs(t).where("leg = 'composite'"), "v", "fwd", 5)
    both = sel.select(F.lit("excess").alias("leg"), "date", F.col("excess").alias("x")).unionByName(sel.select(F.lit("spread").alias("leg"), "date", F.col("spread").alias("x")))
    return A.in_windows(leg_ic(t).unionByName(both), "x", windows(t), ("leg",))


@query("q15_boundaries", "SELECT leg, date, n_early, n_late, late, late / sqrt(vl / n_late) AS t_late, (early - late) / sqrt(ve / n_early + vl / n_late) AS welch FROM (SELECT leg, date, count(*) OVER b AS n_early, avg(x) OVER b AS early, var_samp(x) OVER b AS ve, count(*) OVER a AS n_late, avg(x) OVER a AS late, var_samp(x) OVER a AS vl FROM lic WINDOW b AS (PARTITION BY leg ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY leg ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) z WHERE n_early >= 6 AND n_late >= 6", "late t_late welch", extra=LEGS)
def q15_boundaries(t):
    """How the verdict on the recent part moves with where it begins: Welch's t at each month."""
    return A.boundaries(leg_ic(t), "x", ("leg",))


BEST = "SELECT 'a' AS variant, date, code FROM (SELECT date, code, row_number() OVER (PARTITION BY date ORDER BY v DESC, code) AS p FROM (SELECT date, code, round(score, 9) AS v FROM zz WHERE score IS NOT NULL) y) x WHERE p <= 5"
MONTHLY = "SELECT 'a' AS variant, date FROM month_ends"


def deployed_book(t):
    """Daily gross and net of the five best by the deployed score."""
    m = blended(t).withColumn("p", X.place(F.round("score", 9))).where("p <= 5").select(F.lit("a").alias("variant"), "date", "code")
    return B.ew_portfolio(m, t.month_ends.select(F.lit("a").alias("variant"), "date"), rets(t), t.calendar, RATES)[0].join(F.broadcast(t.calendar), "pos")


@query("q15_slices", f"SELECT kind, label, sum(l) AS log_growth, min(exp(lw - greatest(hi, 0)) - 1) AS max_drawdown, avg(exp(l) - 1)/stddev_samp(exp(l) - 1)*sqrt(252.0) AS sharpe FROM (SELECT *, max(lw) OVER (PARTITION BY kind ORDER BY pos) AS hi FROM slw) z JOIN {WINDOW_SQL} ON date BETWEEN lo AND hi0 GROUP BY kind, label".replace("w(label, lo, hi)", "w(label, lo, hi0)"), "log_growth max_drawdown sharpe", extra=SCORES | Z | book_sql(BEST, MONTHLY) | {
    "slb": "SELECT 'net' AS kind, pos, date, l FROM vy UNION ALL SELECT 'gross' AS kind, y.pos, y.date, ln(1 + coalesce(g.gross, 0)) AS l FROM vy y LEFT JOIN vr g ON g.pos = y.pos",
    "slw": "SELECT *, sum(l) OVER (PARTITION BY kind ORDER BY pos) AS lw FROM slb",
})
def q15_slices(t):
    """The book in each window, net and gross of costs, drawdowns against the high-water mark that it brings along."""
    d = deployed_book(t)
    both = d.select(F.lit("net").alias("kind"), "pos", "date", F.col("net").alias("r")).unionByName(d.select(F.lit("gross").alias("kind"), "pos", "date", F.col("gross").alias("r")))
    w = Window.partitionBy("kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = both.withColumn("l", F.log1p("r")).withColumn("lw", F.sum("l").over(w)).withColumn("dd", F.exp(F.col("lw") - F.greatest(F.max("lw").over(w), F.lit(0.0))) - 1)
    s = d.join(F.broadcast(windows(t)), F.col("date").between(F.col("lo"), F.col("hi")))
    return s.groupBy("kind", "label").agg(F.sum("l").alias("log_growth"), F.min("dd").alias("max_drawdown"), A.sharpe_of("r").alias("sharpe"))


# Sweeps

#: Weight of value and of reversal, band of the book, and the costs of an account's size.
SWEEP = [(f"{v}:{r} b{b} {tier}", float(v), float(r), b, *cost) for v, r, b in ((1, 0, 0), (1, 1, 0), (3, 1, 0), (5, 1, 0), (9, 1, 0), (5, 1, 1), (5, 1, 3), (5, 1, 6)) for tier, cost in (("large", RATES), ("small", (0.004, 0.005))) if b == 0 or tier == "large"]
SWEEP_SQL = "(VALUES " + ", ".join(f"('{n}', {v}, {r}, {b}, {x}, {y})" for n, v, r, b, x, y in SWEEP) + ") v(variant, wv, wr, band, buy, sell)"
TURNED = "SELECT variant, avg(turn) AS turnover FROM (SELECT k.variant, k.exec_pos, coalesce(sum(abs(dw)), 0)/2 AS turn FROM vk k LEFT JOIN vd d ON d.variant = k.variant AND d.block = k.block GROUP BY k.variant, k.exec_pos) x GROUP BY variant"


def sweep_sql() -> dict[str, str]:
    rates = ", ".join(f"('{n}', {x}, {y})" for n, _, _, _, x, y in SWEEP)
    books = book_sql("SELECT variant, date, code FROM swf", f"SELECT variant, date FROM month_ends, {SWEEP_SQL}")
    books["vb"] = f"SELECT k.variant, k.exec_pos, coalesce(sum(CASE WHEN dw > 0 THEN dw*buy ELSE -dw*sell END), 0) AS cost FROM vk k JOIN (VALUES {rates}) c(variant, buy, sell) ON c.variant = k.variant LEFT JOIN vd d ON d.variant = k.variant AND d.block = k.block GROUP BY k.variant, k.exec_pos"
    return SCORES | Z | books | {
        "sws": f"SELECT variant, band, date, code, CASE WHEN ze IS NULL AND (wr = 0 OR zm IS NULL) THEN NULL ELSE round((coalesce(ze, 0)*wv - coalesce(zm, 0)*wr) / (CASE WHEN ze IS NULL THEN 0 ELSE wv END + CASE WHEN zm IS NULL THEN 0 ELSE wr END), 9) END AS sc FROM zz, {SWEEP_SQL}",
        "swp": "SELECT *, CASE WHEN sc IS NOT NULL THEN row_number() OVER (PARTITION BY variant, date, sc IS NULL ORDER BY sc DESC, code) END AS rk FROM sws",
        "swn": "SELECT variant, date, 5 AS n, row_number() OVER (PARTITION BY variant ORDER BY date) AS dn, coalesce(list(code ORDER BY rk) FILTER (WHERE rk <= 5 + band), []) AS near FROM swp GROUP BY variant, date",
        "swf": fold_sql("swn", "variant"),
        "swt": TURNED,
    }


@query("q2_sweep", f"SELECT {', '.join(f'p.{c}' if c == 'variant' else c for c in SUMMED.split(', '))}, turnover FROM vp p JOIN swt s ON s.variant = p.variant", f"{SUMMARY} turnover", extra=sweep_sql())
def q2_sweep(t):
    """Weights of value against reversal, a turnover buffer whose holdings feed back, and the costs of two account sizes: all books in one job."""
    v = t.spark.createDataFrame(SWEEP, "variant string, wv double, wr double, band int, buy double, sell double")
    have = lambda c, w: F.when(F.col(c).isNotNull(), F.col(w)).otherwise(0.0)
    total = F.coalesce(F.col("ze") * F.col("wv"), F.lit(0.0)) + F.coalesce(F.col("zr") * F.col("wr"), F.lit(0.0))
    weight = have("ze", "wv") + have("zr", "wr")
    d = blended(t).select("date", "code", "ze", "zr").crossJoin(F.broadcast(v)).withColumn("sc", F.round(F.when(weight > 0, total / weight), 9))
    m = X.hysteresis_book(d, "sc", 5, "band", ("variant", "band")).select("variant", "date", "code")
    daily, reb = B.ew_portfolio(m, t.month_ends.crossJoin(F.broadcast(v.select("variant"))), rets(t), t.calendar, v.select("variant", "buy", "sell"))
    return summary(daily.join(F.broadcast(t.calendar), "pos")).join(reb.groupBy("variant").agg(F.avg("turnover").alias("turnover")), "variant")


@query("q2_ic_correlation", "SELECT a.f AS x, b.f AS y, count(*) AS n, corr(a.ic, b.ic) AS c FROM fic a JOIN fic b ON a.date = b.date AND a.f < b.f GROUP BY a.f, b.f HAVING count(*) >= 2", "c", extra=FIVE | {
    "fic": "SELECT strategy AS f, date, corr(a, b) AS ic FROM (SELECT *, rank() OVER (PARTITION BY strategy, date ORDER BY v) + (count(*) OVER (PARTITION BY strategy, date, v) - 1)/2.0 AS a, rank() OVER (PARTITION BY strategy, date ORDER BY fwd) + (count(*) OVER (PARTITION BY strategy, date, fwd) - 1)/2.0 AS b FROM whole) z GROUP BY strategy, date HAVING count(*) >= 5 AND corr(a, b) IS NOT NULL",
})
def q2_ic(t):
    """Which factors move together: correlation of their monthly rank correlations."""
    d = ml.build_dataset(five_factors(t), list(FACTORS))
    tall = d.select("date", "code", "fwd", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.round(f, 9).alias("v")) for f in FACTORS))).alias("x")).select("x.f", "date", "code", "x.v", "fwd")
    return correlations(X.rank_ic(tall, "v", "fwd", ("f", "date")), "ic", "date", "f")


GRID = [(f"top{n} band{b} {c}", n, b, c) for n in (3, 5, 10) for b in (0, 2) for c in ("M", "Q")]
GRID_SQL = "(VALUES " + ", ".join(f"('{v}', {n}, {b}, '{c}')" for v, n, b, c in GRID) + ") v(variant, n, band, cadence)"


@query("b11_parameter_grid", f"SELECT {SUMMED} FROM vp", SUMMARY, extra=SCORES | book_sql("SELECT variant, date, code FROM gdf", f"SELECT variant, date FROM month_ends, {GRID_SQL} WHERE cadence = 'M' OR quarter(date) * 3 = month(date)") | {
    "gds": f"SELECT variant, n, band, date, code, CASE WHEN amount IS NOT NULL THEN row_number() OVER (PARTITION BY variant, date, amount IS NULL ORDER BY amount DESC, code) END AS rk FROM ms, {GRID_SQL} WHERE cadence = 'M' OR quarter(date) * 3 = month(date)",
    "gdn": "SELECT variant, n, date, row_number() OVER (PARTITION BY variant ORDER BY date) AS dn, coalesce(list(code ORDER BY rk) FILTER (WHERE rk <= n + band), []) AS near FROM gds GROUP BY variant, n, date",
    "gdf": fold_sql("gdn", "variant"),
})
def b11_grid(t):
    """Number of names, band and cadence of a book, every combination."""
    v = t.spark.createDataFrame(GRID, "variant string, n int, band int, cadence string")
    sig = t.month_ends.crossJoin(F.broadcast(v)).where((F.col("cadence") == "M") | (F.quarter("date") * 3 == F.month("date")))
    d = month_scores(t).select("date", "code", "amount").join(F.broadcast(sig), "date")
    m = X.hysteresis_book(d, "amount", "n", "band", ("variant", "n", "band")).select("variant", "date", "code")
    return summary(B.ew_portfolio(m, sig.select("variant", "date"), rets(t), t.calendar, RATES)[0].join(F.broadcast(t.calendar), "pos"))


# Hedges

HEDGES = [(f"h{h} c{c}", h, c) for h in (0.0, 0.25, 0.5, 0.75, 1.0) for c in (0.0, 0.02, 0.04) if h or not c]
HEDGE_SQL = "(VALUES " + ", ".join(f"('{v}', {h}, {c})" for v, h, c in HEDGES) + ") v(variant, h, c)"
HEDGED = SCORES | Z | IXR | book_sql(BEST, MONTHLY) | {
    "hb": "SELECT v.pos, v.date, v.net, i.r FROM vl v JOIN ixr i ON i.date = v.date WHERE i.r IS NOT NULL",
    "hr": f"SELECT variant, pos, net - h*r - h*c/252 AS x FROM hb, {HEDGE_SQL}",
    "hc": "SELECT *, sum(x) OVER (PARTITION BY variant ORDER BY pos) AS e FROM hr",
    "beta": "SELECT regr_slope(net, r) AS b, regr_r2(net, r) AS r2 FROM hb",
    "rs": "SELECT pos, net, net - b*r AS x FROM hb, beta",
    "rc": "SELECT pos, sum(net) OVER (ORDER BY pos) AS ne, sum(x) OVER (ORDER BY pos) AS e FROM rs",
}


def book_and_index(t):
    return deployed_book(t).select("pos", "date", "net").join(F.broadcast(ixr(t).where("r is not null").select("date", "r")), "date")


def summed_drawdown(x: str, by=()):
    """How far the running sum falls below its highest so far, 0 at the start: books of given prices may lose more than all, so sums stand for products."""
    w = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return w, lambda e: F.col(e) - F.greatest(F.max(e).over(w), F.lit(0.0))


@query("q13_hedge_grid", "SELECT variant, avg(x)*252 AS ann_mean, stddev_samp(x)*sqrt(252.0) AS ann_vol, avg(x)/stddev_samp(x)*sqrt(252.0) AS sharpe, min(e - greatest(hi, 0)) AS drawdown FROM (SELECT *, max(e) OVER (PARTITION BY variant ORDER BY pos) AS hi FROM hc) z GROUP BY variant", "ann_mean ann_vol sharpe drawdown", extra=HEDGED)
def q13_grid(t):
    """Hedge ratio by yearly cost of the short side, over the deployed book."""
    v = t.spark.createDataFrame(HEDGES, "variant string, h double, c double")
    d = book_and_index(t).crossJoin(F.broadcast(v)).withColumn("x", F.col("net") - F.col("h") * F.col("r") - F.col("h") * F.col("c") / 252)
    w, fall = summed_drawdown("x", ("variant",))
    d = d.withColumn("e", F.sum("x").over(w)).withColumn("dd", fall("e"))
    return d.groupBy("variant").agg((F.avg("x") * 252).alias("ann_mean"), (F.stddev_samp("x") * F.sqrt(F.lit(252.0))).alias("ann_vol"), A.sharpe_of("x").alias("sharpe"), F.min("dd").alias("drawdown"))


@query("q13_residual", "SELECT b AS beta, r2, drawdown, residual FROM beta, (SELECT min(ne - greatest(hn, 0)) AS drawdown, min(e - greatest(he, 0)) AS residual FROM (SELECT *, max(ne) OVER (ORDER BY pos) AS hn, max(e) OVER (ORDER BY pos) AS he FROM rc) y) z", "beta r2 drawdown residual", extra=HEDGED)
def q13_residual(t):
    """What is left when the index part is taken out whole, and whether its drawdown is smaller."""
    d = book_and_index(t)
    d = d.crossJoin(F.broadcast(A.beta_r2(d, "net", "r"))).withColumn("x", F.col("net") - F.col("beta") * F.col("r"))
    w, fall = summed_drawdown("x", (F.lit(1),))
    d = d.withColumns({"ne": F.sum("net").over(w), "e": F.sum("x").over(w)}).withColumns({"dn": fall("ne"), "de": fall("e")})
    return d.groupBy("beta", "r2").agg(F.min("dn").alias("drawdown"), F.min("de").alias("residual"))


TIERS = (500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000)


@query("q13_contracts", f"SELECT tier, tier / (close * 300) AS contracts, round(tier / (close * 300)) / (tier / (close * 300)) AS effective FROM (SELECT avg(close) AS close FROM index_series) i, (VALUES {', '.join(f'({x})' for x in TIERS)}) v(tier)", "contracts effective")
def q13_contracts(t):
    """Whole contracts of 300 times the index that a full hedge takes, and the share of it that they reach."""
    d = t.spark.createDataFrame([(x,) for x in TIERS], "tier int").crossJoin(F.broadcast(t.index_series.agg(F.avg("close").alias("close"))))
    n = F.col("tier") / (F.col("close") * 300)
    return d.select("tier", n.alias("contracts"), (F.round(n) / n).alias("effective"))


# Quality and value

CUTS = ("all", "member", "other", "mapped", "unmapped", "b00", "b30", "b60", "b68")
#: What is held against what.
LINES = [("qv-uni", "qv all", "uni all"), ("q-uni", "q all", "uni all"), ("qv-q", "qv all", "q all"), ("member", "qv member", "uni member"), ("other", "qv other", "uni other"), ("mapped", "qv mapped", "uni all"), ("unmapped", "qv unmapped", "uni all"), ("sleeves", "qv sleeves", "uni all"), ("sleeves-qv", "qv sleeves", "qv all")]
ERAS = [("all", "1990-01-01", "2100-12-31"), ("early", "1990-01-01", "1999-06-30"), ("late", "1999-07-01", "2100-12-31")]
ERA_SQL = "(VALUES " + ", ".join(f"('{a}', DATE '{b}', DATE '{c}')" for a, b, c in ERAS) + ") e(era, lo, hi)"
LINE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LINES) + ") n(line, x, y)"
QV = OWN | {
    "qm": "SELECT o.code, o.date, coalesce(r.ok, false) AS q, n >= 120 AND coalesce(pe > 0 AND pe <= q30, false) AS v FROM oq o ASOF LEFT JOIN rq3 r ON r.code = o.code AND r.pub_date <= o.date",
    "qc": "SELECT m.code, m.date, q, v, b.code IS NOT NULL AS inm, bucket FROM qm m JOIN month_ends USING (date) LEFT JOIN members b ON b.date = m.date AND b.code = m.code JOIN industry i ON i.code = m.code",
    "qmask": "SELECT 'uni' AS mask, * FROM qc UNION ALL SELECT 'q' AS mask, * FROM qc WHERE q UNION ALL SELECT 'qv' AS mask, * FROM qc WHERE q AND v",
    "qcut": "SELECT mask || ' all' AS variant, date, code FROM qmask UNION ALL SELECT mask || CASE WHEN inm THEN ' member' ELSE ' other' END AS variant, date, code FROM qmask UNION ALL SELECT mask || CASE WHEN bucket IS NULL THEN ' unmapped' ELSE ' mapped' END AS variant, date, code FROM qmask UNION ALL SELECT mask || ' b' || bucket AS variant, date, code FROM qmask WHERE bucket IS NOT NULL",
} | book_sql("SELECT variant, date, code FROM qcut", "SELECT variant, date FROM month_ends, (SELECT DISTINCT variant FROM qcut) v") | {
    "qd": "SELECT variant, pos, date, net FROM vl UNION ALL SELECT 'qv sleeves' AS variant, pos, date, sum(net)/4 AS net FROM vl WHERE variant IN ('qv b00', 'qv b30', 'qv b60', 'qv b68') GROUP BY pos, date",
    "ql": f"SELECT line, era, x.date, x.net - y.net AS d FROM {LINE_SQL} JOIN qd x ON x.variant = n.x JOIN qd y ON y.variant = n.y AND y.pos = x.pos JOIN {ERA_SQL} ON x.date BETWEEN lo AND hi",
    "qp": "SELECT line, era, date_trunc('month', date) AS p, avg(d) AS m FROM ql GROUP BY 1, 2, 3",
}


@query("q20_masks", "SELECT a.line, a.era, a.n, a.ann_active, b.t_month FROM (SELECT line, era, count(*) AS n, avg(d)*252 AS ann_active FROM ql GROUP BY line, era) a JOIN (SELECT line, era, CASE WHEN count(*) >= 2 AND stddev_samp(m) >= 1e-12 THEN avg(m)/(stddev_samp(m)/sqrt(count(*))) END AS t_month FROM qp GROUP BY line, era) b ON b.line = a.line AND b.era = a.era", "ann_active t_month", extra=QV)
def q20_masks(t):
    """Names of quality and value against quality alone and all: whole, by era, members and others, with and without a bucket, and a sleeve for each bucket."""
    d = own_history(t, 1200)
    f = Window.partitionBy("code").orderBy("pub_date").rowsBetween(-2, 0)
    ok = t.annual_reports.select("code", "pub_date", "stat_date", ((F.count("roe").over(f) >= 3) & (F.min("roe").over(f) > 0.11)).alias("ok"))
    d = J.report_asof(d, ok, "ok").join(F.broadcast(t.month_ends), "date")
    q, v = F.coalesce("ok", F.lit(False)), (F.col("n") >= 120) & F.coalesce((F.col("pe") > 0) & (F.col("pe") <= F.col("q30")), F.lit(False))
    members = membership_asof(t.month_ends, t.membership).select("date", "code", F.lit(True).alias("inm"))
    d = d.join(members, ["date", "code"], "left").join(F.broadcast(t.industry), "code")
    mask = F.explode(F.filter(F.array(F.lit("uni"), F.when(q, "q"), F.when(q & v, "qv")), lambda x: x.isNotNull())).alias("mask")
    cut = F.array(F.lit("all"), F.when(F.col("inm"), "member").otherwise("other"), F.when(F.col("bucket").isNull(), "unmapped").otherwise("mapped"), F.concat(F.lit("b"), "bucket"))
    d = d.select("date", "code", "inm", "bucket", mask).select("date", "code", "mask", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("cut"))
    d = d.select(F.concat_ws(" ", "mask", "cut").alias("variant"), "date", "code")
    signals = t.month_ends.crossJoin(F.broadcast(d.select("variant").distinct()))
    daily = B.ew_portfolio(d, signals, rets(t), t.calendar, RATES)[0].select("variant", "pos", "net")
    mixed = B.sleeve_mix(daily, t.spark.createDataFrame([(f"qv {c}", 0.25) for c in CUTS if c.startswith("b")], "variant string, w double"), "variant").select(F.lit("qv sleeves").alias("variant"), "pos", F.col("ret").alias("net"))
    daily = daily.unionByName(mixed)
    lines = t.spark.createDataFrame(LINES, "line string, x string, y string")
    eras = t.spark.createDataFrame(ERAS, "era string, lo string, hi string").select("era", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"))
    x = daily.join(F.broadcast(lines), F.col("variant") == F.col("x")).select("line", "y", "pos", F.col("net").alias("nx"))
    d = x.join(daily.select(F.col("variant").alias("y"), "pos", F.col("net").alias("ny")), ["y", "pos"]).join(F.broadcast(t.calendar), "pos")
    d = d.join(F.broadcast(eras), F.col("date").between(F.col("lo"), F.col("hi"))).select("line", "era", "date", (F.col("nx") - F.col("ny")).alias("d"))
    by = ("line", "era")
    return d.groupBy(*by).agg(F.count("*").alias("n"), (F.avg("d") * 252).alias("ann_active")).join(A.clustered_t(d, "d", by=by).select(*by, F.col("t").alias("t_month")), list(by))
