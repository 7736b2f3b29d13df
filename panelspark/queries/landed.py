"""Landed tables typed and merged, sinks read back, streams over files, and small joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.operators import ingest as I
from panelspark.queries import query
from panelspark.queries.factors import rets
from panelspark.queries.live import arriving
from panelspark.sources import files
from panelspark.sources.versions import VersionedTable
from panelspark.streaming import streams


@query("s10_normalize_margin", "SELECT date, close AS rzye FROM index_series WHERE day(date) % 3 <> 0", "rzye")
def s10(t):
    """Balances landed as text: some can't be read, some dates come twice."""
    i = t.index_series
    bad = F.when(F.day("date") % 3 == 0, "--").otherwise(F.col("close").cast("string"))
    raw = i.select(F.col("date").cast("string").alias("date"), bad.alias("rzye"))
    again = i.where("day(date) % 2 = 0").select(F.col("date").cast("string").alias("date"), F.when(F.day("date") % 3 == 0, "--").otherwise((F.col("close") * 2).cast("string")).alias("rzye"))
    return I.normalize_margin(raw.unionAll(again))


@query("s11_normalize_ipo", "SELECT s.code, s.date, s.close AS close_raw, CASE WHEN day(s.date) % 2 = 0 THEN s.close*2 END AS close_hfq, l.issue_price*1000*1e4 AS proceeds FROM supplier_days s JOIN listings l ON l.code = s.code WHERE s.code LIKE '1%'", "close_raw close_hfq proceeds")
def s11(t):
    meta = t.listings.select("code", F.col("list_date").cast("string").alias("list_date"), F.col("issue_price").cast("string").alias("issue_price"), F.lit("1000").alias("shares"))
    raw = t.supplier_days.select("code", "date", F.col("close").alias("close_raw"))
    adjusted = t.supplier_days.where("day(date) % 2 = 0").select("code", "date", (F.col("close") * 2).alias("close_hfq"))
    m, bars = I.normalize_ipo(meta, raw, adjusted, "1")
    return bars.join(m.select("code", "proceeds"), "code")


@query("s13_merge_wide", "SELECT code, date, CASE WHEN code LIKE 'sh%' THEN close ELSE close*2 END AS close FROM bars", "close")
def s13(t):
    return I.merge_wide_columns(t.bars.where("code like 'sh%'"), t.bars.withColumn("close", F.col("close") * 2))


@query("s27_annual_report", "SELECT code, stat_date, pub_date, CASE WHEN code LIKE '%5' THEN NULL ELSE roe END AS roe FROM annual_reports", "roe")
def s27(t):
    r = t.annual_reports
    landed = r.select("code", F.col("stat_date").cast("string").alias("stat_date"), F.col("pub_date").cast("string").alias("pub_date"), F.when(F.col("code").endswith("5"), "").otherwise(F.col("roe").cast("string")).alias("roe"))
    late = r.select("code", F.concat(F.year("stat_date").cast("string"), F.lit("-09-30")).alias("stat_date"), F.col("pub_date").cast("string").alias("pub_date"), F.lit("1").alias("roe"))
    return I.normalize_annual_report(landed.unionAll(late).unionAll(landed.withColumn("pub_date", F.lit("unknown"))))


@query("s22_sink_parquet", "SELECT code, count(*) AS n, max(close) AS high, max(close)*2 AS before FROM bars WHERE code LIKE 'sz%' GROUP BY code", "high before")
def s22(t):
    """A table replaced as a whole while it is read: who opened the version before still sees all of it."""
    table = VersionedTable(t.spark, files.fresh_path(t.spark, "replaced"), "code string, date date, close double")
    b = t.bars.select("code", "date", "close")
    table.publish(b.withColumn("close", F.col("close") * 2))
    before = table.read()
    table.publish(b)
    old = before.where("code like 'sz%'").groupBy("code").agg(F.max("close").alias("before"))
    return table.read().where("code like 'sz%'").groupBy("code").agg(F.count("*").alias("n"), F.max("close").alias("high")).join(old, "code")


@query("s2_scan_keyed_dir", "SELECT code, count(*) AS n, sum(capex) AS capex FROM annual_reports GROUP BY code", "capex")
def s2(t):
    """A folder of tables whose names tell their keys."""
    path = files.fresh_path(t.spark, "keyed")
    files.sink_parquet(t.annual_reports.select(F.concat("code", F.lit(".parquet")).alias("file"), "stat_date", "capex"), path, ("file",))
    return files.scan_keyed_dir(t.spark, path, folder="file").groupBy("code").agg(F.count("*").alias("n"), F.sum("capex").alias("capex"))


@query("s4_s23_csv_events", "SELECT code, ex_date, dps FROM dividends WHERE code LIKE 'sh%'", "dps")
def s4(t):
    """Events written as CSV and read back with a schema and a filter."""
    path = files.fresh_path(t.spark, "events")
    files.sink_csv(t.dividends, path)
    return files.scan_csv(t.spark, path, "code string, ex_date date, dps double", "code like 'sh%'")


@query("s24_json_report", "SELECT account, count(DISTINCT code) AS names, count(*) AS fills FROM fills GROUP BY account")
def s24(t):
    """A JSON record for each account, read back."""
    path = files.fresh_path(t.spark, "report")
    f = t.fills
    held = f.groupBy("account", "code").agg(F.sum("shares").alias("shares"))
    files.sink_json_report(f.groupBy("account").agg(F.sum("fee").alias("fees")), held, f, path)
    back = t.spark.read.schema("account bigint, positions map<string,bigint>, fills array<struct<code:string>>").json(path)
    return back.select("account", F.size("positions").cast("long").alias("names"), F.size("fills").cast("long").alias("fills"))


@query("j13_common_codes", "SELECT code, count(*) AS n FROM bars WHERE code LIKE 'sh%' AND code LIKE '%4' GROUP BY code")
def j13(t):
    """Rows of the codes that both sources have."""
    a, b = t.bars.where("code like 'sh%'"), t.bars.where("code like '%4'")
    return a.join(b.select("code").distinct(), "code", "left_semi").groupBy("code").agg(F.count("*").alias("n"))


@query("j15_align_series", "SELECT date, r.ret, i.r AS index_ret FROM rets r JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS r FROM index_series) i USING (date) WHERE r.code = (SELECT min(code) FROM codes) AND r.ret IS NOT NULL AND i.r IS NOT NULL", "ret index_ret")
def j15(t):
    """Two series on the dates where both have a value."""
    i = t.index_series.select("date", (F.col("close") / F.lag("close").over(Window.partitionBy("series_id").orderBy("date")) - 1).alias("index_ret"))
    one = t.codes.agg(F.min("code").alias("code"))
    return rets(t).join(F.broadcast(one), "code").select("date", "ret").join(i, "date").na.drop(subset=["ret", "index_ret"])


@query("u6_biased_universe", "SELECT date, avg(CASE WHEN inb THEN ret END) AS biased, avg(CASE WHEN inm THEN ret END) AS pit FROM rets r LEFT JOIN (SELECT date, code, TRUE AS inm FROM members) m USING (date, code) LEFT JOIN (SELECT code, TRUE AS inb FROM membership WHERE snap_date = (SELECT max(snap_date) FROM membership)) b USING (code) GROUP BY date HAVING avg(CASE WHEN inb THEN ret END) IS NOT NULL", "biased pit")
def u6(t):
    """Mean return of the latest members over all history, against those of each date."""
    from panelspark.operators.asof import membership_asof

    last = t.membership.agg(F.max("snap_date").alias("snap_date"))
    latest = t.membership.join(F.broadcast(last), "snap_date").select("code", F.lit(True).alias("b"))
    then = membership_asof(t.calendar.select("date"), t.membership).select("date", "code", F.lit(True).alias("m"))
    d = rets(t).join(latest, "code", "left").join(then, ["date", "code"], "left")
    return d.groupBy("date").agg(F.avg(F.when(F.col("b"), F.col("ret"))).alias("biased"), F.avg(F.when(F.col("m"), F.col("ret"))).alias("pit")).where("biased is not null")


#: What a second arrival does to a code: nothing new, all at another price, a new code, or later days.
MERGED = {
    "half": "SELECT CAST(floor(max(pos) / 2.0) AS BIGINT) AS mid FROM calendar",
    "kinds": "SELECT b.code, b.date, b.close, c.pos, mid, substr(b.code, 9, 1) AS k FROM bars b JOIN calendar c ON c.date = b.date JOIN half ON TRUE",
}


@query("t1_stream_bars_merge", "SELECT code, count(*) AS n, max(CASE WHEN k = '1' THEN close*2 ELSE close END) AS high FROM kinds WHERE k <> '0' OR pos <= mid GROUP BY code", "high", extra=MERGED)
def t1(t):
    """Bars in two arrivals, merged into a versioned table. Codes that end in 0 bring nothing later (skip), in 1 their history at another price (rebase), in 3 are new; the others overlap by a day (append)."""
    spark = t.spark
    mid = t.calendar.agg(F.floor(F.max("pos") / 2).alias("mid"))
    b = t.bars.select("code", "date", "close").join(F.broadcast(t.calendar), "date").crossJoin(F.broadcast(mid)).withColumn("k", F.substr("code", F.lit(9), F.lit(1)))
    first = b.where("pos <= mid and k <> '3'")
    seen = first.groupBy("code").agg(F.max("pos").alias("seen"))
    late = b.join(seen, "code", "left")
    price = F.when(F.col("k") == "1", F.col("close") * 2).when(F.col("k") == "0", F.col("close") * 3).otherwise(F.col("close"))
    second = late.where("CASE k WHEN '0' THEN pos < seen WHEN '1' THEN true WHEN '3' THEN true ELSE pos >= coalesce(seen, 0) END").withColumn("close", price)
    table = VersionedTable(spark, files.fresh_path(spark, "versions"), "code string, date date, close double")
    start = lambda stream, base: streams.bars_merge(stream, table, f"{base}/state")
    arriving(t, "bars", [x.select("code", "date", "close") for x in (first, second)], start)
    return table.read().groupBy("code").agg(F.count("*").alias("n"), F.max("close").alias("high"))


#: Every third day comes thin, with one exchange only; the rest of every second one of those comes later.
GATED = {
    "shares": "SELECT date, count(*) AS due, sum(CASE WHEN code LIKE 'sh%' THEN 1 ELSE 0 END) AS sh FROM bars GROUP BY date",
    "passed": "SELECT b.code, CASE WHEN pos % 3 <> 0 THEN 0 WHEN b.code LIKE 'sh%' AND sh >= 0.9 * due THEN 0 WHEN pos % 6 = 0 THEN 1 END AS batch FROM bars b JOIN calendar c ON c.date = b.date JOIN shares s ON s.date = b.date",
}


@query("t5_publication_gate", "SELECT code, batch, count(*) AS n FROM passed WHERE batch IS NOT NULL GROUP BY code, batch", extra=GATED)
def t5(t):
    """Thin days wait until nine tenths of the codes due have posted; a later batch completes some of them, others wait on. batch: when rows went on."""
    b = t.bars.select("code", "date", "close").join(F.broadcast(t.calendar), "date")
    batches = [b.where("pos % 3 <> 0 or code like 'sh%'"), b.where("pos % 6 = 0 and code not like 'sh%'")]
    due = t.bars.select("date", "code")
    start = lambda stream, base: streams.publication_gate(stream, due, f"{base}/gate", f"{base}/state")
    base = arriving(t, "gate", [x.select("code", "date", "close") for x in batches], start)
    out = t.spark.read.schema("code string, date date, close double, v int").parquet(f"{base}/gate/released")
    return out.groupBy("code", F.col("v").alias("batch")).agg(F.count("*").alias("n"))
