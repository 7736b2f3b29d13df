"""Scans and table work on landed rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import ingest as I
from panelspark.queries import query
from panelspark.sources import files


@query("s1_scan_bars", "SELECT code, date, close FROM bars WHERE code IN ('sh.600004', 'sz.300006') AND date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'", "close")
def s1(t):
    return t.bars.where(F.col("code").isin("sh.600004", "sz.300006") & F.col("date").between("1994-01-01", "1996-12-31")).select("code", "date", "close")


@query("s5_s6_normalize", "SELECT code, date AS ex_date, coalesce(CASE WHEN volume % 5 = 0 THEN NULL ELSE floor(close) END, 0.0) AS dps, code LIKE 'sh%' AS is_st FROM bars WHERE volume % 7 <> 0", "dps")
def s5(t):
    raw = t.bars.select("code", F.when(F.col("volume") % 7 == 0, "bad").otherwise(F.col("date").cast("string")).alias("ex_date"), F.when(F.col("volume") % 5 == 0, "--").otherwise(F.floor("close").cast("string")).alias("dps"), F.when(F.col("code").startswith("sh"), "1").otherwise("").alias("is_st"))
    return I.typed(I.normalize_dividends(raw), flags=("is_st",))


@query("s7_s8_reports", "SELECT code, stat_date, capex FROM annual_reports WHERE month(stat_date) = 12 AND day(stat_date) = 31", "capex")
def s7(t):
    return I.normalize_capex(t.annual_reports).select("code", "stat_date", "capex")


@query("s9_normalize_bonds", "SELECT code, min(list_date) AS listing_date FROM listings WHERE code NOT LIKE '40%' GROUP BY code")
def s9(t):
    return I.normalize_bonds(t.listings.withColumnRenamed("list_date", "listing_date")).select("code", "listing_date")


@query("s12_upsert_keep_last", "SELECT code, date, CASE WHEN pos % 3 = 0 THEN close*2 ELSE close END AS close FROM dense WHERE close IS NOT NULL", "close")
def s12(t):
    b = t.bars.join(F.broadcast(t.calendar), "date")
    old, new = b.select("code", "date", "close", F.lit(0).alias("batch")), b.where("pos % 3 = 0").select("code", "date", (F.col("close") * 2).alias("close"), F.lit(1).alias("batch"))
    return I.upsert_keep_last(old.unionByName(new), ["code", "date"]).drop("batch")


@query("s14_s15_incremental_merge", "SELECT code, CASE WHEN code LIKE '%5' THEN 'new' WHEN code LIKE 'sz%' THEN 'rebase' ELSE 'append' END AS mode FROM codes")
def s14(t):
    cut = t.bars.groupBy("code").agg(F.percentile("close", F.lit(0.5)).alias("m"), F.max("date").alias("hi"))
    b = t.bars.join(cut, "code")
    old = b.where("date < hi and not endswith(code, '5')").select("code", "date", "close")
    new = b.select("code", "date", F.when(F.col("code").startswith("sz"), F.col("close") * 1.01).otherwise(F.col("close")).alias("close"))
    return I.incremental_bars_merge(old, new)[1].select("code", "mode")


@query("s16_extend_membership", "SELECT snap_date, count(*) AS n FROM membership WHERE snap_date < DATE '1998-06-01' GROUP BY 1")
def s16(t):
    import datetime as dt

    stored = t.membership.where("snap_date < '1996-01-01'")
    return I.extend_membership(stored, t.membership, dt.date(1998, 6, 15)).groupBy("snap_date").agg(F.count("*").alias("n"))


@query("s17_s18_calendar_union", "SELECT code, count(*) AS n FROM membership GROUP BY code")
def s17(t):
    return t.membership.groupBy("code").agg(F.count("*").alias("n"))


@query("s19_accumulate", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s19(t):
    e = t.events.select("event_id", "event_type", "value")
    return I.accumulate(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0 or event_id % 3 = 0"), ["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s20_coalesce_panel", "SELECT date, CASE WHEN day(date) % 2 = 0 THEN close*2 ELSE close END AS close FROM index_series", "close")
def s20(t):
    i = t.index_series.select("date", "close")
    return I.coalesce_panel(i.where(F.day("date") % 2 == 0).withColumn("close", F.col("close") * 2), i, ["date"], "close")


@query("s21_month_last", "SELECT code, last_day(date) AS month, max_by(close, date) AS close FROM bars GROUP BY 1, 2", "close")
def s21(t):
    return I.resample_month_last(t.bars, ["code"], "close")


@query("s26_p6_industry", "SELECT code, CASE WHEN bucket IS NULL THEN NULL ELSE 'C' || substr(bucket, 1, 2) END AS csrc FROM industry")
def s26(t):
    return I.normalize_industry(t.industry.withColumn("industry", F.concat(F.lit("C"), F.substr("bucket", F.lit(1), F.lit(2)), F.lit(" machinery")))).select("code", "csrc")


INDUSTRIES = ("J66 banks", "D44 power", "G54 roads", "C36 cars", "C15 drinks", "C39 chips", "I65 software", "E48 works", "C30 glass", "A01 farms", "", "66J")


@query("p6_bucket_map", "SELECT code, CASE WHEN k IN (0) THEN 'finance' WHEN k IN (1, 2) THEN 'livelihood' WHEN k IN (3, 4) THEN 'consumption' WHEN k IN (5, 6) THEN 'tech' WHEN k IN (7, 8) THEN 'infrastructure' END AS bucket FROM (SELECT code, CAST(substr(code, 8, 2) AS INT) % 12 AS k FROM codes) x")
def p6(t):
    """The five buckets of industry strings; codes stand for twelve of them, of which three have no bucket."""
    k = F.substr("code", F.lit(8), F.lit(2)).cast("int") % len(INDUSTRIES)
    d = t.codes.withColumn("industry", F.element_at(F.array(*map(F.lit, INDUSTRIES)), k + 1))
    return I.normalize_industry(d).select("code", "bucket")


@query("s3_scan_reports", "SELECT 'annual' AS kind, code, count(*) AS n, min(pub_date) AS first, avg(roe) AS value FROM annual_reports GROUP BY code UNION ALL SELECT 'holders', code, count(*), min(pub_date), avg(holders) FROM holders GROUP BY code", "value")
def s3(t):
    """Report tables that landed as text, read with their types; a report without a publication date is not there yet."""
    path = files.fresh_path(t.spark, "reports")
    text = lambda df, kind, value: df.select(F.lit(kind).alias("kind"), "code", *(F.col(c).cast("string").alias(c) for c in ("stat_date", "pub_date")), F.col(value).cast("string").alias("value"))
    a, h = text(t.annual_reports, "annual", "roe"), text(t.holders, "holders", "holders")
    open_ones = h.withColumn("pub_date", F.lit(""))
    files.sink_parquet(a.unionByName(h).unionByName(open_ones), path, ("kind",))
    both = [files.scan_reports(t.spark, f"{path}/kind={k}").withColumn("kind", F.lit(k)) for k in ("annual", "holders")]
    return both[0].unionByName(both[1]).groupBy("kind", "code").agg(F.count("*").alias("n"), F.min("pub_date").alias("first"), F.avg("value").alias("value"))
