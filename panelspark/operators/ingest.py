"""Table work on landed rows: typing, keyed upserts, incremental merges, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalars import bucket_of, csrc_class, rebased


def typed(df: DataFrame, doubles: tuple[str, ...] = (), dates: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Text to types; what can't be read is NULL, a flag is true for '1' alone."""
    d = df.withColumns({c: F.col(c).try_cast("double") for c in doubles} | {c: F.col(c).try_cast("date") for c in dates})
    return d.withColumns({c: F.coalesce(F.col(c), F.lit("0")) == "1" for c in flags}) if flags else d


def normalize_dividends(df: DataFrame) -> DataFrame:
    return typed(df, ("dps",), ("ex_date",)).where("ex_date is not null").withColumn("dps", F.coalesce("dps", F.lit(0.0)))


def normalize_holders(df: DataFrame) -> DataFrame:
    d = typed(df, ("holders", "change"), ("stat_date", "pub_date")).withColumn("prior_holders", F.col("holders") - F.col("change"))
    return d.na.drop(subset=["stat_date", "pub_date", "holders"]).drop("change")


def normalize_capex(df: DataFrame) -> DataFrame:
    return df.where((F.month("stat_date") == 12) & (F.day("stat_date") == 31))


def normalize_bonds(df: DataFrame) -> DataFrame:
    """Listed bonds, one row a code, without those of the old market."""
    return df.where("listing_date is not null and not startswith(code, '40')").dropDuplicates(["code"])


def normalize_industry(df: DataFrame, buckets: DataFrame | None = None) -> DataFrame:
    """Adds the class code and its bucket: of the five built-in ones, or of `buckets` (csrc, bucket), a row for each class; an unlisted class has none."""
    d = df.withColumn("csrc", csrc_class("industry"))
    return d.join(F.broadcast(buckets), "csrc", "left") if buckets is not None else d.withColumn("bucket", bucket_of("industry"))


def normalize_margin(df: DataFrame, value: str = "rzye") -> DataFrame:
    """Dated balances, typed; rows without either are dropped, and a date keeps its first in order of value."""
    d = typed(df, (value,), ("date",)).na.drop(subset=["date", value])
    return d.groupBy("date").agg(F.min(value).alias(value))


def normalize_ipo(meta: DataFrame, raw: DataFrame, adjusted: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """(listings, bars): listings of a board with their proceeds (price times shares in units of 10,000), and their raw bars with the back-adjusted ones of the same date, if any."""
    m = typed(meta, ("issue_price", "shares"), ("list_date",)).where(F.col("code").startswith(prefix)).withColumn("proceeds", F.col("issue_price") * F.col("shares") * 1e4)
    return m, raw.join(m.select("code"), "code", "left_semi").join(adjusted, ["code", "date"], "left")


def merge_wide_columns(have: DataFrame, more: DataFrame, value: str = "close") -> DataFrame:
    """Panels as long rows: the codes that `have` lacks come from `more`, whatever their dates; those it has stay as they are."""
    new = more.join(have.select("code").distinct(), "code", "left_anti")
    return have.select("code", "date", value).unionByName(new.select("code", "date", value))


def normalize_annual_report(df: DataFrame, value: str = "roe") -> DataFrame:
    """Full-year reports, typed: rows without a publication date are dropped, a value that can't be read is NULL."""
    d = typed(df, (value,), ("pub_date", "stat_date")).where("pub_date is not null")
    return d.where((F.month("stat_date") == 12) & (F.day("stat_date") == 31))


def upsert_keep_last(batches: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The row of the latest batch for each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(batch), *[c for c in batches.columns if c not in (*keys, batch)])
    return batches.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def incremental_bars_merge(old: DataFrame, new: DataFrame, rtol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(bars, modes) of a batch against the stored history, per code.

    new: insert all; its last date is no later: skip; the overlapping close moved (or is missing): replace the code's whole
    history; else append the later dates. modes: (code, mode, rows).
    """
    have = old.groupBy("code").agg(F.max("date").alias("last"), F.max_by("close", "date").alias("last_close"))
    n = new.join(have, "code", "left")
    per = n.groupBy("code").agg(F.first("last").alias("last"), F.max("date").alias("latest"), rebased(F.first("last_close"), F.max(F.when(F.col("date") == F.col("last"), F.col("close")))).alias("moved"))
    mode = F.when(F.col("last").isNull(), "new").when(F.col("last") >= F.col("latest"), "skip").when(F.col("moved"), "rebase").otherwise("append")
    modes = per.withColumn("mode", mode).select("code", "mode", "last")
    take = new.join(modes, "code").where("mode in ('new', 'rebase') or (mode = 'append' and date > last)").select(*new.columns)
    keep = old.join(modes.where("mode = 'rebase'").select("code"), "code", "left_anti").select(*new.columns)
    counts = take.groupBy("code").agg(F.count("*").alias("rows"))
    return keep.unionByName(take), modes.join(counts, "code", "left").select("code", "mode", F.coalesce("rows", F.lit(0)).alias("rows"))


def extend_membership(stored: DataFrame, fetched: DataFrame, today) -> DataFrame:
    """Stored snapshots and later fetched ones, but not those of the month still open."""
    last = stored.agg(F.max("snap_date").alias("__last"))
    fresh = fetched.crossJoin(F.broadcast(last)).where((F.col("__last").isNull() | (F.col("snap_date") > F.col("__last"))) & (F.trunc("snap_date", "month") < F.trunc(F.lit(today), "month"))).drop("__last")
    return stored.unionByName(fresh).dropDuplicates(["snap_date", "code"])


def accumulate(history: DataFrame, window: DataFrame, keys: list[str]) -> DataFrame:
    """History and a new window without repeats; history goes first, so running it again changes nothing."""
    return history.unionByName(window.join(history.select(*keys), keys, "left_anti").dropDuplicates(keys))


def coalesce_panel(fresh: DataFrame, cached: DataFrame, keys: list[str], value: str) -> DataFrame:
    c = cached.withColumnRenamed(value, "__old")
    return fresh.join(c, keys, "full").withColumn(value, F.coalesce(value, "__old")).drop("__old")


def resample_month_last(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.last_day("date").alias("month")).agg(F.max_by(value, "date").alias(value))
