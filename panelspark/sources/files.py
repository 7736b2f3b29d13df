"""Readers and writers of the panel's files. Filters and columns reach the Parquet scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place under the shared folder."""
    return f"{shared_dir(spark)}/panelspark-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own under the shared folder: what is read many times is computed once, and lost executors cost their tasks only."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_bars(spark: SparkSession, path: str, fields: tuple[str, ...] = ("close",), codes: list[str] | None = None, start=None, end=None) -> DataFrame:
    d = spark.read.parquet(path)
    if codes is not None:
        d = d.where(F.col("code").isin(codes))
    if start is not None:
        d = d.where(F.col("date") >= F.lit(start))
    if end is not None:
        d = d.where(F.col("date") <= F.lit(end))
    return d.select("code", "date", *fields)


def scan_keyed_dir(spark: SparkSession, path: str, key: str = "code", folder: str | None = None) -> DataFrame:
    """Files, or folders `folder=key.parquet`, named by their key, as one table with the key as a column."""
    d = spark.read.parquet(path)
    if folder:
        return d.withColumn(key, F.regexp_replace(folder, r"\.parquet$", "")).drop(folder)
    return d.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?\.parquet$", 1))


def scan_reports(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """(code, stat_date, pub_date, value) of reports that landed as text, typed; without a publication date a report is left out."""
    d = spark.read.schema(f"code string, stat_date string, pub_date string, `{value}` string").parquet(path)
    return d.select("code", *(F.col(c).try_cast("date").alias(c) for c in ("stat_date", "pub_date")), F.col(value).try_cast("double").alias(value)).where("pub_date is not null")


def scan_csv(spark: SparkSession, path: str, schema: str, where: str | None = None) -> DataFrame:
    d = spark.read.csv(path, schema=schema, header=True)
    return d.where(where) if where else d


def sink_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def sink_json_report(summary: DataFrame, positions: DataFrame, fills: DataFrame, path: str, key: str = "account") -> DataFrame:
    """One JSON record for each account: its summary, positions as a map, and fills as an array."""
    p = positions.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "shares")))).alias("positions"))
    f = fills.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "code", "shares", "price"))).alias("fills"))
    out = summary.join(p, key, "left").join(f, key, "left")
    out.write.mode("overwrite").json(path)
    return out
