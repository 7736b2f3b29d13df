"""A table in versions: only what changed is written, and a manifest says which version holds each bucket of keys.

A version is there once its manifest is; that is one small file, renamed into place, so a reader sees the version before or the one after
and never a mixture, and what it reads is not touched by later ones. Data go to new folders, never over old ones.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """path/data/v=N/bucket=B holds rows, path/manifest/v=N one row (bucket, at) for each bucket: at most `buckets` rows, whatever the table's size."""

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "code", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("bucket int, at int, v int").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def version(self) -> int | None:
        """The newest version that is published."""
        m = self._manifests()
        return None if m is None else m.agg(F.max("v")).first()[0]

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """Which version each bucket's rows are in, as of a version (the newest)."""
        version = self.version() if version is None else version
        return {} if version is None else {r.bucket: r.at for r in self._manifests().where((F.col("v") == version) & (F.col("bucket") >= 0)).collect()}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows as of a version (the newest), of some buckets if they are given: only their files are opened."""
        at = {b: v for b, v in self.manifest(version).items() if buckets is None or b in buckets}
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(at.items())))

    def changed(self, rows: DataFrame) -> set[int]:
        """The buckets that rows fall into."""
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}

    def publish(self, rows: DataFrame, changed: set[int] | None = None, version: int | None = None) -> int:
        """Write a version whose `changed` buckets (all) hold `rows`; the others stay as they are. A version that was published already stays."""
        last = self.version()
        version = (-1 if last is None else last) + 1 if version is None else version
        if last is not None and last >= version:
            return last
        keep = {} if changed is None else {b: v for b, v in self.manifest(last).items() if b not in changed}
        data = f"{self.path}/data/v={version}"
        rows.select(*self.schema.names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        there = self.spark.read.schema("bucket int").parquet(data).distinct().collect()
        entries = [*keep.items(), *((r.bucket, version) for r in there)] or [(-1, version)]  # an empty version has a manifest too
        self.spark.createDataFrame(entries, "bucket int, at int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        return version
