"""Incremental forms of the panel's operators, in Structured Streaming. Each has a batch form that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from panelspark.operators import ingest
from panelspark.sources.versions import VersionedTable


def minute_dedup(stream: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Overlapping windows without repeats; rows later than the watermark are dropped, see late_rows."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def late_rows(stream: DataFrame, keys: list[str], end: Column, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(keys, late): how many rows arrived when the watermark had passed their `end` (of their window, or their own time): those that a stateful operator drops.

    Of the same stream and watermark as that operator; the counts of a key grow with each batch that has such rows.
    """
    import pandas as pd

    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString()}" for k in keys)

    def count(key, frames, state):
        before = state.get[0] if state.exists else 0
        mark = state.getCurrentWatermarkMs()
        n = before + sum(int((d["__end"] <= mark).sum()) for d in frames)
        state.update((n,))
        if n > before:
            yield pd.DataFrame([(*key, n)], columns=[*keys, "late"])

    rows = stream.withColumn("__end", F.unix_millis(end)).withWatermark(at, late)
    return rows.groupBy(*keys).applyInPandasWithState(count, f"{kinds}, late long", "n long", "update", GroupStateTimeout.NoTimeout)


def period_bars(rows: DataFrame, period: str = "5 minutes", key: str = "symbol", at: str = "ts", price: str = "price", volume: str = "volume", late: str | None = None, tie: str | None = None) -> DataFrame:
    """Open, high, low, close and volume of tumbling windows; the same expression in batch and, with a watermark, in a stream. tie: orders rows of one time."""
    d = rows.withWatermark(at, late) if late else rows
    order = F.struct(at, tie) if tie else F.col(at)
    g = d.groupBy(key, F.window(at, period).alias("w")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"))
    return g.select(key, F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def many_period_bars(rows: DataFrame, minutes: tuple[int, ...] = (1, 5, 15, 30, 60), **named) -> DataFrame:
    """period_bars of several lengths from one stream: one more column, minutes. A window leaves the state, and is given out, when the watermark passes its end."""
    parts = [period_bars(rows, f"{m} minutes", **named).withColumn("minutes", F.lit(m)) for m in minutes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_periods(rows: DataFrame, minutes: tuple[int, ...], at: str = "ts") -> DataFrame:
    """A row for each length, with the end of its window: what late_rows needs for many_period_bars."""
    d = rows.withColumn("minutes", F.explode(F.array(*map(F.lit, minutes))))
    length = F.col("minutes") * 60
    return d.withColumn("end", F.timestamp_seconds((F.floor(F.unix_seconds(at) / length) + 1) * length))


#: Parts of a unit of money that sums are kept in: whole numbers, so their order doesn't matter.
PARTS = 10**7


def ledger_stream(fills: DataFrame, at: str = "ts", late: str = "10 days") -> DataFrame:
    """(account, code, shares, paid) after each batch, of the keys that it changed; a fill that comes again does not count again.

    fills: (account, code, fill_id, ts, shares, price, fee). State of a key: its sums, and the ids of its fills with their times. An id
    leaves the state when the watermark passes its time, as from then on Spark drops the fill itself as late.
    """
    import pandas as pd

    def fold(key, frames, state):
        shares, paid, ids, times = state.get if state.exists else (0, 0, [], [])
        seen, before = dict(zip(ids, times, strict=True)), (shares, paid)
        if not state.hasTimedOut:
            for d in frames:
                d = d.drop_duplicates("fill_id")
                d = d[~d["fill_id"].isin(list(seen))]
                shares += int(d["shares"].sum())
                paid += int(d["__paid"].sum())
                seen |= dict(zip(d["fill_id"].tolist(), d["__ms"].tolist(), strict=True))
        mark = state.getCurrentWatermarkMs()
        seen = {k: t for k, t in seen.items() if t > mark}
        state.update((shares, paid, list(seen), list(seen.values())))
        if seen:
            state.setTimeoutTimestamp(min(seen.values()) + 1)
        if (shares, paid) != before:
            yield pd.DataFrame([(*key, shares, paid / PARTS)], columns=["account", "code", "shares", "paid"])

    parts = F.round((F.col("shares") * F.col("price") + F.col("fee")) * PARTS).cast("long")
    d = fills.withColumns({"__ms": F.unix_millis(at), "__paid": parts}).withWatermark(at, late)
    kinds = ", ".join(f"{k} {fills.schema[k].dataType.simpleString()}" for k in ("account", "code"))
    return d.groupBy("account", "code").applyInPandasWithState(fold, f"{kinds}, shares long, paid double", "shares long, paid long, ids array<long>, times array<long>", "update", GroupStateTimeout.EventTimeTimeout)


def into_versions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch under path/v=N; a repeated batch overwrites its own folder."""
    write = lambda b, n: b.write.mode("overwrite").parquet(f"{path}/v={n}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bars_merge(stream: DataFrame, table: VersionedTable, checkpoint: str) -> StreamingQuery:
    """Merge each arriving batch of bars into the table as version N. Only buckets of codes that the batch changes are read and written; a repeated batch finds its version and does nothing."""

    def merge(batch: DataFrame, n: int) -> None:
        last = table.version()
        if last is not None and last >= n:
            return
        touched = table.changed(batch)
        old = table.read(last, touched)
        merged, modes = ingest.incremental_bars_merge(old, batch)
        changed = table.changed(modes.where("mode <> 'skip'"))
        table.publish(merged.where(table.bucket().isin(sorted(changed))) if changed else merged.limit(0), changed, n)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publication_gate(stream: DataFrame, due: DataFrame, path: str, checkpoint: str, least: float = 0.9) -> StreamingQuery:
    """Hold each date back until enough of those due, (date, code), have a row, then hand on all that waits for it, once.

    Batch N writes path/released/v=N, what goes on; path/opened/v=N, the dates that opened; path/pending/v=N, what still waits. Rows of a
    date that is open go on at once. Each is made from version N - 1 and the batch, so a repeated batch rewrites the same rows.
    """

    def gate(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        read = lambda name, at, schema: spark.read.schema(schema).parquet(f"{path}/{name}{at}")
        waiting = batch if n == 0 else batch.unionByName(read("pending", f"/v={n - 1}", batch.schema))
        waiting.write.mode("overwrite").parquet(f"{path}/waiting/v={n}")
        waiting = read("waiting", f"/v={n}", batch.schema)
        own = due.join(waiting.select("date").distinct(), "date", "left_semi").select("date", "code").distinct()
        posted = own.join(waiting.select("date", "code").distinct().withColumn("__has", F.lit(1)), ["date", "code"], "left")
        share = posted.groupBy("date").agg((F.count("__has") / F.count("*")).alias("share"))
        share.where(F.col("share") >= least).select("date").write.mode("overwrite").parquet(f"{path}/opened/v={n}")
        opened = read("opened", "", "date date, v int").where(F.col("v") <= n).select("date").distinct()
        waiting.join(opened, "date", "left_semi").write.mode("overwrite").parquet(f"{path}/released/v={n}")
        waiting.join(opened, "date", "left_anti").write.mode("overwrite").parquet(f"{path}/pending/v={n}")

    return stream.writeStream.foreachBatch(gate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_flags(stream: DataFrame, direction: int) -> DataFrame:
    """(code, date) where a code's flag newly takes the direction, as days arrive in order. State: the last flag of each code."""
    import pandas as pd

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        for d in frames:
            for date, flag in sorted(zip(d["date"], d["flag"], strict=True)):
                f = None if pd.isna(flag) else int(flag)
                if f == direction and last != direction:
                    out.append((key[0], date))
                last = f
        state.update((last,))
        yield pd.DataFrame(out, columns=["code", "date"])

    return stream.groupBy("code").applyInPandasWithState(step, "code string, date date", "last int", "append", GroupStateTimeout.NoTimeout)
