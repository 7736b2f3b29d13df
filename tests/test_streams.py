"""Streams and versioned tables step by step: thin days, replays, late rows, rebases, restarts."""

import collections
import datetime as dt

import pytest

from panelspark.sources.versions import VersionedTable
from panelspark.streaming import streams

NOON = dt.datetime(2024, 1, 1, 12)


def minute(n, s=0):
    return NOON + dt.timedelta(minutes=n, seconds=s)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, tmp_path, batches, schema, start):
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        start(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).awaitTermination()


def test_a_thin_day_waits_and_goes_on_once(spark, tmp_path):
    codes = [f"c{i}" for i in range(10)]
    due = spark.createDataFrame([(day(n), c) for n in range(4) for c in codes], "date date, code string")
    row = lambda n, c: (day(n), c, 1.0)
    batches = [
        [row(0, c) for c in codes] + [row(1, c) for c in codes[:5]] + [row(2, c) for c in codes[:9]],
        [row(1, c) for c in codes[5:8]] + [row(3, "c1"), row(2, "c9"), row(3, "stranger")],
        [row(1, "c8"), row(1, "c8")],
        [row(1, "c9")],
    ]
    start = lambda s: streams.publication_gate(s, due, f"{tmp_path}/gate", f"{tmp_path}/state")
    run(spark, tmp_path, batches, "date date, code string, close double", start)
    got = spark.read.parquet(f"{tmp_path}/gate/released").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.v].append((r.date, r.code))
    assert sorted(by[0]) == sorted([(day(0), c) for c in codes] + [(day(2), c) for c in codes[:9]])
    assert by[1] == [(day(2), "c9")]
    assert sorted(by[2]) == sorted([(day(1), c) for c in codes[:9]] + [(day(1), "c8")])
    assert by[3] == [(day(1), "c9")]
    assert {(r.date, r.code) for r in spark.read.parquet(f"{tmp_path}/gate/pending/v=3").collect()} == {(day(3), "c1"), (day(3), "stranger")}


def test_a_replayed_fill_counts_once_and_its_id_expires(spark, tmp_path):
    fill = lambda i, n, shares, code="x": (1, code, i, minute(n), shares, 2.0, 0.5)
    batches = [[fill(1, 0, 10), fill(2, 1, 5), fill(1, 0, 10)], [fill(1, 0, 10), fill(3, 30, 7), fill(9, 30, 1, "y")], [fill(2, 1, 5), fill(4, 31, -2), fill(5, 2, 100)]]
    start = lambda s: streams.into_versions(streams.ledger_stream(s, late="5 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    run(spark, tmp_path, batches, "account long, code string, fill_id long, ts timestamp, shares long, price double, fee double", start)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.v):
        last[r.code] = (r.shares, r.paid)
    # fills 2 and 5 of the third batch are older than the watermark: dropped, whether seen or not
    assert last == {"x": (20, 2.0 * 20 + 0.5 * 4), "y": (1, 2.5)}


def expected_bars(batches, minutes, delay):
    top, kept, late = None, collections.defaultdict(list), collections.Counter()
    for rows in batches:
        mark = None if top is None else top - delay
        for key, ts, value, i in rows:
            for m in minutes:
                first = ts - dt.timedelta(minutes=ts.minute % m if m < 60 else ts.minute, seconds=ts.second)
                if mark is not None and first + dt.timedelta(minutes=m) <= mark:
                    late[key, m] += 1
                else:
                    kept[key, m, first].append((ts, i, value))
        top = max([*(r[1] for r in rows), *([top] if top else [])])
    out = set()
    for (key, m, first), x in kept.items():
        if first + dt.timedelta(minutes=m) <= top - delay:
            x.sort()
            out.add((key, m, first, x[0][2], max(v for *_, v in x), min(v for *_, v in x), x[-1][2], len(x)))
    return out, late


def test_bars_of_many_periods_and_their_late_rows(spark, tmp_path):
    batches = [
        [("a", minute(0, 5), 1.0, 1), ("a", minute(0, 5), 9.0, 2), ("a", minute(3), 4.0, 3), ("b", minute(12), 2.0, 4)],
        [("a", minute(0, 50), 7.0, 5), ("a", minute(4, 59), 8.0, 6), ("b", minute(95), 5.0, 7)],
        [("b", minute(59), 1.0, 8), ("b", minute(91), 3.0, 9), ("a", minute(130), 2.0, 10)],
    ]
    minutes, schema = (1, 5, 60), "key string, ts timestamp, value double, i int"
    want, late = expected_bars(batches, minutes, dt.timedelta(minutes=10))

    def bars(s):
        from pyspark.sql import functions as F

        d = streams.many_period_bars(s.withColumn("one", F.lit(1)), minutes, key="key", price="value", volume="one", late="10 minutes", tie="i")
        return d.writeStream.format("parquet").option("path", f"{tmp_path}/bars").option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start()

    def tardy(s):
        rows = streams.with_periods(s, minutes)
        return streams.into_versions(streams.late_rows(rows, ["key", "minutes"], rows["end"]), f"{tmp_path}/late", f"{tmp_path}/s2")

    run(spark, tmp_path, batches, schema, lambda s: bars(s))
    got = {(r.key, r.minutes, r.start, r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/bars").collect()}
    assert got == want and late
    run(spark, tmp_path / "again", batches, schema, tardy)
    counts = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/late").collect(), key=lambda r: r.v):
        counts[r.key, r.minutes] = r.late
    assert counts == dict(late)


def test_a_version_costs_what_changed_and_readers_keep_theirs(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t", "code string, n int", buckets=8)
    assert table.version() is None and table.read().count() == 0
    rows = [(f"c{i}", i) for i in range(40)]
    table.publish(spark.createDataFrame(rows, table.schema))
    before, at = table.read(), table.manifest()
    fresh = spark.createDataFrame([("c3", 300)], table.schema)
    changed = table.changed(fresh)
    assert table.publish(table.read(buckets=changed).where("code <> 'c3'").unionAll(fresh), changed) == 1
    assert {b for b, v in table.manifest().items() if v == 1} == changed and len(changed) == 1 and set(at.values()) == {0}
    assert {tuple(r) for r in before.collect()} == set(rows) == {tuple(r) for r in table.read(0).collect()}
    assert {tuple(r) for r in table.read().collect()} == {*rows[:3], ("c3", 300), *rows[4:]}
    # a version that is there is not written again, and a half-written one is not seen
    assert table.publish(fresh.limit(0), None, 1) == 1 and table.read().count() == 40
    fresh.write.parquet(f"{tmp_path}/t/data/v=2/bucket=0")
    assert table.version() == 1 and table.read().count() == 40
    table.publish(fresh.limit(0))
    assert table.version() == 2 and table.read().count() == 0


@pytest.mark.parametrize("again", [False, True])
def test_merged_bars_meet_every_mode(spark, tmp_path, again):
    table = VersionedTable(spark, f"{tmp_path}/t", "code string, date date, close double")
    first = [(c, day(n), 10.0 + n) for c in ("skip", "move", "grow") for n in range(3)]
    second = [("skip", day(1), 99.0), *(("move", day(n), 5.0 + n) for n in range(4)), ("grow", day(2), 12.0), ("grow", day(3), 13.0), ("new", day(0), 1.0)]
    start = lambda s: streams.bars_merge(s, table, f"{tmp_path}/state")
    run(spark, tmp_path, [first, second], "code string, date date, close double", start)
    if again:  # the checkpoint is lost: the same rows come in one batch, whose version is there
        streams.bars_merge(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/lost").awaitTermination()
    want = {(c, day(n), 10.0 + n) for c in ("skip", "grow") for n in range(3)} | {("grow", day(3), 13.0), ("new", day(0), 1.0)} | {("move", day(n), 5.0 + n) for n in range(4)}
    assert {tuple(r) for r in table.read().collect()} == want and table.version() == 1
