"""Bringing equal windows of a corpus together without bringing everything together.

A window is n consecutive units (words, bytes) of one text. Its minimiser is the run of `gram` units inside it with the
smallest hash: equal windows have equal minimisers, and neighbouring windows mostly share one. So a text falls into
segments, runs of windows with one minimiser, and a window that occurs twice lies in two segments of the same
shard. Only minimisers that occur twice matter: they are told by a bitmap of bounded size, whose false alarms cost
work and never results. Minimisers that are very frequent are split further by a second, longer one.

Equal segments are one row for each task with their number and smallest owner, so copies collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import mix, prefix_hash, sliding_min, span_hash, steps, text_bytes

#: Bits of the bitmap at most: 64 MB, whatever the corpus.
ADDRESS = 29
MAX_BITS = 1 << ADDRESS
#: Text that a task gathers before it gives out what it has counted.
FLUSH_BYTES = 16 << 20
#: Text in one numpy step: a unit may be a byte, and takes about 20 numbers of 8 bytes then.
STEP = 1 << 18
#: Text of the corpus for each shard.
SHARD_BYTES = 1 << 20

#: bytes and row offsets to: unit values (64-bit), first unit of each row, byte range of units a..b of the whole.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]]


@dataclass
class Plan:
    """Window, minimiser and second minimiser in units; number of buckets and shards; the bitmap; the frequent minimisers."""

    window: int
    gram: int
    long_gram: int
    buckets: int
    shards: int
    bitmap: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def places(self, values: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the run of `gram` units at each place, and the place of the minimiser of the window at each place."""
        at = np.arange(max(0, len(values) - gram + 1))
        h = span_hash(prefix_hash(values), at, at + gram)
        packed = (h & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
        return h, (sliding_min(packed, self.window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def windows(self, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Row of each unit, and the places where a window of one row starts."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        places = max(0, n - self.window + 1)
        return row, np.flatnonzero(np.arange(places) + self.window <= first[1:][row[:places]])

    def minimisers(self, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The minimiser of each segment."""
        _, start = self.windows(first, len(values))
        if not len(start):
            return np.zeros(0, np.uint64)
        h, place = self.places(values, self.gram)
        place = place[start]
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        return h[place[new]]

    def repeated(self, grams: np.ndarray) -> np.ndarray:
        """Whether the bitmap has each minimiser."""
        bit = grams & np.uint64(len(self.bitmap) * 8 - 1)
        return (self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0

    def segments(self, values: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Segments whose minimiser may occur twice: row, unit where it starts (from the first row's), windows, shard, two hashes."""
        row, start = self.windows(first, len(values))
        z = np.zeros(0, np.int64)
        if not len(start):
            return {"row": z, "at": z, "windows": z, "shard": z, "h1": z, "h2": z}
        h, place = self.places(values, self.gram)
        place, key = place[start], h[place[start]]
        ok = self.repeated(key)
        start, place, key = start[ok], place[ok], key[ok]
        second = np.zeros(len(key), np.int64)
        if len(self.hot) and len(key):
            i = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            busy = np.flatnonzero(self.hot[i] == key)
            if len(busy):
                h2, place2 = self.places(values, self.long_gram)
                second[busy] = place2[start[busy]] + 1
                key = key.copy()
                key[busy] = mix(key[busy] ^ h2[place2[start[busy]]])
        new = np.ones(len(start), bool)
        new[1:] = (place[1:] != place[:-1]) | (second[1:] != second[:-1]) | (start[1:] != start[:-1] + 1)
        at = start[new]
        count = np.diff(np.append(np.flatnonzero(new), len(start)))
        prefix = prefix_hash(values)
        h2 = span_hash(prefix, at, at + count + self.window - 1)
        return {"row": row[at], "at": at, "windows": count, "shard": (key[new] % np.uint64(self.shards)).astype(np.int64), "h1": key[new].view(np.int64), "h2": h2.view(np.int64)}


def _turned(grams: np.ndarray) -> np.ndarray:
    """The hash with the bits that address the bitmap in front."""
    return np.left_shift(grams, np.uint64(64 - ADDRESS)) | np.right_shift(grams, np.uint64(ADDRESS))


def _turned_back(grams: np.ndarray) -> np.ndarray:
    return np.right_shift(grams, np.uint64(64 - ADDRESS)) | np.left_shift(grams, np.uint64(ADDRESS))


def _power(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, n)))))


def plan(docs: DataFrame, units: Units, window: int, gram: int, long_gram: int, unit_bytes: int = 1) -> Plan:
    """Count minimisers over the whole corpus; keep a bitmap of those that occur twice and the list of very frequent ones. docs: (id, text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    p = Plan(window, gram, long_gram, buckets=max(64, _power(total / SHARD_BYTES)), shards=max(64, _power(total / SHARD_BYTES)))
    p.buckets = min(p.buckets, 1 << 22)  # a slice has 128 bits at least

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            # in the order of the bitmap's bits, so that a bucket owns a slice of the bitmap
            g, n = np.unique(_turned(np.concatenate(held)), return_counts=True)
            cut = np.searchsorted(g >> np.uint64(64 - ADDRESS), np.arange(p.buckets + 1, dtype=np.uint64) * np.uint64(MAX_BITS // p.buckets))
            rows = [(b, g[i:j].tobytes(), np.minimum(n[i:j], 255).astype(np.uint8).tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "grams", "counts"])

        held, size = [], 0
        for batch in steps(batches, size=STEP):
            raw, off = text_bytes(batch.column(1))
            values, first, _ = units(raw, off)
            held.append(p.minimisers(values, first))
            size += len(raw)
            if size >= FLUSH_BYTES:
                yield out()
                held, size = [], 0
        if sum(map(len, held)):
            yield out()

    counted = docs.mapInArrow(count, "bucket int, grams binary, counts binary")

    def unify(t: pa.Table) -> pa.Table:
        g = np.frombuffer(b"".join(t.column("grams").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8)
        g, back = np.unique(g, return_inverse=True)
        n = np.bincount(back, n, len(g)).astype(np.int64)
        twice = np.unique(g[n > 1] >> np.uint64(64 - ADDRESS)) & np.uint64(slice_bits - 1)
        bits, packed = twice.astype(np.uint32).tobytes(), False
        if len(bits) > slice_bits // 8:
            full = np.zeros(slice_bits, bool)
            full[twice.astype(np.int64)] = True
            bits, packed = np.packbits(full, bitorder="little").tobytes(), True
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "repeats": pa.array([int((n > 1).sum())], pa.int64()), "bits": pa.array([bits], pa.binary()), "packed": pa.array([packed]), "hot": pa.array([_turned_back(g[n >= often]).tobytes()], pa.binary())})

    slice_bits = MAX_BITS // p.buckets
    # so many occurrences at least, so that at most HOT_MOST minimisers can have them: about two windows in (window - gram + 2) open a segment
    often = max(HOT_COUNT, int(4 * total / unit_bytes / (window - gram + 2) / HOT_MOST))
    rows = counted.groupBy("bucket").applyInArrow(unify, "bucket int, repeats long, bits binary, packed boolean, hot binary")
    hot, repeats = [], 0
    # a bucket sends its slice of the bitmap, or the places of its bits if that is less: MAX_BITS / 8 bytes together at most, whatever the corpus
    bitmap = np.zeros(MAX_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = r.bucket * (slice_bits // 8)
        own = bitmap[at : at + slice_bits // 8]
        if r.packed:
            own |= np.frombuffer(r.bits, np.uint8)
        else:
            i = np.frombuffer(r.bits, np.uint32)
            np.bitwise_or.at(own, i >> 3, (1 << (i & 7)).astype(np.uint8))
        hot.append(np.frombuffer(r.hot, np.uint64))
        repeats += r.repeats
    width = min(MAX_BITS, _power(max(1 << 16, 32 * repeats)))
    p.bitmap = np.bitwise_or.reduce(bitmap.reshape(-1, width // 8), axis=0)
    p.hot = np.sort(np.concatenate([np.zeros(0, np.uint64), *hot]))
    return p


#: A minimiser counted this often is split by the second one (counts are capped at 255 for each task and flush).
HOT_COUNT = 2000
#: In a corpus where more than so many could be counted that often, the count grows, so the list stays below this.
HOT_MOST = 1 << 20


def distinct_segments(docs: DataFrame, units: Units, p: Plan) -> DataFrame:
    """(shard, h1, h2, body, windows, owner, n): equal segments once for each task and flush, with the smallest id and their number."""
    model = docs.sparkSession.sparkContext.broadcast(p)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            cols = list(zip(*((*k, *v) for k, v in seen.items()), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[2], pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())], ["shard", "h1", "h2", "body", "windows", "owner", "n"])

        seen: dict[tuple[int, int], list] = {}
        size = 0
        for batch in steps(batches, size=STEP):
            raw, off = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            values, first, body = units(raw, off)
            s = model.value.segments(values, first)
            for row, at, n, shard, h1, h2 in zip(*(s[k].tolist() for k in ("row", "at", "windows", "shard", "h1", "h2")), strict=True):
                old = seen.get((h1, h2))
                if old is None:
                    seen[h1, h2] = [shard, body(at, at + n + p.window - 1), n, int(ids[row]), 1]
                else:
                    old[3] = min(old[3], int(ids[row]))
                    old[4] += 1
            size += len(raw)
            if size >= FLUSH_BYTES and seen:
                yield out()
                seen, size = {}, 0
        if seen:
            yield out()

    return docs.mapInArrow(cut, "shard int, h1 long, h2 long, body binary, windows int, owner long, n long")


#: Stands for a null key: after all others.
NO_KEY = (1 << 63) - 1


def rows_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, row, key): id is the key, or NO_KEY for null; row tells rows apart that share a key.

    row is a digest of key and text: what is cut from a row depends on these alone, and unlike a counter it is the same
    however often and in whatever order the rows are read.
    """
    k, t = F.col(key).cast("long"), F.col(text)
    row = F.unhex(F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(t, F.lit(""))).cast("binary")))
    return df.select(F.coalesce(k, F.lit(NO_KEY)).alias("id"), t.alias("text"), row.alias("row"), k.alias("key"))


def occurrences(docs: DataFrame, units: Units, p: Plan) -> DataFrame:
    """(h1, h2, id, row, at): where each segment starts in its text, in units. docs: (id, text, row)."""
    model = docs.sparkSession.sparkContext.broadcast(p)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=STEP):
            raw, off = text_bytes(batch.column(1))
            values, first, _ = units(raw, off)
            s = model.value.segments(values, first)
            yield pa.RecordBatch.from_arrays([pa.array(s["h1"]), pa.array(s["h2"]), *(batch.column(k).take(pa.array(s["row"])) for k in (0, 2)), pa.array((s["at"] - first[s["row"]]).astype(np.int32))], ["h1", "h2", "id", "row", "at"])

    return docs.mapInArrow(cut, "h1 long, h2 long, id long, row binary, at int")


@dataclass
class Merged:
    """The distinct segments of one shard in order of (h1, h2): windows, smallest owner, number, and whether it has its minimiser to itself."""

    table: pa.Table
    rows: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    windows: np.ndarray
    owner: np.ndarray
    times: np.ndarray
    alone: np.ndarray

    def bodies(self, which: np.ndarray) -> list[bytes]:
        return self.table.column("body").take(pa.array(self.rows[which])).to_pylist()

    def spans(self, seg: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray) -> pa.Table:
        """One row for each run of windows lo..hi-1 of a segment."""
        return pa.table({"h1": self.h1[seg], "h2": self.h2[seg], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "owner": owner.astype(np.int64)})


def merged(t: pa.Table) -> Merged:
    """The rows of one shard with equal segments made one."""
    h1, h2 = t.column("h1").to_numpy(), t.column("h2").to_numpy()
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    at = np.flatnonzero(new)
    owner = np.minimum.reduceat(t.column("owner").to_numpy()[order], at)
    n = np.add.reduceat(t.column("n").to_numpy()[order], at)
    rows = order[at]
    g = h1[rows]
    edge = np.ones(len(g) + 1, bool)
    edge[1:-1] = g[1:] != g[:-1]
    return Merged(t, rows, g, h2[rows], t.column("windows").to_numpy()[rows], owner, n, edge[1:] & edge[:-1])


SPANS = "h1 long, h2 long, lo int, hi int, owner long"


def removed(found: DataFrame, where: DataFrame, smaller_owner: bool) -> DataFrame:
    """(row, cuts): for each text the runs of windows to remove as start << 32 | end, in units. A run counts for a text only if a smaller id owns it, or for all."""
    hit = where.join(found, ["h1", "h2"])
    if smaller_owner:
        hit = hit.where("owner < id")
    packed = F.shiftleft((F.col("at") + F.col("lo")).cast("long"), 32) + (F.col("at") + F.col("hi")).cast("long")
    return hit.groupBy("row").agg(F.collect_list(packed).alias("cuts"))


def covered(n: int, cuts: np.ndarray, window: int) -> np.ndarray:
    """Which of n units a removed window covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, cuts >> 32, 1)
    np.add.at(edge, (cuts & 0xFFFFFFFF) + window - 1, -1)
    return np.cumsum(edge[:n]) > 0
