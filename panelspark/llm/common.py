"""Shared pieces of the text operators: Arrow buffers as numpy, hashing, tables cut from their lineage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer single text is one step of its own.
STEP_BYTES = 1 << 21

#: Stands for a null key: after all others.
NO_KEY = (1 << 63) - 1

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_POW: dict[str, np.ndarray] = {}

#: Byte classes: white space as in the regular expression [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters and digits of ASCII, and every byte of a longer UTF-8 character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def give_back(collect: bool = True) -> None:
    """Return memory that is free but still held by Arrow and the C library, as after work on a large sample; nothing where they have no such call."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at the end of its task what it freed is given back: a worker lives on, idle or at other tasks, beside all others of its executor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back(collect=False)

    return task


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/panelspark-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id) -> F.Column:
    """True for the third of the documents that nothing is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def bounded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df, chosen by a hash of key; all of df if it has no more. Rows at most 1.2 times that in practice."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of an odd multiplier and of its inverse modulo 2**64."""
    if "p" not in _POW or len(_POW["p"]) < n:
        size = max(n, (STEP_BYTES >> 2) + 1024)
        for k, m in (("p", _MULT), ("i", _INV)):
            a = np.full(size, m, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW["p"][:n], _POW["i"][:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * multiplier**position; see span_hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the values in each [start, end), whatever stands around it."""
    inv = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row starts (one more entry at the end). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if pa.types.is_string(col.type) else col
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `size` bytes of text each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        off = text_bytes(col)[1]
        i = 0
        while i < len(col):
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def words(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside `gap` (never across rows), and the index of each row's first run (one more at the end)."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~gap[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, off)


def fold_case(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented capitals U+00C0 to U+00DE."""
    out = LOWER[raw]
    if len(raw) > 1:
        up = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        out[up] += 0x20
    return out


def within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    out, have = a, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The runs [start, end) of UTF-8 bytes as a column of strings."""
    off = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    body = raw[np.repeat(start - off[:-1], end - start) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.string())


#: Bits of a map of hashes at most.
MOST_BITS = 1 << 26


def hash_bits(hashes: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Bitmap of a column `hash`, of at most `most` bits however many there are. Spark puts its words together, so at most most / 64 rows arrive here."""
    n = hashes.distinct().count()
    width = min(most, 1 << max(10, int(n * 64 - 1).bit_length() if n else 0))
    at = F.shiftright(F.col("hash").bitwiseAND(width - 1), 6).cast("int").alias("at")
    w = hashes.select(at, F.expr("shiftleft(1L, CAST(hash & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(width // 64, np.uint64)
    out[w.column("at").to_numpy()] = w.column("bits").to_numpy().view(np.uint64)
    return out


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bitmap has each hash: always for those it was made of, and for few others."""
    bit = h & np.uint64(len(bits) * 64 - 1)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
