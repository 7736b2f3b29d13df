"""Repeated byte strings, by suffix arrays that are built by induced sorting.

Segments that may repeat are routed to shards (see routing). A segment that has its minimiser to itself is settled: its windows
repeat if it stands at two places, and can't otherwise. A shard's other distinct segments form one sequence. Its suffixes
are classified as L or S; the leftmost S suffixes' substrings are sorted by induction and named; where names repeat, runs of
1, 2, 4, ... names are named in turn, each from the two it is made of, until no name repeats; and the order of the other suffixes
is induced from the leftmost S suffixes', bucket by bucket. Common prefixes of
neighbours are computed in text order (permuted): only where a suffix and its predecessor differ in the byte before them
is a prefix measured, elsewhere it is one less than its left neighbour's. Suffixes that share a window with a neighbour
form runs; a window repeats if its run stands for two places or more, in one document or in several.

Defined results: null and empty texts have no bytes; a text shorter than a window loses nothing; bytes go whether or not
they cut a character, so what is kept is bytes; rows that repeat a key, and rows whose key is null, count as texts of their own; an empty
table gives an empty result; only the key and the outputs are returned, so clashing columns of the input do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import routing
from panelspark.llm.common import materialize, powers, prefix_hash, span_hash, steps, text_bytes

WINDOW, GRAM, LONG_GRAM = 200, 64, 128
#: Common prefixes are measured by steps of this many bytes first, then by halves of it.
REACH = 256


def byte_units(raw: np.ndarray, off: np.ndarray):
    data = raw.tobytes()
    return raw, off, lambda a, b: data[a:b]


def s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one counts as such."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    nxt = np.minimum.accumulate(np.where(differs, np.arange(n), n - 1)[::-1])[::-1]
    return (nxt == n - 1) | (t[nxt] < t[np.minimum(nxt + 1, n - 1)])


def induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost S suffixes induces, a bucket of the alphabet at a time."""
    none = np.zeros(0, lms.dtype)
    by = np.argsort(t[lms], kind="stable")
    seeds = np.split(lms[by], np.cumsum(np.bincount(t[lms], minlength=size))[:-1])

    def push(waiting: list[list[np.ndarray]], scanned: np.ndarray, keep) -> None:
        left = scanned[scanned > 0] - 1
        c = t[left]
        ok = keep(c)
        left, c = left[ok], c[ok]
        if len(left):
            order = np.argsort(c, kind="stable")
            left, c = left[order], c[order]
            cut = np.flatnonzero(c[1:] != c[:-1]) + 1
            for a, b in zip(np.append(0, cut), np.append(cut, len(c)), strict=True):
                waiting[c[a]].append(left[a:b])

    def run(first: np.ndarray, c: int, s: bool) -> np.ndarray:
        """A bucket's suffixes of one type: those placed already, then those that repeat its symbol before them."""
        parts, last = [first], first
        while len(last):
            last = last[last > 0] - 1
            last = last[(t[last] == c) & (is_s[last] == s)]
            parts.append(last)
        return np.concatenate(parts)

    waiting: list[list[np.ndarray]] = [[] for _ in range(size)]
    large: list[np.ndarray] = []
    for c in range(size):
        part = run(np.concatenate([none, *waiting[c]]), c, False)
        large.append(part)
        push(waiting, np.concatenate([part, seeds[c]]), lambda x, c=c: x > c)
    waiting = [[] for _ in range(size)]
    small: list[np.ndarray] = [none] * size
    waiting[t[-1]].append(np.array([len(t) - 1], lms.dtype))
    for c in range(size - 1, -1, -1):
        part = run(np.concatenate([none, *waiting[c]]), c, True)
        small[c] = part[::-1]
        push(waiting, np.concatenate([part, large[c][::-1]]), lambda x, c=c: x < c)
    return np.concatenate([x for c in range(size) for x in (large[c], small[c])])


def order_of_names(name: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names: names of runs of 1, 2, 4, ... from the names of their halves, for those not told apart yet."""
    n = len(name)
    rank = np.concatenate([[0], np.cumsum(np.bincount(name))])[name]  # how many suffixes have a smaller name
    step = 1
    while True:
        open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
        if not len(open_):
            break
        ahead = open_ + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(rank[open_] * (n + 1) + second)
        open_, second = open_[order], second[order]
        first = rank[open_]
        old = np.ones(len(open_), bool)
        old[1:] = first[1:] != first[:-1]
        new = old.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(open_))
        rank[open_] = first + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(old, at, 0))
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Order of the suffixes of t, whose symbols are below `size`, some hundreds, and whose last one is smaller than all others."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.uint16)
    is_s = s_types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32 if n < 1 << 31 else np.int64)
    order = induce(t, is_s, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # a leftmost S substring reaches to the next one, both ends included
    end = np.append(lms[1:] + 1, n)
    prefix = prefix_hash(t)
    h = span_hash(prefix, lms, end)
    place = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    place[lms] = np.arange(len(lms))
    i = place[order]
    h, length = h[i], (end - lms)[i]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (length[1:] != length[:-1])
    if not new.all():
        name = np.empty(len(lms), np.int64)
        name[i] = np.cumsum(new) - 1
        order = lms[order_of_names(name)]
    return induce(t, is_s, order, size)


def permuted_prefixes(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the length of the prefix it shares with the one before it in suffix order."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    irreducible = (before <= 0) | (at == 0) | (t[at - 1] != t[before - 1])
    i = np.flatnonzero(irreducible & (before >= 0))
    j, length, prefix, inv = before[i], np.zeros(len(i), np.int64), prefix_hash(t), powers(n + 1)[1]

    def same(which: np.ndarray, step: int) -> np.ndarray:
        """Those of `which` whose next `step` bytes are the same on both sides."""
        a, b = i[which] + length[which], j[which] + length[which]
        fits = np.maximum(a, b) + step <= n
        which, a, b = which[fits], a[fits], b[fits]
        return which[(prefix[a + step] - prefix[a]) * inv[a] == (prefix[b + step] - prefix[b]) * inv[b]]

    far = np.arange(len(i))
    while len(far := same(far, REACH)):
        length[far] += REACH
    step = REACH // 2
    while step:
        length[same(np.arange(len(i)), step)] += step
        step //= 2
    value = np.zeros(n, np.int64)
    value[i] = length
    source = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.maximum(value[source] - (at - source), 0)


def search_shard(window: int):
    """The search of one shard: runs of windows of each segment that stand at two places or more."""

    def run(t: pa.Table) -> pa.Table:
        m = routing.merged(t)
        settled = np.flatnonzero(m.alone & (m.times > 1))
        whole = m.spans(settled, np.zeros(len(settled)), m.windows[settled], np.zeros(len(settled)))
        among = np.flatnonzero(~m.alone)
        if not len(among):
            return whole
        bodies, count, times = m.bodies(among), m.windows[among], m.times[among]
        size = np.array([len(b) for b in bodies])
        # 0 ends the sequence, 1 each segment, bytes follow
        text = np.frombuffer(b"".join(b + b"\0" for b in bodies) + b"\0", np.uint8).astype(np.uint16) + 2
        ends = np.cumsum(size + 1) - 1
        text[ends], text[-1] = 1, 0
        order = suffix_array(text, 258)
        shared = permuted_prefixes(text, order)[order] >= window
        weight = np.zeros(len(text), np.int64)
        base = ends - size
        seg = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
        at = base[seg] + within
        weight[at] = times[seg]
        head = np.flatnonzero(~shared)
        run_of = np.cumsum(~shared) - 1
        total = np.add.reduceat(weight[order], head)
        repeats = np.zeros(len(text), bool)
        repeats[order] = total[run_of] > 1
        hit = repeats[at]
        edge = np.ones(len(seg), bool)
        edge[1:] = (seg[1:] != seg[:-1]) | (hit[1:] != hit[:-1])
        i = np.flatnonzero(edge)
        j = np.append(i[1:], len(seg))
        first = np.cumsum(count) - count
        i, j = i[hit[i]], j[hit[i]]
        return pa.concat_tables([whole, m.spans(among[seg[i]], i - first[seg[i]], j - first[seg[i]], np.zeros(len(i)))])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, long_gram: int = LONG_GRAM) -> DataFrame:
    """(row, cuts) of the texts that hold a window which stands anywhere else. docs: (id, text, row)."""
    plain = docs.select("id", "text")
    p = routing.plan(plain, byte_units, window, gram, long_gram)
    segments = routing.distinct_segments(plain, byte_units, p)
    found = materialize(segments.groupBy("shard").applyInArrow(search_shard(window), routing.SPANS), "found")
    return routing.removed(found, routing.occurrences(docs.select("id", "text", "row"), byte_units, p), smaller_owner=False)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, outputs: tuple[str, ...] = ("n_bytes", "n_removed", "n_spans", "kept", "spans")) -> DataFrame:
    """Every text, as bytes, without those that a repeated window covers.

    outputs: of n_bytes, n_removed, n_spans (maximal removed runs), spans (their starts and ends), kept (bytes), kept_sha256.
    """
    docs = routing.rows_of(df, key, text)
    cuts = repeated_windows(docs, window, min(GRAM, window), min(LONG_GRAM, window))
    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "spans": pa.list_(pa.list_(pa.int64())), "kept": pa.binary(), "kept_sha256": pa.string()}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            cols: dict[str, list] = {o: [] for o in outputs}
            for text_, c in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = (text_ or "").encode()
                kept, spans = raw, np.zeros((0, 2), np.int64)
                if c.is_valid:
                    gone = routing.covered(len(raw), c.values.to_numpy(), window)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    spans = edges.reshape(-1, 2)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = {"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": len(spans), "spans": spans.tolist(), "kept": kept, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                for o in outputs:
                    cols[o].append(row[o])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[o], types[o]) for o in outputs)], [key, *outputs])

    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "spans": "array<array<long>>", "kept": "binary", "kept_sha256": "string"}
    return docs.join(cuts, "row", "left").select("key", "text", "cuts").mapInArrow(keep, f"{key} long, " + ", ".join(f"{o} {kinds[o]}" for o in outputs))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that stand anywhere else."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"))


QUERIES = {"op6_suffix_array": op6_suffix_array}
