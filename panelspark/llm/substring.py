"""Repeated passages of words, by a compressed FM-index for each shard.

Segments that may repeat are routed to shards (see routing). A segment that has its minimiser to itself is settled: its smallest
document owns its windows. A shard's other distinct segments form one sequence of word numbers;
its index is the Burrows-Wheeler transform in a wavelet matrix of packed bits, with counts of smaller words. Segments
stream through it: backward search gives for each place the longest match, up to the threshold, with the interval of
suffixes that share it (matching statistics). Intervals of matches at the threshold tell the smallest document that
owns the window. A window goes from every document but that one, so one copy of each passage stays.

The suffixes are sorted by the threshold's words alone, which is exact for matches up to that length.

Defined results: null, empty and wordless texts have no words; words are never changed; a text shorter than a window
loses nothing; rows that repeat a key count as one document each and never remove each other's words; a null key comes
after all others (as the largest long does), so such rows lose what a key holds, and nothing to each other; an empty table gives an empty
result; only the key and the outputs are returned, so clashing columns of the input do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import routing
from panelspark.llm.common import materialize, prefix_hash, span_hash, steps, text_bytes, words

WINDOW, GRAM, LONG_GRAM = 13, 5, 10
#: Bytes of a word with its space, about.
WORD_BYTES = 6


def word_units(raw: np.ndarray, off: np.ndarray):
    start, end, first = words(raw, off)
    data = raw.tobytes()
    return span_hash(prefix_hash(raw), start, end), first, lambda a, b: b" ".join(data[start[a] : end[b - 1]].split())


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector with running counts for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        s = symbols.astype(np.int64)
        for b in range(bits - 1, -1, -1):
            bit = (s >> b & 1).astype(bool)
            padded = np.zeros((len(s) // 64 + 1) * 64, np.uint8)
            padded[: len(s)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed)[:-1], out=before[1:])
            self.levels.append((b, packed, before, int(len(s) - bit.sum())))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, at = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for b, packed, before, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            for which in (0, 1):
                x = lo if which == 0 else at
                word = x >> 6
                ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)))
                x = np.where(one, zeros + ones, x - ones)
                lo, at = (x, at) if which == 0 else (lo, x)
        return at - lo


class FmIndex:
    """Index of a sequence of symbols 1.. with 0 between texts, for matches of up to `depth` symbols."""

    def __init__(self, sequence: np.ndarray, depth: int):
        self.depth, n = depth, len(sequence)
        bits = max(1, int(sequence.max()).bit_length())
        rank, width = sequence.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            ahead = np.zeros(n, np.int64)
            ahead[: n - width] = rank[width:] + 1 if n > width else 0
            key = rank * (n + 2 + int(rank.max() if width == 1 else 0)) + ahead
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            width *= 2
        self.suffixes = order
        lcp = np.zeros(n, np.int64)
        same = np.ones(n, bool)
        same[0] = False
        for k in range(depth):
            a, b = order + k, np.roll(order, 1) + k
            ok = (a < n) & (b < n)
            same &= ok & (sequence[np.minimum(a, n - 1)] == sequence[np.minimum(b, n - 1)]) & (sequence[np.minimum(a, n - 1)] > 0)
            lcp += same
        self.lcp = lcp
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=1 << bits))])
        self.bwt = WaveletMatrix(sequence[order - 1], bits)
        self._groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def group(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix the interval of those that share its first `depth` symbols."""
        if depth not in self._groups:
            n, cut = len(self.lcp), self.lcp < depth
            at = np.arange(n)
            lo = np.maximum.accumulate(np.where(cut, at, 0))
            nxt = np.append(np.where(cut, at, n)[1:], n)
            self._groups[depth] = lo, np.minimum.accumulate(nxt[::-1])[::-1]
        return self._groups[depth]

    def matching_statistics(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place from the right of all texts at once: text, place, length of the longest match (up to depth) and the start of its interval."""
        size = np.array([len(t) for t in texts])
        flat, base = np.concatenate(texts), np.cumsum(size) - size
        n = len(self.lcp)
        lo, hi, length = np.zeros(len(texts), np.int64), np.full(len(texts), n), np.zeros(len(texts), np.int64)
        for back in range(int(size.max())):
            live = np.flatnonzero(size > back)
            c = flat[base[live] + size[live] - 1 - back]
            # a match at full depth gives up its last symbol before it can grow at its first
            full = live[length[live] == self.depth]
            if len(full):
                g_lo, g_hi = self.group(self.depth - 1)
                hi[full], lo[full] = g_hi[lo[full]], g_lo[lo[full]]
                length[full] -= 1
            todo = np.arange(len(live))
            while len(todo):
                i = live[todo]
                new_lo = self.smaller[c[todo]] + self.bwt.rank(c[todo], lo[i])
                new_hi = self.smaller[c[todo]] + self.bwt.rank(c[todo], hi[i])
                grown = new_hi > new_lo
                j = i[grown]
                lo[j], hi[j] = new_lo[grown], new_hi[grown]
                length[j] += 1
                i, todo = i[~grown], todo[~grown]
                none = length[i] == 0
                lo[i[none]], hi[i[none]] = 0, n
                i, todo = i[~none], todo[~none]
                for d in np.unique(length[i]):
                    g_lo, g_hi = self.group(int(d) - 1)
                    k = i[length[i] == d]
                    hi[k], lo[k] = g_hi[lo[k]], g_lo[lo[k]]
                length[i] -= 1
            yield live, size[live] - 1 - back, length[live].copy(), lo[live].copy()


def search_shard(window: int):
    """The search of one shard: runs of windows of each segment with the smallest document that owns them."""

    def run(t: pa.Table) -> pa.Table:
        m = routing.merged(t)
        settled = np.flatnonzero(m.alone & (m.times > 1))
        whole = m.spans(settled, np.zeros(len(settled)), m.windows[settled], m.owner[settled])
        among = np.flatnonzero(~m.alone)
        if not len(among):
            return whole
        bodies, count, owner = m.bodies(among), m.windows[among], m.owner[among]
        number: dict[bytes, int] = {}
        texts = [np.array([number.setdefault(w, len(number) + 1) for w in b.split(b" ")], np.int64) for b in bodies]
        sequence = np.concatenate([x for s in texts for x in (s, np.zeros(1, np.int64))])
        index = FmIndex(sequence, window)
        owner_at = np.repeat(owner, [len(s) + 1 for s in texts])
        lo, _ = index.group(window)
        starts = np.flatnonzero(lo == np.arange(len(lo)))
        least = np.zeros(len(lo), np.int64)
        least[starts] = np.minimum.reduceat(owner_at[index.suffixes], starts)
        base = np.cumsum(count) - count
        smallest = np.empty(int(count.sum()), np.int64)
        for text, place, length, at in index.matching_statistics(texts):
            ok = length == window
            smallest[base[text[ok]] + place[ok]] = least[lo[at[ok]]]
        seg = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(seg), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (smallest[1:] != smallest[:-1])
        i = np.flatnonzero(new)
        j = np.append(i[1:], len(seg))
        return pa.concat_tables([whole, m.spans(among[seg[i]], i - base[seg[i]], j - base[seg[i]], smallest[i])])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, long_gram: int = LONG_GRAM) -> DataFrame:
    """(row, cuts) of the texts that hold a window which a smaller id also holds. docs: (id, text, row)."""
    plain = docs.select("id", "text")
    p = routing.plan(plain, word_units, window, gram, long_gram, unit_bytes=WORD_BYTES)
    segments = routing.distinct_segments(plain, word_units, p)
    found = materialize(segments.groupBy("shard").applyInArrow(search_shard(window), routing.SPANS), "found")
    return routing.removed(found, routing.occurrences(docs.select("id", "text", "row"), word_units, p), smaller_owner=True)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept")) -> DataFrame:
    """Every text without the words of windows that a smaller key also holds.

    outputs: of n_words, n_removed, kept (words joined by one space) and kept_sha256.
    """
    docs = routing.rows_of(df, key, text)
    cuts = repeated_windows(docs, window, min(GRAM, window), min(LONG_GRAM, window))
    types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string(), "kept_sha256": pa.string()}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            cols: dict[str, list] = {o: [] for o in outputs}
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = (t or "").encode().split()
                kept = w
                if c.is_valid:
                    gone = covered_words(len(w), c.values.to_numpy(), window)
                    kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                row = {"n_words": len(w), "n_removed": len(w) - len(kept), "kept": joined, "kept_sha256": hashlib.sha256(joined).hexdigest()}
                for o in outputs:
                    cols[o].append(row[o].decode() if o == "kept" else row[o])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[o], types[o]) for o in outputs)], [key, *outputs])

    kinds = {"n_words": "long", "n_removed": "long", "kept": "string", "kept_sha256": "string"}
    return docs.join(cuts, "row", "left").select("key", "text", "cuts").mapInArrow(keep, f"{key} long, " + ", ".join(f"{o} {kinds[o]}" for o in outputs))


covered_words = routing.covered


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that an earlier one holds."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("n_words", "n_removed", "kept_sha256"))


QUERIES = {"op5_substring": op5_substring}
