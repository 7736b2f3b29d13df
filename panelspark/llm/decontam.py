"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits in lower case. A benchmark item of w words is compared with every window of w words of
every document that shares at least one of its shingles (a window that shares none has similarity 0). Windows and items get 64-bit
SimHashes of their shingles, each counted as often as it occurs. The fingerprint is cut into BLOCKS blocks; two within RADIUS
bits differ by at most RADIUS // BLOCKS in some block, so each block has a table from its value to the groups of items near it, and a
window is held against the items of those groups alone. What is within RADIUS
is verified by the exact similarity of the weighted (counted) shingles: shared weight over joint weight.

Defined results: null, empty and wordless texts and items never match; an item with fewer words than a shingle counts as one
shingle; an item whose id is null is looked for and reported with a null id; repeated items and rows are each reported; of equally similar windows the first is reported; an empty table gives
an empty result; only the key and the outputs are returned, so clashing columns of the input do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import ALNUM, fold_case, lean, prefix_hash, span_hash, steps, text_bytes, words

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints within this many of 64 bits are verified: at similarity 0.8 about 10 are expected to differ.
RADIUS, BLOCKS = 23, 4
#: Groups that the items of one size fall into in a block's table: a bit each.
GROUPS = 8
#: Sizes of items in one index at most: each has tables of 256 KB.
INDEX_SIZES = 256
#: Numbers in one array at most while windows are compared.
CELLS = 1 << 20
#: Stands for a null item id.
NO_ID = (1 << 63) - 1
#: Bytes of benchmark text that one index holds; a larger benchmark is indexed in as many turns as it needs.
INDEX_BYTES = 32 << 20

def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each row's first word."""
    raw = fold_case(raw)
    start, end, first = words(raw, off, ~ALNUM)
    return span_hash(prefix_hash(raw), start, end), start, end, first


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, whatever the rows."""
    at = np.arange(max(0, len(hashes) - size + 1))
    return span_hash(prefix_hash(hashes), at, at + size)


def lane_bits(n: int) -> int:
    """Bits that hold a count up to n."""
    return 8 if n < 1 << 8 else 16 if n < 1 << 16 else 32


def lanes(shingles: np.ndarray, bits: int) -> list[np.ndarray]:
    """Prefix sums of the bits of each hash, 64 / bits to a word. Differences of them are exact counts below 2 ** bits."""
    mask = np.uint64(sum(1 << i for i in range(0, 64, bits)))
    out = []
    for k in range(bits):
        c = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum((shingles >> np.uint64(k)) & mask, out=c[1:])
        out.append(c)
    return out


def fingerprints(sums: list[np.ndarray], start: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each start: a bit is set if more than half of them set it."""
    bits = len(sums)
    out = np.zeros(len(start), np.uint64)
    for k, c in enumerate(sums):
        counts = (c[start + n] - c[start]).view({8: np.uint8, 16: np.uint16, 32: np.uint32}[bits]).reshape(len(start), -1)
        for lane in range(64 // bits):
            out |= (counts[:, lane].astype(np.int64) * 2 > n).astype(np.uint64) << np.uint64(bits * lane + k)
    return out


def block_of(prints: np.ndarray, b: int) -> np.ndarray:
    return (prints >> np.uint64(b * 64 // BLOCKS)) & np.uint64((1 << 64 // BLOCKS) - 1)


def counted(rows: np.ndarray) -> np.ndarray:
    """Each row of hashes sorted, with repeats told apart, so that weights become set members."""
    rows = np.sort(rows, axis=1)
    at = np.broadcast_to(np.arange(rows.shape[1]), rows.shape)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    nth = at - np.maximum.accumulate(np.where(new, at, 0), axis=1)
    return np.sort(rows ^ (nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), axis=1)


class Index:
    """Fingerprints of benchmark items by their number of words."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = SHINGLE, radius: int = RADIUS):
        self.radius = radius
        raw, off = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        hashes, _, _, first = word_hashes(raw, off)
        self.sizes: dict[int, tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(np.diff(first)):
            if n:
                by_size.setdefault(int(n), []).append(i)
        seeds: dict[int, list[np.ndarray]] = {}
        for w, rows in sorted(by_size.items()):
            k = min(shingle, w)
            n = w - k + 1
            start = first[np.array(rows)]
            s = shingle_hashes(hashes, k)
            own = s[start[:, None] + np.arange(n)]
            prints = fingerprints(lanes(s, lane_bits(n)), start, n)
            near = np.array(sorted(sum(1 << x for x in c) for d in range(radius // BLOCKS + 1) for c in combinations(range(64 // BLOCKS), d)), np.uint64)
            table = np.zeros((BLOCKS, 1 << 64 // BLOCKS), np.uint8)
            for b in range(BLOCKS):
                for i, value in enumerate(block_of(prints, b)):
                    table[b, value ^ near] |= 1 << i % GROUPS
            self.sizes[w] = (k, np.array([items[i][0] for i in rows]), prints, table, counted(own))
            seeds.setdefault(k, []).append(own.ravel())
        self.seeds = {k: np.unique(np.concatenate(v)) for k, v in seeds.items()}

    def _within(self, fp: np.ndarray, windows: np.ndarray, prints: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (window, item) whose fingerprints are within the radius."""
        step = max(1, CELLS // max(1, len(items)))
        for lo in range(0, len(windows), step):
            part = windows[lo : lo + step]
            r, c = np.nonzero(np.bitwise_count(fp[part, None] ^ prints[None, items]) <= self.radius)
            if len(r):
                yield part[r], items[c]

    def search(self, raw: np.ndarray, off: np.ndarray, similarity: float = SIMILARITY) -> dict[str, np.ndarray]:
        """For each row and item that match: row, item, similarity, first word, words. The best window of each pair."""
        hashes, _, _, first = word_hashes(raw, off)
        last = np.repeat(first[1:], np.diff(first))
        found: list[tuple[np.ndarray, ...]] = []
        for k, seeds in self.seeds.items():
            s = shingle_hashes(hashes, k)
            if not len(s) or not len(seeds):
                continue
            place = np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)
            hit = (seeds[place] == s) & (np.arange(len(s)) + k <= last[: len(s)])
            if not hit.any():
                continue
            hits = np.zeros(len(s) + 1, np.int64)
            np.cumsum(hit, out=hits[1:])
            sums: dict[int, list[np.ndarray]] = {}
            for w, (k_w, ids, prints, table, own) in self.sizes.items():
                n = w - k_w + 1
                if k_w != k or len(s) < n:
                    continue
                inside = np.arange(len(s) - n + 1) + w <= last[: len(s) - n + 1]
                start = np.flatnonzero(inside & (hits[n:] > hits[:-n]))
                if not len(start):
                    continue
                bits = lane_bits(n)
                if bits not in sums:
                    sums[bits] = lanes(s, bits)
                fp = fingerprints(sums[bits], start, n)
                groups = np.zeros(len(fp), np.uint8)
                for b in range(BLOCKS):
                    groups |= table[b, block_of(fp, b)]
                for g in range(min(GROUPS, len(prints))):
                    near = np.flatnonzero(groups >> g & 1)
                    items = np.arange(g, len(prints), GROUPS)
                    for at, c in self._within(fp, near, prints, items):
                        # as many pairs at once as their shingles allow
                        for lo in range(0, len(at), max(1, CELLS // n)):
                            i, j = start[at[lo : lo + max(1, CELLS // n)]], c[lo : lo + max(1, CELLS // n)]
                            both = np.sort(np.concatenate([counted(s[i[:, None] + np.arange(n)]), own[j]], axis=1), axis=1)
                            shared = (both[:, 1:] == both[:, :-1]).sum(axis=1)
                            sim = shared / (2 * n - shared)
                            ok = sim >= similarity
                            row = np.searchsorted(first, i[ok], "right") - 1
                            found.append((row, ids[j[ok]], sim[ok], i[ok] - first[row], np.full(ok.sum(), w), j[ok]))
        if not found:
            z = np.zeros(0, np.int64)
            return {"row": z, "item": z, "similarity": np.zeros(0), "start_word": z, "n_words": z}
        row, item, sim, at, size, nth = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, -sim, nth, size, item, row))
        row, item, sim, at, size, nth = (x[order] for x in (row, item, sim, at, size, nth))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (size[1:] != size[:-1]) | (nth[1:] != nth[:-1])
        return {"row": row[new], "item": item[new], "similarity": sim[new], "start_word": at[new], "n_words": size[new]}


def indexes(benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes over the whole benchmark, each over at most about `limit` bytes and INDEX_SIZES sizes of it, so that one can be broadcast."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long"), text)
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    turns = max(1, -(-total // limit))
    for turn in range(turns):
        part = items.where(F.pmod(F.xxhash64(item, text), F.lit(turns)) == turn) if turns > 1 else items
        rows = sorted((NO_ID if r[0] is None else r[0], r[1]) for r in part.collect())
        size = np.diff(word_hashes(*text_bytes(pa.array([t for _, t in rows], pa.large_string())))[3])
        sizes = np.unique(size)
        for lo in range(0, max(1, len(sizes)), INDEX_SIZES):
            own = set(sizes[lo : lo + INDEX_SIZES].tolist())
            yield Index([r for r, n in zip(rows, size.tolist(), strict=True) if n in own])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item that it holds: key, item_id, similarity, start_word, n_words."""
    out = None
    for index in indexes(benchmark):
        model = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                hit = model.value.search(*text_bytes(batch.column(1)), similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit["row"])), pa.array(hit["item"], pa.int64(), mask=hit["item"] == NO_ID), pa.array(hit["similarity"]), pa.array(hit["start_word"], pa.int64()), pa.array(hit["n_words"], pa.int64())], [key, "item_id", "similarity", "start_word", "n_words"])

        part = docs.select(docs[key].alias(key), docs[text].alias("text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, item_id long, similarity double, start_word long, n_words long")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns. Narrow: one pass for each index."""
    for index in indexes(benchmark):
        model = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, text):
                bad = model.value.search(*text_bytes(batch.column(batch.schema.get_field_index(text))), similarity)["row"]
                keep = np.ones(len(batch), bool)
                keep[bad] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the similarity and the place."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontamination": op4_decontamination}
