"""Near-duplicate documents by HyperMinHash.

Each distinct shingle of a document falls into one of REGISTERS buckets by its hash; a bucket keeps the smallest
remaining hash as the number of its leading zeros and MANTISSA more bits: 16 bits. Bands of ROWS registers make buckets of
candidates; documents with equal shingle sets count as one class throughout. In a bucket every member is compared with
the most connected one, not with all others. What that leaves in another component than the bucket's largest one is then
held against the bucket's members; members of the largest component are never held against each other, and tasks give back links between
components, not pairs. A member asks only others of sizes that it can be similar to: shingles that no other such member has are lost to any
similarity, which leaves a narrow range of sizes, mostly none for texts that are each edited in their own way. Who asks and who is asked are both
cut into blocks, so a task holds two blocks whatever the bucket. A candidate pair first needs an estimated Jaccard similarity, corrected for chance collisions of
compressed registers, near the threshold, and then the exact similarity of the full sets.

At similarity 0.8 a pair shares no band with probability 3e-6.

Defined results: null, empty and wordless texts have 0 shingles and link with nothing; a text of fewer words than a shingle is
one shingle; equal texts are one class and share a component; rows that repeat a key keep one row each and are judged
each by its own text; a row whose key is null takes part like others but names no component: its component is the
smallest key reachable, or null (and then it is kept) if it reaches none; an empty table
gives an empty result; only the key and the outputs are returned, so clashing columns of the input do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import LOWER, NO_KEY, has_bit, hash_bits, lean, materialize, mix, prefix_hash, span_hash, steps, text_bytes, within, words
from panelspark.llm.graph import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
#: Standard deviations below the threshold at which an estimate still lets a pair through to the exact test.
SLACK = 5.0
#: Members of a bucket that ask, and that are asked, in one task at most, about.
BLOCK = 1024
#: Bytes of text that are cut into shingles at a time: each byte takes about 50 of a worker's memory meanwhile.
SHINGLE_BYTES = 1 << 20
#: Taken off the threshold where sets are of 32-bit hashes, which may collide; whole hashes decide afterwards.
MARGIN = 0.01


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row end to end, and how many each row has."""
    start, end, first = words(raw, off)
    n_words = np.diff(first)
    h = span_hash(prefix_hash(LOWER[raw]), start, end)
    prefix = prefix_hash(h)
    count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    row = np.repeat(np.arange(len(count)), count)
    at = np.repeat(first[:-1], count) + within(count)
    s = span_hash(prefix, at, at + np.minimum(size, n_words)[row])
    order = np.argsort(s, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[new], np.bincount(row[new], minlength=len(count))


def registers(sets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each row: leading zeros << MANTISSA | the bits after the first one; EMPTY where none fell."""
    h = mix(sets ^ np.uint64(0xA24BAED4963EE407))
    row = np.repeat(np.arange(len(count)), count)
    slot = row * REGISTERS + ((h >> np.uint64(40)) % np.uint64(REGISTERS)).astype(np.int64)
    low = np.full(len(count) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    rest = h & np.uint64((1 << 40) - 1)
    np.minimum.at(low, slot, rest)
    used = low != np.iinfo(np.uint64).max
    v = low[used]
    zeros = np.zeros(len(v), np.uint64)
    top = np.log2(np.maximum(v, 1).astype(np.float64)).astype(np.int64)  # 40 bits are exact in a double
    zeros = np.where(v > 0, 39 - top, 40).astype(np.uint64)
    keep = np.uint64(MANTISSA)
    shift = np.maximum(top - MANTISSA, 0).astype(np.uint64)
    mantissa = (v >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = np.full(len(low), EMPTY, np.uint16)
    out[used] = (zeros << keep | mantissa).astype(np.uint16)
    return out.reshape(len(count), REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of register rows: equal registers over those not both empty, less the collisions expected of unequal sets."""
    both = (a != EMPTY) & (b != EMPTY)
    some = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    same = ((a == b) & both).sum(axis=1) / some
    # two unequal minima of n values each agree in zeros with chance 1/3 at most, and then in the mantissa bits
    chance = (both.sum(axis=1) / some) / 3 / (1 << MANTISSA)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def tolerance(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    some = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
    return SLACK * np.sqrt(threshold * (1 - threshold) / some)


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """id, text_hash, n_shingles, h1 and h2 (two independent sums over the set), bands (hashes of the non-empty ones) and registers of each (id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=SHINGLE_BYTES):
            sets, count = shingle_sets(*text_bytes(batch.column(2)), shingle)
            reg = registers(sets, count)
            at = np.concatenate([[0], np.cumsum(count)])
            sums = []
            for salt in (0x1B873593, 0xCC9E2D51):
                c = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(mix(sets + np.uint64(salt)), out=c[1:])
                sums.append(c[at[1:]] - c[at[:-1]])
            banded = reg.reshape(len(count), BANDS, ROWS)
            h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(count), BANDS))
            for r in range(ROWS):
                h = mix(h * np.uint64(0x100000001B3) + banded[:, :, r])
            used = (banded != EMPTY).any(axis=2)
            flat = pa.array(h[used].view(np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]).astype(np.int32)), flat)
            binary = pa.array([r.tobytes() for r in reg], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), bands, binary], ["id", "text_hash", "n_shingles", "h1", "h2", "bands", "registers"])

    return docs.select("id", "text_hash", "text").mapInArrow(lean(run), "id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, registers binary")


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), REGISTERS)


def estimated(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, ra, rb, na, nb) whose estimate is near the threshold or above, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ra, rb = _matrix(batch.column(2)), _matrix(batch.column(3))
                ok = estimate(ra, rb) >= threshold - tolerance(ra, rb, threshold)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "ra", "rb").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) with exact similarity of at least the threshold. texts: (id, text) of all that occur in them."""
    both = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .select("a", "b", "ta", "tb")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "tb", SHINGLE_BYTES):
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                # the left text once for each run of rows that share it
                left = part.column(0).to_numpy()
                new = np.ones(len(left), bool)
                new[1:] = left[1:] != left[:-1]
                a, ca = shingle_sets(*text_bytes(part.column(2).take(pa.array(np.flatnonzero(new)))), shingle)
                b, cb = shingle_sets(*text_bytes(part.column(3)), shingle)
                which = np.cumsum(new) - 1
                at = np.cumsum(ca) - ca
                row = np.repeat(np.arange(len(cb)), ca[which])
                a = a[np.repeat(at[which], ca[which]) + within(ca[which])]
                v = np.concatenate([a, b])
                r = np.concatenate([row, np.repeat(np.arange(len(cb)), cb)])
                order = np.lexsort((v, r))
                v, r = v[order], r[order]
                shared = np.bincount(r[1:][(v[1:] == v[:-1]) & (r[1:] == r[:-1])], minlength=len(cb))
                joint = ca[which] + cb - shared
                # 100 * shared >= 80 * joint in whole numbers, for a threshold of 0.8
                ok = (100 * shared >= round(100 * threshold) * joint) & (joint > 0)
                yield part.select(["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(lean(run), "a long, b long")


def compact_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of (id, text): the shingle set as sorted 32-bit hashes, bytes of an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, size=SHINGLE_BYTES):
            sets, count = shingle_sets(*text_bytes(batch.column(1)), shingle)
            at = np.concatenate([[0], np.cumsum(count)])
            cut = [np.sort((sets[i:j] >> np.uint64(32)).astype(np.uint32)).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], ["id", "set"])

    return texts.select("id", "text").mapInArrow(lean(run), "id long, set binary")


def supported(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, set, size, most): the size of each set, and the largest size of a set that it can reach the threshold with.

    A shingle of one set alone is in no intersection. With c others, similarity to a set of s shingles is at most c / (size + s - c). Which shingles
    occur twice is told by a bitmap of at most 8 MB; what it lets through besides only makes the bound weaker.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(mix(np.frombuffer(s.as_py(), np.uint32).astype(np.uint64)).view(np.int64))], ["hash"])

    twice = sets.mapInArrow(lean(each), "hash long").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    known = sets.sparkSession.sparkContext.broadcast(hash_bits(twice.select("hash")))
    t = threshold - MARGIN

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, most = [], []
            for s in batch.column(1):
                h = np.frombuffer(s.as_py(), np.uint32)
                shared = int(has_bit(known.value, mix(h.astype(np.uint64))).sum())
                size.append(len(h))
                most.append(int(shared * (1 + t) / t - len(h)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), pa.array(most, pa.int64())], ["id", "set", "size", "most"])

    return sets.select("id", "set").mapInArrow(lean(bound), "id long, set binary, size long, most long")


def sizes_that_fit(size: int, most: int, sizes: np.ndarray, threshold: float) -> slice:
    """Where sets of ascending `sizes` are that a set of this size, and bound, can reach the threshold with."""
    return slice(int(np.searchsorted(sizes, (threshold - MARGIN) * size, "left")), int(np.searchsorted(sizes, min(most, size / (threshold - MARGIN)), "right")))


def links_in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components within each bucket. members: (bucket, id, component, asks, registers, set, size, most).

    asks: whether a member is outside the bucket's largest component. Those that ask, and all members, are each cut into blocks of about BLOCK by a
    hash of the id, and each two blocks meet in a task. A member asks no more if even the bucket's smallest set is too large for it. Pairs are held
    against the estimate and then against their sets; what leaves a task is one link for each two components that it joins.
    """
    least = members.groupBy("bucket").agg(F.min("size").alias("least"))
    members = members.join(least, "bucket").withColumn("asks", F.col("asks") & (F.col("most") >= F.col("least"))).drop("least")
    crowd = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nd"), F.ceil(F.count_if("asks") / BLOCK).cast("int").alias("nq")).where("nq > 0")
    m = members.join(crowd, "bucket")
    row = ("id", "component", "asks", "registers", "set", "size", "most")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = m.select("bucket", block("nd").alias("d"), every("nq").alias("q"), *row, F.lit(False).alias("query"))
    asking = m.where("asks").select("bucket", every("nd").alias("d"), block("nq").alias("q"), *row, F.lit(True).alias("query"))

    def meet(t: pa.Table) -> pa.Table:
        ids, comp, reg = t.column("id").to_numpy(), t.column("component").to_numpy(), _matrix(t.column("registers"))
        size, most = t.column("size").to_numpy(), t.column("most").to_numpy()
        asks, query = (np.asarray(t.column(c)) for c in ("asks", "query"))
        sets = [np.frombuffer(s, np.uint32) for s in t.column("set").to_pylist()]
        data = np.flatnonzero(~query)
        data = data[np.argsort(size[data], kind="stable")]
        sizes = size[data]
        group = np.unique(comp, return_inverse=True)[1]  # relabelled as components are joined
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(query).tolist():
            j = data[sizes_that_fit(size[i], most[i], sizes, threshold)]
            # of two that both ask, the one with the smaller id does
            j = j[(group[j] != group[i]) & (most[j] >= size[i]) & (~asks[j] | (ids[j] > ids[i]))]
            if len(j):
                ra = np.broadcast_to(reg[i], (len(j), REGISTERS))
                j = j[estimate(ra, reg[j]) >= threshold - tolerance(ra, reg[j], threshold)]
            for k in j.tolist():
                if group[k] == group[i]:
                    continue
                shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                joint = size[i] + size[k] - shared
                if shared >= (threshold - MARGIN) * joint:  # the exact test follows on whole hashes
                    out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                    if shared >= (threshold + MARGIN) * joint:
                        group[group == group[k]] = group[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return there.unionAll(asking).groupBy("bucket", "d", "q").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each document: components of links with Jaccard similarity of at least the threshold."""
    return judged(docs, key, text, shingle, threshold).drop("text_hash", "first")


def without_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each component: the one of the smallest key, and among its rows of that key the one of the smallest text hash.

    Rows are judged each by its own text, null keys too; of rows equal in key and text one stays, the first by the other columns.
    """
    own = docs.withColumns({"__id": F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)), "__hash": F.xxhash64(text)})
    gone = judged(docs, key, text, shingle, threshold).where("not first").select(F.coalesce(F.col(key), F.lit(NO_KEY)).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    left = own.join(gone, ["__id", "__hash"], "left_anti")
    others = [c for c in docs.columns if c not in (key, text)]
    place = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy(F.xxhash64(*others) if others else F.lit(0)))
    return left.withColumn("__place", place).where("__place = 1").select(*docs.columns)


def judged(docs: DataFrame, key: str, text: str, shingle: int, threshold: float) -> DataFrame:
    """near_duplicates with text_hash, and first: whether the rows of this key and text stand for their component."""
    # a row is told by its key and a hash of its text: rows that share a key may differ in text
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    sig = materialize(sketch(docs, shingle), "sketches")
    first = sig.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("id", "text_hash")).alias("x"))
    # numbers of classes are drawn once and written, so every later reader sees the same
    classes = materialize(first.select(F.monotonically_increasing_id().alias("class"), "h1", "h2", "n_shingles", "x.id", "x.text_hash"), "classes")
    reps = sig.join(classes, ["h1", "h2", "n_shingles", "id", "text_hash"]).select(F.col("class").alias("id"), "bands", "registers").dropDuplicates(["id"])
    reps = materialize(reps, "registers")
    placed = reps.select("id", F.explode("bands").alias("bucket"))
    crowd = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(placed.join(crowd, "bucket"), "shared")
    # the centre is the member that meets most others in all its buckets: of a family of edited copies, the one nearest to all
    popular = shared.groupBy("id").agg(F.sum("n").alias("met"))
    placed = shared.join(popular, "id")
    centres = placed.groupBy("bucket").agg(F.min(F.struct(-F.col("met"), F.col("id").alias("id")))["id"].alias("a"))
    members = materialize(placed.join(centres, "bucket").select("bucket", "n", "a", F.col("id").alias("b")), "buckets")
    reg = reps.select("id", "registers")

    def near(pairs: DataFrame) -> DataFrame:
        return estimated(
            pairs.join(reg.select(F.col("id").alias("b"), F.col("registers").alias("rb")), "b").join(reg.select(F.col("id").alias("a"), F.col("registers").alias("ra")), "a"),
            threshold,
        )

    candidates = materialize(near(members.where("a <> b").select("a", "b").distinct()), "candidates")  # one for each member and bucket at most
    involved = members.select(F.col("b").alias("class")).distinct().join(classes, "class").select("class", "id", "text_hash")
    texts = materialize(docs.join(involved, ["id", "text_hash"]).select(F.col("class").alias("id"), "text").dropDuplicates(["id"]), "texts")
    links = materialize(verified(candidates, texts, shingle, threshold), "linked")
    comp = materialize(components(links), "components")
    # what the centres did not bring together: members of a bucket that are still in different components
    known = members.join(comp.withColumnRenamed("node", "b"), "b", "left").select("bucket", "n", F.col("b").alias("id"), F.coalesce("component", "b").alias("component"))
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    apart = parts.groupBy("bucket").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.count("*").alias("k"), F.sum("m").alias("all")).where("k > 1 and all > 2").select("bucket", "largest")
    rest = materialize(known.join(apart, "bucket").select("bucket", "id", "component", (F.col("component") != F.col("largest")).alias("asks")), "apart")
    sets = materialize(compact_sets(texts.join(rest.select("id").distinct(), "id", "left_semi"), shingle), "sets")
    more = links_in_blocks(rest.join(reg.join(supported(sets, threshold), "id"), "id"), threshold)
    late = materialize(verified(materialize(more, "late_candidates"), texts, shingle, threshold), "late_links")
    if not late.isEmpty():
        comp = materialize(components(links.unionAll(late)), "components")
    reached = comp.withColumnRenamed("node", "class").join(classes.select("class", "id", "text_hash"), "class")
    smallest = reached.groupBy("component").agg(F.min(F.struct("id", "text_hash")).alias("smallest"))
    named = comp.join(smallest, "component").select(F.col("node").alias("class"), "smallest")
    of_class = classes.join(named, "class", "left").select("h1", "h2", "n_shingles", F.coalesce("smallest", F.struct("id", "text_hash")).alias("smallest"))
    key_of = lambda c: F.when(c != NO_KEY, c)
    return (
        sig.select("id", "text_hash", "n_shingles", "h1", "h2")
        .join(of_class, ["h1", "h2", "n_shingles"], "left")
        .withColumn("smallest", F.coalesce("smallest", F.struct("id", "text_hash")))
        .select(key_of(F.col("id")).alias(key), "n_shingles", key_of(F.col("smallest.id")).alias("component_id"), "text_hash", (F.struct("id", "text_hash") == F.col("smallest")).alias("first"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.col("component_id").isNull()))
    )


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2)


QUERIES = {"op9_minhash": op9_minhash}
