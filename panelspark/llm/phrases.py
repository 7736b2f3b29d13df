"""Collocations by weighted acyclic automata: counts of all phrases of up to MOST words, and the association of their parts.

A word's label is a hash of its language and bytes, so all languages go through one pass and never mix. Words are counted first, then pairs of frequent
words, then phrases of three and four words within runs of frequent pairs: a phrase is never more frequent than a part. Each time a
shard sorts its sequences, cuts them at prefix ranges and builds one count transducer for each range; a range's task takes the shards'
transducers one by one, sums weights, and builds the range's own transducer of the frequent sequences. A range is a
hash of the first three words, so a frequent word or pair is spread over all ranges, and three-word counts are sums over a prefix. Parts of
candidates are looked up by composing them with the transducers of their ranges.

What is frequent is told to the next pass by a bitmap of at most 8 MB; what it lets through besides is counted and
dropped. Two words with one label would be counted as one: labels are drawn again with another seed until no two words share
one. Working memory of a range's task is its distinct sequences; there are RANGES of them, by the number of words.

Defined results: null lang is `und`; null and wordless texts have no phrase; equal scores rank by frequency and then by the phrase's bytes; rows
count whatever their keys, so repeated rows count again; an empty table gives an empty result; only the named columns are read, so
extra ones that clash do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import LOWER, has_bit, hash_bits, materialize, mix, prefix_hash, span_hash, steps, strings, text_bytes, words
from panelspark.llm.transducer import Transducer, summed

#: Words of a phrase at most, and of the prefix that makes its range.
MOST, PREFIX = 4, 3
LEAST_COUNT, TOP = 30, 2000
#: Sequences that a shard sorts at once, and that a range's task holds before it sums.
FLUSH = 1 << 20
#: Bytes of transducers that leave a shard at once.
BATCH_BYTES = 1 << 22
#: Words of the corpus for each range, and least and most ranges.
RANGE_WORDS, RANGES = 1 << 20, (64, 1 << 16)

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _SEPARATOR.copy()
_GAP[[0x20, 0x09]] = True


def labelled(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (lang, text): lower-cased bytes, starts, ends and labels of words, their rows, and whether each stands in one piece with the next."""
    raw, off = text_bytes(batch.column(1))
    raw = LOWER[raw]
    start, end, first = words(raw, off, _GAP)
    row = np.repeat(np.arange(len(batch)), np.diff(first))
    name, at = text_bytes(batch.column(0))
    lang = span_hash(prefix_hash(name), at[:-1], at[1:])
    label = mix(span_hash(prefix_hash(raw), start, end) ^ mix(lang + np.uint64(seed))[row])
    label[label == 0] = 1
    breaks = np.cumsum(_SEPARATOR[raw])
    joined = np.zeros(len(start), bool)
    if len(start) > 1:
        joined[:-1] = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[end[:-1] - 1])
    return raw, start, end, label, row, joined


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a ^ mix(b + np.uint64(0x2545F4914F6CDD1D)))


def ranges_of(paths: np.ndarray, ranges: int) -> np.ndarray:
    """The prefix range of each row of labels."""
    h = np.zeros(len(paths), np.uint64)
    for k in range(min(PREFIX, paths.shape[1])):
        h = np.where(paths[:, k] != 0, mix(h ^ paths[:, k]), h)
    return (h % np.uint64(ranges)).astype(np.int32)


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """(label, lang, word, f) of every word of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            raw, start, end, label, row, _ = labelled(batch, seed)
            own, at, n = np.unique(label, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), batch.column(0).take(pa.array(row[at])), strings(raw, start[at], end[at]), pa.array(n)], ["label", "lang", "word", "f"])

    return docs.mapInArrow(run, "label long, lang string, word string, f long").groupBy("label", "lang", "word").agg(F.sum("f").alias("f"))


def shard_transducers(docs: DataFrame, sequences: Callable[[np.ndarray, np.ndarray], np.ndarray], seed: int, ranges: int) -> DataFrame:
    """(range, fst) for each flush of each task: the count transducer of its sequences in the range. sequences: rows of labels from labels and joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            paths = np.concatenate(held)
            own = ranges_of(paths, ranges)
            order = np.argsort(own, kind="stable")
            paths, own = paths[order], own[order]
            cut = np.searchsorted(own, np.arange(ranges + 1))
            rows, full = [], 0
            for r, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if j > i:
                    rows.append((r, Transducer.build(*summed(paths[i:j], np.ones(j - i, np.int64))).pack()))
                    full += len(rows[-1][1])
                if rows and (full >= BATCH_BYTES or r == ranges - 1):
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["range", "fst"])
                    rows, full = [], 0

        held, size = [], 0
        for batch in steps(batches):
            _, _, _, label, _, joined = labelled(batch, seed)
            held.append(sequences(label, joined))
            size += len(held[-1])
            if size >= FLUSH:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return docs.mapInArrow(run, "range int, fst binary")


def union(shards: DataFrame, least: int) -> DataFrame:
    """(range, fst): one transducer a range with the summed weights that reach `least`; also of each PREFIX words, as sums over what begins with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, weight, held, size, own = None, None, [], 0, None

        def fold():
            more = held if paths is None else [(paths, weight), *held]
            return summed(np.concatenate([p for p, _ in more]), np.concatenate([w for _, w in more]))

        for batch in batches:
            own = own or batch.column(0)[0].as_py()
            for body in batch.column(1):
                held.append(Transducer.unpack(body.as_py()).paths())
                size += len(held[-1][1])
                if size >= max(FLUSH, 0 if paths is None else len(paths)):
                    paths, weight = fold()
                    held, size = [], 0
        paths, weight = fold()
        if paths.shape[1] > PREFIX:
            short = paths.copy()
            short[:, PREFIX:] = 0
            short, sums = summed(short, weight)
            full = (paths[:, PREFIX] != 0).nonzero()[0]
            paths, weight = summed(np.concatenate([short, paths[full]]), np.concatenate([sums, weight[full]]))
        keep = weight >= least
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([Transducer.build(paths[keep], weight[keep]).pack()], pa.binary())], ["range", "fst"])

    return shards.groupBy("range").applyInArrow(run, "range int, fst binary")


def _listed(paths: np.ndarray) -> pa.Array:
    """Rows of labels as lists without their zeros."""
    n = (paths != 0).sum(axis=1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(paths[paths != 0].view(np.int64)))


def accepted(fsts: DataFrame) -> DataFrame:
    """(labels, f) of the sequences of transducers (range, fst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1):
                paths, weight = Transducer.unpack(body.as_py()).paths()
                yield pa.RecordBatch.from_arrays([_listed(paths), pa.array(weight)], ["labels", "f"])

    return fsts.select("range", "fst").mapInArrow(run, "labels array<long>, f long")


def _rows(labels: pa.ChunkedArray | pa.Array, width: int = MOST) -> np.ndarray:
    labels = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    n = np.diff(labels.offsets.to_numpy())
    out = np.zeros((len(labels), width), np.uint64)
    out[np.arange(width) < n[:, None]] = labels.flatten().to_numpy().view(np.uint64)
    return out


def looked_up(asked: DataFrame, fsts: DataFrame, ranges: int) -> DataFrame:
    """(labels, f) of distinct sequences `labels`: composed with the transducers of their ranges."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ranges_of(_rows(batch.column(0)), ranges)), batch.column(0)], ["range", "labels"])

    def meet(own: pa.Table, there: pa.Table) -> pa.Table:
        rows = _rows(own.column("labels")) if len(own) else np.zeros((0, MOST), np.uint64)
        f = np.zeros(len(rows), np.int64)
        for body in there.column("fst").to_pylist():
            f += Transducer.unpack(body).compose(rows)
        return pa.table({"labels": own.column("labels"), "f": pa.array(f)})

    placed_rows = asked.select("labels").mapInArrow(placed, "range int, labels array<long>")
    return placed_rows.groupBy("range").cogroup(fsts.groupBy("range")).applyInArrow(meet, "labels array<long>, f long")


def word_transducers(frequent: DataFrame, ranges: int) -> DataFrame:
    """(range, fst) of (label, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, weight = summed(batch.column(0).to_numpy().view(np.uint64)[:, None], batch.column(1).to_numpy())
            own = ranges_of(paths, ranges)
            for r in np.unique(own).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([Transducer.build(paths[own == r], weight[own == r]).pack()], pa.binary())], ["range", "fst"])

    return frequent.select("label", "f").mapInArrow(run, "range int, fst binary")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by the association of their worst cut."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    for seed in range(64):
        known = materialize(counted_words(docs, seed), "words")
        if known.groupBy("label").count().where("count > 1").isEmpty():
            break
    totals = known.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = known.where(F.col("f") >= least)
    ranges = min(max(RANGES[0], (known.agg(F.sum("f")).first()[0] or 0) // RANGE_WORDS), RANGES[1])
    broadcast = docs.sparkSession.sparkContext.broadcast
    common = broadcast(hash_bits(frequent.select(F.col("label").alias("hash"))))

    def pairs(label: np.ndarray, joined: np.ndarray) -> np.ndarray:
        known = has_bit(common.value, label)
        at = np.flatnonzero(joined[:-1] & known[:-1] & known[1:]) if len(label) else np.zeros(0, np.int64)
        return np.stack([label[at], label[at + 1]], axis=1) if len(at) else np.zeros((0, 2), np.uint64)

    two = materialize(union(shard_transducers(docs, pairs, seed, ranges), least), "pairs")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                paths, _ = Transducer.unpack(body.as_py()).paths()
                yield pa.RecordBatch.from_arrays([pa.array(pair_hash(paths[:, 0], paths[:, 1]).view(np.int64))], ["hash"])

    linked = broadcast(hash_bits(two.select("fst").mapInArrow(hashed, "hash long")))

    def longer(label: np.ndarray, joined: np.ndarray) -> np.ndarray:
        link = np.zeros(len(label) + MOST, bool)
        at = np.flatnonzero(joined)
        link[at] = has_bit(linked.value, pair_hash(label[at], label[at + 1]))
        at = np.flatnonzero(link[:-1] & link[1:])
        out = np.zeros((len(at), MOST), np.uint64)
        for k in range(PREFIX):
            out[:, k] = label[at + k]
        more = link[at + 2]
        out[more, 3] = label[at[more] + 3]
        return out

    many = materialize(union(shard_transducers(docs, longer, seed, ranges), least), "phrases")
    found = materialize(accepted(two.unionAll(many)).withColumnRenamed("f", "a"), "candidates")
    cut = found.withColumn("k", F.explode(F.expr("sequence(1, size(labels) - 1)")))
    cut = cut.select("labels", "a", "k", F.expr("slice(labels, 1, k)").alias("left"), F.expr("slice(labels, k + 1, size(labels) - k)").alias("right"))
    asked = cut.select(F.explode(F.array("left", "right")).alias("labels")).distinct()
    part = materialize(looked_up(asked, word_transducers(frequent, ranges).unionAll(two).unionAll(many), ranges), "parts")
    cut = cut.join(part.select(F.col("labels").alias("left"), F.col("f").alias("l")), "left").join(part.select(F.col("labels").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(20,0)) + r) AS LONG)")
    worst = cut.groupBy("labels").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("x")).select("labels", "x.score", "x.a", "x.l", "x.r")
    # the most frequent longer phrase around each shorter one
    inner = found.where("size(labels) > 2").withColumn("n", F.explode(F.expr("sequence(2, size(labels) - 1)"))).withColumn("b", F.explode(F.expr("sequence(1, size(labels) - n + 1)")))
    inner = inner.groupBy(F.expr("slice(labels, b, n)").alias("labels")).agg(F.max("a").alias("around"))
    kept = worst.join(inner, "labels", "left").where("around IS NULL OR CAST(around AS DECIMAL(19,0)) * 100 < CAST(a AS DECIMAL(19,0)) * 80").drop("around")
    names = frequent.select("label", F.col("lang"), "word")
    kept = kept.join(names.select(F.col("label").alias("head"), "lang"), F.col("labels")[0] == F.col("head")).drop("head")
    # those that can be in the list, before their words are written out
    near = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    kept = kept.withColumn("near", near).where(F.col("near") <= top).drop("near")
    each = kept.select("*", F.posexplode("labels").alias("pos", "label")).join(names.drop("lang"), "label")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")
    listed = each.groupBy("lang", "labels", "score", "a", "l", "r").agg(phrase)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest collocations of each language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""WITH pc AS (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
ws AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pc),
wd AS (SELECT pid, lang, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM ws),
nx AS (SELECT lang, x, lead(x, 1) OVER p AS x2, lead(x, 2) OVER p AS x3, lead(x, 3) OVER p AS x4 FROM wd WINDOW p AS (PARTITION BY pid ORDER BY pos)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM nx UNION ALL SELECT lang, 2, x || ' ' || x2 FROM nx UNION ALL SELECT lang, 3, x || ' ' || x2 || ' ' || x3 FROM nx UNION ALL SELECT lang, 4, x || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM nx),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g WHERE phrase IS NOT NULL GROUP BY lang, k, phrase),
nn AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST_COUNT}),
each AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS i FROM c),
cut AS MATERIALIZED (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS x, array_to_string(w[i + 1:], ' ') AS y FROM each),
sc AS (SELECT cut.*, lf.f AS l, rf.f AS r, CAST((2000000::HUGEINT * a) // (lf.f + rf.f) AS BIGINT) AS score FROM cut JOIN f lf ON lf.lang = cut.lang AND lf.phrase = x JOIN f rf ON rf.lang = cut.lang AND rf.phrase = y),
worst AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) AS o FROM sc) WHERE o = 1),
longer AS (SELECT lang, a, k, w, unnest(range(2, k)) AS m FROM c WHERE k > 2),
inside AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS b FROM longer),
inn AS (SELECT lang, array_to_string(w[b : b + m - 1], ' ') AS phrase, max(a) AS around FROM inside GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN inn USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN nn USING (lang) WHERE rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": SQL}
