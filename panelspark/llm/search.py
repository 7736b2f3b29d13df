"""Ranked lexical search of a set of items by pipelined term partitioning.

The documents are indexed in blocks of at most BLOCK_DOCS; of each block, each term that some item asks for has one row with its
list: documents, occurrences and lengths. Every term has one owner; an owner is a stage of the pipeline. Bundles of items visit the owners in
turn, from the rarest terms to the commonest, and carry their accumulators, sparse sets of (document, score so far). A visit is a cogroup of
bundles and lists by (bundle, block), so the list of a frequent term is spread over its blocks, and no group is larger than
a block of documents times a bundle of items.

After each stage the tenth best score so far of an item is a bound that its result can't fall below. A document is dropped
when what it has and all that later owners can add at most stay below the bound; and where all that is left
stays below it, an owner opens no further accumulators. Both are exact: nothing that could rank is lost, ties included.

Which documents' words are kept for the lists is told by a bitmap of the items' term hashes, at most 8 MB whatever the number of items; what it
lets through besides falls out when lists meet the terms themselves.

Defined results: rows that share an item_id are one item with the terms of all; null texts have no terms; an item without
terms, or whose terms no document has, gets no rows; null doc_id and item_id are keys of their own, after all others; rows that
repeat a doc_id are documents of their own; equal scores rank by doc_id; an empty table gives an empty result; only the
named columns are read, so extra ones that clash do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import ALNUM, LOWER, NO_KEY, has_bit, hash_bits, materialize, prefix_hash, span_hash, steps, strings, text_bytes, words

#: Results of an item.
TOP = 10
#: Documents, and bytes of text, after which a block of the index ends.
BLOCK_DOCS, BLOCK_BYTES = 4096, 1 << 26
#: Pairs of item and term, and items, of a bundle, about.
BUNDLE_TERMS, BUNDLE_ITEMS = 16384, 512
#: Weights below which a term goes to the next owner.
OWNERS = (6900, 4100, 2000)


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all terms of lower-cased bytes, and the index of each row's first one."""
    start, end, first = words(raw, off, ~ALNUM)
    return start, end, span_hash(prefix_hash(raw), start, end) if len(start) else np.zeros(0, np.uint64), first


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term, hash), with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            raw, off = text_bytes(batch.column(1))
            raw = LOWER[raw]
            start, end, h, first = spans(raw, off)
            row = np.repeat(np.arange(len(batch)), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), strings(raw, start, end), pa.array(h.view(np.int64))], ["item_id", "term", "hash"])

    d = items.select(F.col(key).alias("item_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"item_id {d.schema['item_id'].dataType.simpleString()}, term string, hash long")


def inverted(docs: DataFrame, bits: np.ndarray, key: str, text: str) -> DataFrame:
    """The index: for each block a row with null term (ids, documents with terms, terms), and a row (block, term, df, most, list) for each term whose hash `bits` has.

    list: 32-bit arrays of documents in the block, occurrences, and lengths, end to end; most: the largest occurrence.
    """
    known = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("block", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("most", pa.int64()), ("list", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, number = known.value, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            doc, h, n = (np.concatenate(x) for x in (at, hashes, lengths))
            keys = np.concatenate(ids)
            rows = [(number, None, int((n > 0).sum()), int(n.sum()), keys.tobytes())]
            if len(h):
                order = np.argsort(h, kind="stable")  # documents stay in order
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                begin = np.flatnonzero(new)
                tf, doc, h = np.diff(np.append(begin, len(h))), doc[begin], h[begin]
                term = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                for i, j in zip(term.tolist(), [*term[1:].tolist(), len(h)], strict=True):
                    rows.append((number, names[int(h[i])], j - i, int(tf[i:j].max()), np.concatenate([doc[i:j], tf[i:j], n[doc[i:j]]]).astype(np.int32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        at, hashes, lengths, ids, names, size, count = [], [], [], [], {}, 0, 0
        for batch in steps(batches):
            for lo in range(0, len(batch), BLOCK_DOCS):
                part = batch.slice(lo, BLOCK_DOCS)
                if count and count + len(part) > BLOCK_DOCS:
                    yield flush()
                    at, hashes, lengths, ids, names, size, count, number = [], [], [], [], {}, 0, 0, number + 1
                raw, off = text_bytes(part.column(1))
                raw = LOWER[raw]
                start, end, h, first = spans(raw, off)
                hit = np.flatnonzero(has_bit(table, h))
                row = np.repeat(np.arange(len(part)), np.diff(first))
                at.append(row[hit] + count)
                hashes.append(h[hit])
                lengths.append(np.diff(first))
                ids.append(part.column(0).to_numpy())
                for x, i in zip(*np.unique(h[hit], return_index=True), strict=True):
                    if int(x) not in names:
                        names[int(x)] = raw[start[hit[i]] : end[hit[i]]].tobytes().decode()
                size, count = size + len(raw), count + len(part)
                if size >= BLOCK_BYTES:
                    yield flush()
                    at, hashes, lengths, ids, names, size, count, number = [], [], [], [], {}, 0, 0, number + 1
        if count:
            yield flush()

    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(text).alias("text"))
    return d.mapInArrow(run, "block long, term string, df long, most long, list binary")


def visit(state: DataFrame, lists: DataFrame, n: int, total: int) -> DataFrame:
    """The bundles' accumulators after one owner. state: (bundle, block, item, docs, scores, low, rest); lists: (bundle, block, w, items, list).

    items: the items of a bundle that ask for the list's term, each with low, the bound that its result reaches, rest, what later owners
    add at most, and opens, whether documents not yet in its accumulators can still reach the bound.
    """

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        have = {}
        for item, d, s, low, rest in zip(*(left.column(c).to_pylist() for c in ("item", "docs", "scores", "low", "rest")), strict=True):
            have[item] = (np.frombuffer(d, np.int32), np.frombuffer(s, np.int64), low, rest, False)
        lists = []
        width = max([int(x[0][-1]) + 1 for x in have.values() if len(x[0])], default=0)
        for w, items, body in zip(*(right.column(c).to_pylist() for c in ("w", "items", "list")), strict=True):
            doc, tf, length = np.frombuffer(body, np.int32).reshape(3, -1).astype(np.int64)
            m = 10 + (90 * length * n) // total
            items = [x for x in items if x["opens"] or x["item"] in have]
            if items:
                lists.append((doc, w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m)), items))
                width = max(width, int(doc[-1]) + 1)
        sums: dict[int, np.ndarray] = {}
        for item, (d, s, *_) in have.items():
            sums[item] = np.zeros(width, np.int64)
            sums[item][d] = s
        for doc, value, items in lists:
            for x in items:
                k = x["item"]
                if k not in sums:
                    sums[k] = np.zeros(width, np.int64)
                if x["opens"] or k not in have:
                    have[k] = (have[k][0] if k in have else np.zeros(0, np.int32), None, x["low"], x["rest"], x["opens"])
                sums[k][doc] += value
        out = []
        for k, (d, _, low, rest, opens) in have.items():
            s = sums[k]
            d = np.flatnonzero(s) if opens else d
            d = d[(s[d] > 0) & (s[d] + rest >= low)]
            if len(d):
                s = s[d]
                best = np.sort(s)[::-1][:TOP]
                out.append((k, d.astype(np.int32).tobytes(), s.tobytes(), best.tolist()))
        key = right if len(right) else left
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({
            "bundle": pa.array([key.column("bundle")[0].as_py()] * len(out), pa.int32()), "block": pa.array([key.column("block")[0].as_py()] * len(out), pa.int64()),
            "item": pa.array(cols[0], pa.int64()), "docs": pa.array(cols[1], pa.binary()), "scores": pa.array(cols[2], pa.binary()), "best": pa.array(cols[3], pa.list_(pa.int64())),
        })

    by = ("bundle", "block")
    return state.groupBy(*by).cogroup(lists.groupBy(*by)).applyInArrow(add, "bundle int, block long, item long, docs binary, scores binary, best array<long>")


def first_of_blocks(state: DataFrame, ids: DataFrame, top: int) -> DataFrame:
    """(item, doc_id, score): the `top` best of each item in each block. ids: (block, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, keys, scores = [], [], []
            for item, d, s, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s, own = np.frombuffer(s, np.int64), np.frombuffer(own, np.int64)[np.frombuffer(d, np.int32)]
                best = np.lexsort((own, -s))[:top]
                items.append(np.full(len(best), item))
                keys.append(own[best])
                scores.append(s[best])
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (items, keys, scores)], ["item", "doc_id", "score"])

    return state.join(ids, "block").select("item", "docs", "scores", "ids").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents of the highest scores above 0 for each item."""
    if top > TOP:
        raise ValueError(f"bounds are kept for {TOP} results")
    spark = docs.sparkSession
    terms = materialize(item_terms(items, item_key, item_text).distinct(), "asked_terms")
    # items are numbered once and written; a bundle is some hundreds of them
    named = materialize(terms.groupBy("item_id").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("item"), "item_id", "n"), "items")
    count, pairs = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bundles = max(1, -(-pairs // BUNDLE_TERMS), -(-count // BUNDLE_ITEMS))
    index = materialize(inverted(docs, hash_bits(terms.select("hash")), key, text), "index")
    blocks = index.where("term IS NULL").select("block", "df", "most", F.col("list").alias("ids"))
    n, total = blocks.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("most"), F.lit(0))).first()
    per = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    w = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1)))
    bound = F.expr("w * ((1000000000 * most) div (1000 * most + 80))")  # a document's m is at least 10
    owner = sum(((F.col("w") < x).cast("int") for x in OWNERS), F.lit(0))
    asked = terms.join(per, "term").join(named.select("item", F.col("item_id").alias("own")), F.col("item_id").eqNullSafe(F.col("own"))).withColumn("w", w).where("w > 0")
    asked = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"), "term", "w", bound.alias("bound"), owner.alias("owner"))
    asked = materialize(asked, "asked")
    state = spark.createDataFrame([], "bundle int, block long, item long, docs binary, scores binary, best array<long>")
    low = asked.select("item").distinct().withColumn("low", F.lit(0).cast("long"))
    for stage in range(len(OWNERS) + 1):
        rest = asked.groupBy("item").agg(F.sum(F.when(F.col("owner") >= stage, F.col("bound")).otherwise(0)).alias("now"), F.sum(F.when(F.col("owner") > stage, F.col("bound")).otherwise(0)).alias("rest"))
        bounds = rest.join(low, "item", "left").select("item", "now", "rest", F.coalesce("low", F.lit(0)).alias("low"))
        need = asked.where(F.col("owner") == stage).join(bounds, "item")
        need = need.groupBy("bundle", "term", "w").agg(F.collect_list(F.struct("item", (F.col("now") >= F.col("low")).alias("opens"), "low", "rest")).alias("items"))
        lists = index.where("term IS NOT NULL").select("block", "term", "list").join(need, "term").select("bundle", "block", "w", "items", "list")
        held = state.drop("best").join(bounds.select("item", "low", "rest"), "item").select("bundle", "block", "item", "docs", "scores", "low", "rest")
        state = materialize(visit(held, lists, n, max(total, 1)), f"owner{stage}")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score")))
        low = state.select("item", F.explode("best").alias("score")).withColumn("place", place).where(F.col("place") <= TOP).where(F.col("place") == TOP).select("item", F.col("score").alias("low"))
    best = first_of_blocks(state, blocks.select("block", "ids"), top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= top)
    return best.join(named.select("item", "item_id"), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")).alias("doc_id"), "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = f"""WITH dt AS (SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, {CASES}), '{TERM}')) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
it AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {CASES}), '{TERM}')) AS term FROM benchmark)),
size AS (SELECT rid, count(*) AS n FROM dt GROUP BY rid),
whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
tfs AS (SELECT rid, doc_id, term, count(*) AS tf FROM dt GROUP BY rid, doc_id, term),
ws AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term) d, whole),
m AS (SELECT rid, 10 + (90 * n * nn) // ll AS m FROM size, whole),
sc AS (SELECT item_id, tfs.rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM it JOIN tfs USING (term) JOIN ws USING (term) JOIN m ON m.rid = tfs.rid GROUP BY item_id, tfs.rid, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {TOP}"""

QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLES = {"op13_lexical_search": SQL}
