"""Mixing sources to target weights by a low-discrepancy schedule.

The schedule is a row of slots; slot k points at u(k), the van der Corput sequence in base 2, and u(k) falls into the interval that a source
has of the cumulative weights. So every stretch of the schedule holds the sources in nearly their shares, and which source
a slot has needs no state. The slots of a source are ranked; the slot of rank r takes the r-th block of `block` words of
the source, whose documents are shuffled by a keyed hash, anew for each epoch, and laid end to end. The last block of a source ends
where its target does. A source never runs for more than `most` epochs.

What is a row of the schedule is made from the source's interval, so no slot is compared with the sources. Ranks and
places are running sums in two steps, over the totals of bounded groups and within each group, so a source
with most of the rows is spread like any other. The table of sources, a row each, is sorted in one task.

Defined results: a null or wordless text has size 0 and is never taken; a null source is a source, the last one; rows that
repeat a key are documents of their own (equal keys of equal size in one source may change places); a null key is
a document; an empty table gives an empty result; only the named columns are read, so extra ones that clash do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import materialize

#: Words of a block, and so of a slot of the schedule.
BLOCK = 4096
#: Epochs of a source at most.
MOST = 3
#: Slots, and hexadecimal digits of the shuffle's hash, that make a group of the running sums.
CHUNK, DIGITS = 1 << 16, 4


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, source, size) of each row of docs, written once so that the number of a row stays."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    d = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    return materialize(d.select(F.monotonically_increasing_id().alias("row"), "*"), "sizes")


def cycled(sources: DataFrame, period: int = 3) -> DataFrame:
    """(source, source_size) with weights 1 to period by code point, null last."""
    return sources.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % period + 1)


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """target of each (source, source_size, weight): shares of all words by weight, none above `most` times its size.

    What is above is shared again by weight until none is: sources in order of size / weight reach their limit first, so
    those at their limit are the first ones, and one level holds for all others.
    """
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * most
    d = sources.withColumns({
        "total": F.sum("source_size").over(Window.partitionBy()), "weights": F.sum("weight").over(Window.partitionBy()),
        "filled": F.coalesce(F.sum(cap).over(before), F.lit(0)), "passed": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("level", (F.col("total") - F.col("filled")) / (F.col("weights") - F.col("passed")))
    d = d.withColumn("limited", cap <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("limited"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("limited"), cap.cast("double")).otherwise(F.least(cap.cast("double"), level * F.col("weight")))
    return d.select("source", "source_size", "weight", target.alias("target"))


def schedule(needs: DataFrame) -> DataFrame:
    """(s, rank, slot) for sources s that need so many slots: needs has (s, slots).

    The points u(k) of k = 0 .. 2**m - 1 are the multiples of 2**-m, and 2**m is at least the number of slots needed, so the
    interval of a source holds as many points as it needs or more; the earliest ones are taken.
    """
    total = needs.agg(F.sum("slots")).first()[0] or 0
    m = max(0, int(total - 1).bit_length()) if total else 0
    big = "decimal(38,0)"
    edge = lambda c: F.expr(f"(CAST({c} AS {big}) * {1 << m} + {max(total, 1) - 1}) div {max(total, 1)}")
    ends = F.sum("slots").over(Window.orderBy("s"))
    d = needs.withColumn("end", ends).withColumn("begin", F.col("end") - F.col("slots")).where("slots > 0")
    d = d.select("s", "slots", edge("begin").alias("lo"), edge("end").alias("hi"))
    d = d.withColumn("part", F.explode(F.expr(f"sequence(lo div {CHUNK}, (hi - 1) div {CHUNK})"))).repartition("s", "part")
    point = F.explode(F.sequence(F.greatest(F.col("lo"), F.col("part") * CHUNK), F.least(F.col("hi"), (F.col("part") + 1) * CHUNK) - 1))
    d = d.select("s", "slots", point.alias("point"))
    # the k whose point is point * 2**-m has the same m bits in reverse
    k = F.conv(F.reverse(F.lpad(F.bin("point"), m, "0")), 2, 10).cast("long") if m else F.lit(0).cast("long")
    d = d.select("s", "slots", k.alias("slot")).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1
    before = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("s", "chunk").agg(F.count("*").alias("n")).select("s", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    d = d.withColumn("rank", within).join(starts, ["s", "chunk"]).select("s", "slot", "slots", (F.col("rank") + F.col("start")).alias("rank"))
    return d.where("rank < slots").select("s", "rank", "slot")


def blocks(sized: DataFrame, wants: DataFrame, block: int) -> DataFrame:
    """(row, s, rank, epoch, start, words): the parts of documents in each block of each source.

    sized: (row, doc_id, s, size); wants: (s, source_size, want). start: the part's first word in its document.
    """
    passes = F.expr("CAST(ceil(want / source_size) AS INT)")
    d = sized.where("size > 0").join(wants.where("want > 0"), "s").withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    d = d.withColumn("h", F.md5(F.concat_ws(":", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))).withColumn("bucket", F.substring("h", 1, DIGITS))
    group = ["s", "epoch", "bucket"]
    before = Window.partitionBy("s", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*group).agg(F.sum("size").alias("words")).select(*group, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("first"))
    within = F.sum("size").over(Window.partitionBy(*group).orderBy("h", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("at", within - F.col("size")).join(starts, group)
    d = d.withColumn("at", F.col("at") + F.col("first") + F.col("epoch") * F.col("source_size")).where("at < want")
    d = d.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("want")))
    d = d.withColumn("rank", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
    begin = F.greatest(F.col("at"), F.col("rank") * block)
    return d.select("row", "s", "rank", "epoch", (begin - F.col("at")).alias("start"), (F.least(F.col("end"), (F.col("rank") + 1) * block) - begin).alias("words"))


def planned(sized: DataFrame, weigh=cycled, most: int = MOST) -> DataFrame:
    """(s, source, source_size, weight, target, want): each source's number, target, and target in whole words."""
    per = weigh(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    d = targets(per, most).withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    return materialize(d.withColumn("want", F.round("target").cast("long")), "targets")


def numbered(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized with the number and target of each row's source."""
    return sized.join(plan.select(F.col("source").alias("own"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("own"))).drop("own")


def mix(sized: DataFrame, plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, row, epoch, start, words) in no order: the mix is read by slot, then by row; slots may be missing at its end."""
    needs = plan.select("s", F.expr(f"(want + {block - 1}) div {block}").alias("slots"))
    parts = blocks(numbered(sized, plan).select("row", "doc_id", "s", "size"), plan.select("s", "source_size", "want"), block)
    return parts.join(schedule(needs), ["s", "rank"]).select("slot", "row", "epoch", "start", "words")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, repeats counted."""
    sized = sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = planned(sized)
    taken = mix(sized, plan).groupBy("row").agg(F.sum("words").alias("taken"))
    return numbered(sized, plan).join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


#: The same schedule, shuffle and blocks; the bits of a point are turned by sums.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT *, (s - 1) % 3 + 1 AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM d GROUP BY source)),
run AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum({MOST} * source_size) OVER b, 0) AS filled, coalesce(sum(weight) OVER b, 0) AS passed
  FROM per WINDOW b AS (ORDER BY source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, CAST(total - filled AS DOUBLE) / CAST(weights - passed AS DOUBLE) AS level FROM run),
lim AS (SELECT *, {MOST} * source_size <= level * weight AS limited FROM lev),
tgt AS (SELECT s, source, source_size, CASE WHEN limited THEN CAST({MOST} * source_size AS DOUBLE) ELSE least(CAST({MOST} * source_size AS DOUBLE), max(CASE WHEN NOT limited THEN level END) OVER () * weight) END AS target FROM lim),
plan AS (SELECT *, CAST(round(target) AS BIGINT) AS want, (CAST(round(target) AS BIGINT) + {BLOCK - 1}) // {BLOCK} AS slots FROM tgt),
span AS (SELECT *, CAST(sum(slots) OVER (ORDER BY s) AS HUGEINT) AS stop, CAST(sum(slots) OVER () AS HUGEINT) AS n FROM plan),
grid AS (SELECT *, CAST(CASE WHEN n > 1 THEN ceil(log2(n)) ELSE 0 END AS INT) AS m FROM span),
edge AS (SELECT s, slots, m, CAST(((stop - slots) * (1::HUGEINT << m) + n - 1) // n AS BIGINT) AS lo, CAST((stop * (1::HUGEINT << m) + n - 1) // n AS BIGINT) AS hi FROM grid WHERE slots > 0),
pts AS (SELECT s, slots, m, unnest(range(lo, hi)) AS point FROM edge),
sched AS (SELECT s, slots, row_number() OVER (PARTITION BY s ORDER BY coalesce(list_sum(list_transform(range(m), lambda i: ((point >> i) & 1) << (m - 1 - i))), 0)) - 1 AS rank FROM pts),
occ AS (SELECT rid, doc_id, s, size, source_size, want, unnest(range(CAST(ceil(want / source_size) AS BIGINT))) AS epoch FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source WHERE size > 0 AND want > 0),
pos AS (SELECT *, epoch * source_size + sum(size) OVER (PARTITION BY s, epoch ORDER BY md5(epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), size, rid) - size AS place FROM occ),
cut AS (SELECT *, least(place + size, want) AS stop FROM pos WHERE place < want),
part AS (SELECT *, unnest(range(CAST(place // {BLOCK} AS BIGINT), CAST((stop - 1) // {BLOCK} AS BIGINT) + 1)) AS rank FROM cut),
took AS (SELECT rid, CAST(sum(least(stop, (part.rank + 1) * {BLOCK}) - greatest(place, part.rank * {BLOCK})) AS BIGINT) AS taken FROM part JOIN sched ON part.s = sched.s AND part.rank = sched.rank AND sched.rank < sched.slots GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source LEFT JOIN took ON d.rid = took.rid"""

QUERIES = {"op12_source_mix": op12_source_mix}
ORACLES = {"op12_source_mix": SQL}
