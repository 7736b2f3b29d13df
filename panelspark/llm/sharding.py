"""Sharding through fixed virtual slots: records hash into thousands of slots, shards own slots.

A record's slot comes from its key and text alone (an edited text is another record); a versioned map says which shard owns each slot. Rebalancing edits the map
that is stored: it moves a few slots, chosen by the bytes they hold, and adds a version. Native DataFrame functions only.

Defined results: a null text counts 0 bytes, so its record has the fixed overhead alone; rows that are equal in every
key column share a slot and are told apart by their place in it; an empty table gives an empty result and a map
that is still whole; columns of the input that clash with the added names are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Virtual slots. A constant of the store: it bounds the map, whatever the number of records.
SLOTS = 8192
#: Bytes that each record costs besides its text.
OVERHEAD = 16


def with_slots(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32 and virtual slot of each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(key),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64(F.col(key), F.col("text_crc32")), F.lit(slots)).cast("int"))


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot: at most one row a slot."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def even_map(shards: int, slots: int = SLOTS) -> list[int]:
    """Version 0 of the map: slots dealt in turn, before anything is known of their sizes."""
    return [s % shards for s in range(slots)]


def rebalanced(owner: list[int], bytes_of: dict[int, int], shards: int) -> list[int]:
    """The next version: move slots from the fullest shard to the emptiest while that narrows their gap. Reads slot totals only."""
    owner = list(owner)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owner):
        if b := bytes_of.get(slot, 0):
            load[shard] += b
            held[shard].append((b, slot))
    for h in held:
        h.sort()
    for _ in range(4 * len(owner)):
        full, empty = max(range(shards), key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[full] - load[empty]
        # the slot nearest to half the gap narrows it most; one of the whole gap or more would not
        i = min(range(len(held[full])), key=lambda k: abs(2 * held[full][k][0] - gap), default=None)
        if i is None or held[full][i][0] >= gap:
            break
        b, slot = held[full].pop(i)
        owner[slot] = empty
        load[full] -= b
        load[empty] += b
        held[empty].append((b, slot))
        held[empty].sort()
    return owner


def map_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """The versioned map as a table (version, vslot, shard)."""
    return spark.createDataFrame(
        [(v, s, shard) for v, owner in versions.items() for s, shard in enumerate(owner)],
        "version int, vslot int, shard int",
    )


def save_map(table: DataFrame, path: str) -> None:
    """Add the newest version to the stored map, all of them where nothing is stored; a partition for each version."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """The stored map with all its versions."""
    return spark.read.schema("vslot int, shard int, version int").parquet(path).select("version", "vslot", "shard")


def latest(table: DataFrame) -> tuple[int, list[int]]:
    """Number and owners of the newest version: a row for each slot."""
    version = table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).select("vslot", "shard").collect()
    return version, [r.shard for r in sorted(rows)]


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, current: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Deal the records of df into `shards` shards of near equal bytes.

    current: the stored map, whose newest version is edited; without one, slots are dealt in turn as version 0.
    Returns the records (key, size, text_crc32, vslot, version, shard, slot) and the version edited and the new one. `slot` is a record's
    place in its shard, gapless from 0: the rows of the shard's earlier virtual slots and the place within its own,
    so that no shard is sorted as a whole.
    """
    records = with_slots(df, key, text, slots)
    totals = {r.vslot: (r.bytes, r.rows) for r in slot_totals(records).collect()}  # at most `slots` rows
    version, first = latest(current) if current is not None else (0, even_map(shards, slots))
    if len(first) != slots:
        raise ValueError(f"the stored map has {len(first)} slots, not {slots}")
    # slots of shards that are no more are dealt in turn
    last = rebalanced([o if o < shards else s % shards for s, o in enumerate(first)], {s: b for s, (b, _) in totals.items()}, shards)
    before, offset = [0] * shards, []
    for slot, owner in enumerate(last):
        offset.append((slot, version + 1, owner, before[owner]))
        before[owner] += totals.get(slot, (0, 0))[1]
    owners = df.sparkSession.createDataFrame(offset, "vslot int, version int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(key, "text_crc32", "size"))
    dealt = (
        records.join(F.broadcast(owners), "vslot")  # `slots` rows, whatever the input
        .withColumn("slot", F.col("base") + place - 1)
        .drop("base")
    )
    return dealt, map_table(df.sparkSession, {version: first, version + 1: last})


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dealt, _ = shard(docs, 40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "vslot", "version",
    )


QUERIES = {"op7_sharding": op7_sharding}
