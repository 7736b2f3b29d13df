"""Connected components of a table of links, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import materialize


def components(links: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable by links, for each node that has one.

    Large-star and small-star by turns: every node is linked to the smallest node it knows, until each component is a star
    around its smallest node. A hub's rows are aggregated before they meet, and each round is written to the shared folder.
    """
    e = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # large-star: the larger neighbours of each node go to its smallest neighbour or itself
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: the smaller neighbours of each node, and itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = materialize(e, "round")
        # a star has one row for each node but its centre; the sum settles when nothing moves
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
