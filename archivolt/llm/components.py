"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(F.pmod(mark, F.lit(1 << 31)))).first())


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) where label is the smallest node reachable over `edges` (a, b).

    Alternating large-star and small-star rounds, each written to the shared folder; every round is a shuffle by node
    with partial aggregation, and the rounds needed grow with the logarithm of the longest path.
    """
    links_ = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links_ = stored(links_, "links")
    before = _state(links_)
    for _ in range(max_rounds):
        both = links_.unionByName(links_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = stored(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _state(small)
        drop_stored(links_)
        links_ = small
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # every root is the least of its star now
    return nodes.join(links_.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("label")
    )
