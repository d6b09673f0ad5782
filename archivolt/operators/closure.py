"""Where chains of links end, at any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.sources.shared import delete, keep_until_release, new_folder


def follow(links: DataFrame, node: str, to: str) -> DataFrame:
    """(node, root, hops, cyclic) of every node: where its links lead in the end, over how many, or that they lead into a cycle.

    A root is a node without a link, with one to itself, or one that is only linked to (which has no row of its own). A node
    with several links takes the least; rows without a node are left out. In a cycle, and on the way into one, root is the
    cycle's least node and hops is null.

    Every round doubles what is known of a chain: a node that knows its next 2^r nodes joins the one behind them. So a chain of
    n links takes about log2(n) rounds, and each only moves rows that are still open against what is known. A node carries the
    least of the nodes passed: where two stretches in a row have the same least, it was passed twice, which is a cycle. Rounds
    are tables in the shared folder, so lost executors take none along.
    """
    spark, base = links.sparkSession, new_folder(links.sparkSession, "follow")
    keep_until_release(spark, base)
    n, t = F.col(node), F.col(to)
    rows = links.where(n.isNotNull()).groupBy(n.alias("node")).agg(F.min(F.when(t != n, t)).alias("end"), F.max(F.when(t == n, True)).alias("own"))
    is_open = F.col("end").isNotNull() & F.col("own").isNull()
    rows = rows.select(
        "node", F.when(is_open, F.col("end")).otherwise(F.col("node")).alias("end"), is_open.cast("long").alias("hops"),
        F.col("node").alias("least"), F.lit(False).alias("cyclic"), is_open.alias("open"),
    )
    schema, turn = rows.schema, 0
    rows.write.partitionBy("open").parquet(f"{base}/turn=0")

    def read(k: int, state: bool) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/turn={k}").where(F.col("open") == F.lit(state)).select(*schema.names)

    settled = read(0, False)
    while not read(turn, True).isEmpty():
        waiting = read(turn, True)
        known = settled.unionByName(waiting).select(
            F.col("node").alias("end"), F.col("end").alias("k_end"), F.col("hops").alias("k_hops"), F.col("least").alias("k_least"),
            F.col("cyclic").alias("k_cyclic"), F.col("open").alias("k_open"),
        )
        passed_twice = F.col("k_open") & (F.col("least") == F.col("k_least"))
        cyclic = F.coalesce(F.col("k_cyclic") | passed_twice, F.lit(False))
        step = waiting.select("node", "end", "hops", "least").join(known, "end", "left").select(
            "node",
            F.when(passed_twice, F.col("least")).otherwise(F.coalesce("k_end", "end")).alias("end"),
            F.when(~cyclic, F.col("hops") + F.coalesce("k_hops", F.lit(0))).alias("hops"),
            F.least("least", "k_least").alias("least"),
            cyclic.alias("cyclic"),
            F.coalesce(F.col("k_open") & ~cyclic, F.lit(False)).alias("open"),
        )
        turn += 1
        step.write.partitionBy("open").parquet(f"{base}/turn={turn}")
        delete(spark, f"{base}/turn={turn - 1}/open=true")
        settled = settled.unionByName(read(turn, False))
    return settled.select("node", F.col("end").alias("root"), "hops", "cyclic")
