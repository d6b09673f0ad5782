"""Exact duplicates by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import BLANKS, by_bucket, drop_stored, stored, stored_in_buckets, table, texts

_KEY = ("digest", "check", "n_norm")
#: Texts of the whole table that one bucket of a run is for.
BUCKET_ROWS = 1_000_000


def merge_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted runs as one: a full merge join, which keeps of each key the best identifier and the summed size."""
    there = b.select(*_KEY, F.col("best").alias("__best"), F.col("group_size").alias("__size"))
    sizes = F.coalesce("group_size", F.lit(0)) + F.coalesce("__size", F.lit(0))
    return a.join(there, list(_KEY), "full").select(*_KEY, F.least("best", "__best").alias("best"), sizes.alias("group_size"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_runs: int = 8) -> DataFrame:
    """One row per document with the representative of its group of equal texts.

    Texts are equal when identical after deleting blanks; the copy with the most code points, then the smallest id,
    stays. The input's partitions are dealt over `n_runs` runs of (SHA-256, XXH64, length, best identifier, size), each a
    table in the shared folder that is bucketed by its key and sorted in each bucket. Runs are merged two by two in
    binomial rounds, run r with run r + 1, r + 2, r + 4: merge joins, bucket by bucket, which neither exchange nor sort
    rows and keep one row a key with the best identifier and the summed size (Spark's writer puts each bucket in order once
    more as it writes it). A merge needs all three parts of the key to
    agree; texts aren't compared again. A hot text is down to one row a task before the one exchange that deals a run into
    its buckets, and the last join, of all rows with the merged run, can be split at it.

    Null and empty texts (and blank ones) are one group. A null id ranks before any other. Rows that repeat an id are
    counted in group_size; each of them has the same verdict. An empty table gives an empty result. Of a long text only the
    normalised copy and its digests are made, in one task's memory.
    Columns: doc_id, keep_id, group_size, kept, text_sha256.
    """
    norm = F.translate("text", BLANKS, "")
    digests = (
        texts(docs, id_col, text_col)
        .withColumn("norm", norm)
        .select(
            "doc_id",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.xxhash64("norm").alias("check"),
            F.octet_length("norm").alias("n_norm"),
            F.char_length("text").alias("n_chars"),
            (F.spark_partition_id() % n_runs).alias("run"),  # a task writes to one run, so to one file
        )
    )
    digests = stored(digests, "digests", partition_by="run")
    spark = docs.sparkSession
    best = F.min(F.struct((-F.col("n_chars")).alias("rank"), F.col("doc_id").alias("doc_id")))
    buckets = min(100_000, max(8, digests.count() // BUCKET_ROWS))  # 100,000 is Spark's own limit
    with by_bucket(spark, buckets) as buckets:
        runs = []
        for k in range(n_runs):
            rows = digests.where(F.col("run") == k).groupBy(*_KEY).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
            runs.append(stored_in_buckets(rows, "digest-run", _KEY, buckets))
        while len(runs) > 1:
            pairs = [runs[k : k + 2] for k in range(0, len(runs), 2)]
            runs = [stored_in_buckets(merge_pair(*p), "digest-run", _KEY, buckets) if len(p) == 2 else p[0] for p in pairs]
            for old in (run for p in pairs if len(p) == 2 for run in p):
                drop_stored(old)
    winners = runs[0].select(*_KEY, F.col("best.doc_id").alias("keep_id"), "group_size")
    # a plain table: a join that shares the buckets' partitions could not be split at a hot text
    winners = stored(winners, "digest-winners")
    drop_stored(runs[0])
    return digests.join(winners, list(_KEY), "left").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, arg_min(doc_id, (-chars, doc_id)) AS keep_id, CAST(count(*) AS BIGINT) AS group_size
  FROM n GROUP BY text_sha256)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
