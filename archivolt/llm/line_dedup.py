"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.common import BLANKS, ascii_lower, by_bucket, drop_stored, stored, stored_in_buckets, table, texts

_HASH = ("h1", "h2")


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, row, line_no, h1, h2) of each line whose key (stripped, A-Z lowered) has at least `min_chars` code points."""
    lines = texts(docs).select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    return (
        lines.select("doc_id", "row", "line_no", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc_id", "row", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    )


#: Line hashes of the whole table that one bucket of a run is for.
BUCKET_ROWS = 1_000_000


class LineRuns:
    """Levels of sorted runs (hash, owner): tables in the shared folder, bucketed by hash and sorted in each bucket, so that
    joins between them and with a batch merge bucket by bucket without any exchange.

    A run is what one batch added. `fan_in` runs of a level are merged into one of the next, so a batch reads at most
    `fan_in` - 1 runs for each of log(batches) levels. Runs never share a hash.
    """

    def __init__(self, spark: SparkSession, fan_in: int = 2, buckets: int = 8):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets
        self.levels: list[list[DataFrame]] = []

    def write(self, rows: DataFrame, name: str) -> DataFrame:
        return stored_in_buckets(rows, name, _HASH, self.buckets)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fan_in:
            runs, self.levels[level] = self.levels[level], []
            merged = self.write(reduce(_merge, (r.select(*_HASH, "owner") for r in runs)), f"line-run-l{level + 1}")
            for old in runs:
                drop_stored(old)
            self.add(merged, level + 1)


def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted runs as one: a full merge join, in which no hash finds a partner."""
    both = a.join(b.withColumnRenamed("owner", "__owner"), list(_HASH), "full")
    return both.select(*_HASH, F.coalesce("owner", "__owner").alias("owner"))


def _cuts(lines: DataFrame, n_batches: int, sample: int = 1000) -> list:
    """Ids that part `lines` in about equal batches, from the at most `sample` ids of least hash. Where they fall decides how
    even the batches are, never the result."""
    ids = lines.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).orderBy("doc_id").collect()
    return sorted({ids[k * len(ids) // n_batches].doc_id for k in range(1, n_batches)}) if ids else []


def repeated_lines(docs: DataFrame, n_batches: int = 4, fan_in: int = 2, min_chars: int = 10) -> DataFrame:
    """(doc_id, row, line_no) of every line that an earlier document (smaller doc_id) already holds; row: the text's hash.

    Documents come in `n_batches` batches by ascending doc_id. A batch's hashes, one owner (smallest doc_id) each after
    partial aggregation, are written as a sorted run of their own. It is merge-joined with each of the levels' runs: what
    they hold has its owner there; what none of them holds (merge anti joins) is new and becomes the batch's run. The
    batch's lines whose owner is another document are reported. As batches ascend, an owner never changes once it is in a
    run. Equal keys are taken as those with equal 128 hash bits.
    """
    spark = docs.sparkSession
    lines = stored(line_hashes(docs, min_chars).where("doc_id IS NOT NULL"), "line-hashes")
    edges = [None, *(_cuts(lines, n_batches) if n_batches > 1 else []), None]
    buckets = min(100_000, max(8, lines.count() // BUCKET_ROWS))  # 100,000 is Spark's own limit
    found = []
    with by_bucket(spark, buckets) as buckets:
        runs = LineRuns(spark, fan_in, buckets)
        for k, (low, high) in enumerate(zip(edges, edges[1:])):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("doc_id") > F.lit(low))
            if high is not None:
                batch = batch.where(F.col("doc_id") <= F.lit(high))
            owners = batch.groupBy(*_HASH).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
            own, known = runs.write(owners, "line-batch"), runs.all()
            new = reduce(lambda rows, run: rows.join(run, list(_HASH), "left_anti"), known, own)
            old = [own.select(*_HASH).join(run.select(*_HASH, "owner"), list(_HASH)) for run in known]
            decided = reduce(DataFrame.union, old, new.where("owner < last").select(*_HASH, "owner"))
            # a plain table: a join that shares the buckets' partitions could not be split at a hot line
            decided = stored(decided, "line-owners")
            found.append(batch.join(decided, list(_HASH)).where("doc_id <> owner").select("doc_id", "row", "line_no"))
            if k < len(edges) - 2:
                runs.add(runs.write(new.select(*_HASH, "owner"), "line-run-l0") if known else own)
            if known or k == len(edges) - 2:
                drop_stored(own)
    for run in runs.all():
        drop_stored(run)
    return reduce(DataFrame.union, found)


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, dropped: pd.Series) -> pd.Series:
    out = []
    for t, gone in zip(text, dropped):
        if t is None or gone is None:
            out.append(None)
            continue
        gone = set(gone.tolist())
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    return pd.Series(out, dtype=object)


def drop_repeated_lines(docs: DataFrame, n_batches: int = 4, fan_in: int = 2, min_chars: int = 10) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, plus n_lines and n_dropped.

    A key (line stripped of blanks, A-Z lowered) of at least `min_chars` code points that two or more documents hold
    loses all its lines but those in the smallest doc_id that holds it. The other lines stay, joined by a newline.
    A null text counts as one empty line and comes back empty. A document with a null doc_id keeps all lines and is no
    owner. Rows that repeat a doc_id are parts of one document: none loses a line to another. Ids are of any type that has
    an order. All other columns are passed through, but columns named
    n_lines or n_dropped, which are replaced. An empty table gives an empty one. A long text is split in one piece,
    in memory of a few times its size.
    """
    drops = (
        repeated_lines(docs, n_batches, fan_in, min_chars)
        .groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row"))
        .agg(F.collect_set("line_no").alias("__dropped"))
    )
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__row"))
    both = docs.withColumn("text", body).join(drops, same, "left").drop("__id", "__row")
    n_lines = F.size(F.split("text", "\n", -1)).cast("long")
    some = F.col("__dropped").isNotNull()
    out = both.withColumns(
        {
            "n_lines": n_lines,
            "n_dropped": F.when(some, F.size("__dropped")).otherwise(0).cast("long"),
            "__kept": _without(F.when(some, F.col("text")), F.col("__dropped")),
        }
    )
    return out.withColumn("text", F.coalesce("__kept", "text")).drop("__dropped", "__kept")


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.*, owners.owner IS NOT NULL AND owners.owner <> keyed.doc_id AS gone
  FROM keyed LEFT JOIN owners ON keyed.k = owners.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
