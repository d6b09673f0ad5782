"""Record views over the driver's tables, in Spark and as SQL for the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Rows of a table that one task holds at a time, where rows are dealt by article.
ROWS_A_TASK = 250_000


def tasks(df: DataFrame, rows: int | None = None) -> int:
    """Partitions that follow the table, so that a task's rows don't grow with it. Left to itself Spark merges partitions until
    there are as many as cores, and joins, windows and sets by article then hold all of their rows in one task."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or ROWS_A_TASK)))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: section, material, words, place and region of the customer."""
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return (
        orders.join(read(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(*_record(), F.col("o_custkey").alias("custkey"), F.col("n_name").alias("place"), F.col("r_name").alias("region"))
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `articles`, without the places: no join."""
    return read(spark, sf_dir, "orders").select(*_record(), F.col("o_custkey").alias("custkey"))


def _record() -> list:
    return [
        F.col("o_orderkey").alias("article_id"),
        F.to_date("o_orderdate").alias("pub_date"),
        F.year("o_orderdate").alias("yr"),
        F.month("o_orderdate").alias("mon"),
        F.col("o_orderpriority").alias("section"),
        F.col("o_orderstatus").alias("material"),
        F.when(F.col("o_orderkey") % 17 == 0, 0).otherwise(F.floor(F.col("o_totalprice") / 100).cast("int")).alias("word_count"),
    ]


def article_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by article before duplicates go, so that what follows by article (windows, joins, pairs) needs no exchange."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    return (
        lines.join(read(spark, sf_dir, "supplier", "s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select(F.col("l_orderkey").alias("article_id"), F.col("s_name").alias("author"))
        .repartition(tasks(lines), "article_id")
        .distinct()
    )


def article_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
    return (
        lines.join(read(spark, sf_dir, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("article_id"), F.col("p_name").alias("subject"))
        .repartition(tasks(lines), "article_id")
        .distinct()
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, headline): the least part name of each order."""
    return (
        read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey")
        .join(read(spark, sf_dir, "part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("article_id"))
        .agg(F.min("p_name").alias("headline"))
    )


_RECORD_SQL = """SELECT o_orderkey AS article_id, CAST(o_orderdate AS DATE) AS pub_date, CAST(year(o_orderdate) AS INT) AS yr,
  CAST(month(o_orderdate) AS INT) AS mon, o_orderpriority AS section, o_orderstatus AS material,
  CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 100) AS INT) END AS word_count, o_custkey AS custkey"""

#: Common table expressions of the views, by name.
SQL = {
    "record": f"record AS ({_RECORD_SQL} FROM orders)",
    "article": f"""article AS ({_RECORD_SQL}, n_name AS place, r_name AS region FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "author": """author AS (SELECT DISTINCT l_orderkey AS article_id, s_name AS author
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)""",
    "subject": """subject AS (SELECT DISTINCT l_orderkey AS article_id, p_name AS subject
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "headline": """headline AS (SELECT l_orderkey AS article_id, min(p_name) AS headline
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)""",
}


def sql(views: str, body: str) -> str:
    """SQL that begins with the named views; `body` may go on with its own, after a comma."""
    return "WITH " + ",\n".join(SQL[v] for v in views.split()) + body
