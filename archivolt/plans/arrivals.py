"""Queries of landed months, of chains of any depth, of records as variants and of tables kept in parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.operators.closure import follow
from archivolt.plans.views import read, records
from archivolt.sources import landed, parts, variants
from archivolt.sources.shared import new_folder, written
from archivolt.streaming import timers

QUERIES, ORACLES = {}, {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, text
        return f

    return add


@query()
def landed_months(spark, sf):
    """Clicks landed by month, first with what had arrived by the month's end, while their source reports all; the truncated
    months then land again. By month: what the first landing held and the source reported, and the rows of a batch read and of a
    stream that was resumed after each landing. It writes files; tests compare it with counts in Python."""
    landed.register(spark)
    clicks = read(spark, sf, "clicks", "click_id", "ts", "arrived_at", "value").where("ts IS NOT NULL AND arrived_at IS NOT NULL")
    clicks = clicks.withColumn("month", F.date_format("ts", "yyyy-MM"))
    hits = clicks.groupBy("month").agg(F.count(F.lit(1)).alias("hits"))
    base = new_folder(spark, "landing")
    path, shape = f"{base}/months", clicks.select("click_id", "value", "month").schema

    def resume() -> None:
        stream = spark.readStream.format("landed_months").schema(shape).option("path", path).load()
        timers.resume(stream, f"{base}/out", f"{base}/checkpoint")

    in_time = F.col("arrived_at") < F.date_trunc("month", "ts") + F.expr("interval 1 month")
    landed.land(clicks.where(in_time), hits, path)
    report = spark.read.format("landed_months").option("path", path).option("report", "true").load()
    first = written(report, "first-landing")
    resume()
    cut = first.where(~F.col("complete")).select("month")
    landed.land(clicks.join(cut, "month", "left_semi"), hits.join(cut, "month", "left_semi"), path)
    resume()
    counts = lambda df, name: df.groupBy("month").agg(F.count(F.lit(1)).alias(name))
    batch = counts(spark.read.format("landed_months").schema(shape).option("path", path).load(), "n")
    streamed = counts(spark.read.schema(shape).option("recursiveFileLookup", True).parquet(f"{base}/out"), "n_streamed")
    both = first.join(batch, "month", "left").join(streamed, "month", "left")
    return both.select("month", F.col("n_docs").alias("n_first"), "hits", (~F.col("complete")).alias("truncated"), "n", "n_streamed")


@query("""WITH s AS (SELECT client_id, seq, min(change_id) AS node FROM client_changes WHERE client_id IS NOT NULL AND seq IS NOT NULL AND change_id IS NOT NULL GROUP BY ALL),
i AS (SELECT *, seq - row_number() OVER (PARTITION BY client_id ORDER BY seq) AS island FROM s),
c AS (SELECT client_id, seq, first_value(node) OVER w AS root, row_number() OVER w - 1 AS hops FROM i WINDOW w AS (PARTITION BY client_id, island ORDER BY seq)),
n AS (SELECT DISTINCT change_id, client_id, seq FROM client_changes WHERE change_id IS NOT NULL)
SELECT change_id, CASE WHEN hops > 0 THEN root ELSE change_id END AS root_id, coalesce(hops, 0) AS hops FROM n LEFT JOIN c USING (client_id, seq)""")
def change_origins(spark, sf):
    """Every change of a client with the first one of its unbroken chain, over links from a change to the one numbered before it."""
    changes = read(spark, sf, "client_changes", "change_id", "client_id", "seq").distinct()
    firsts = changes.where("change_id IS NOT NULL").groupBy("client_id", (F.col("seq") + 1).alias("seq")).agg(F.min("change_id").alias("before"))
    ends = follow(changes.join(firsts, ["client_id", "seq"], "left"), "change_id", "before")
    return ends.select(F.col("node").alias("change_id"), F.col("root").alias("root_id"), "hops")


_PROPS = "p AS (SELECT CASE WHEN json_valid(props) THEN CAST(props AS JSON) END AS j FROM clicks)"


@query(f"""WITH {_PROPS}
SELECT j IS NULL AS broken, json_extract_string(j, '$.device.os') AS os, count(*) AS n, CAST(sum(TRY_CAST(json_extract_string(j, '$.k') AS BIGINT)) AS BIGINT) AS k,
CAST(sum(CASE WHEN json_type(j, '$.items') = 'ARRAY' THEN list_sum(CAST(json_extract(j, '$.items[*].qty') AS BIGINT[])) END) AS BIGINT) AS quantity
FROM p GROUP BY ALL""")
def variant_props(spark, sf):
    """The properties of clicks as variants: totals by operating system, with the records that are no JSON apart."""
    rows = variants.opened(read(spark, sf, "clicks", "props"), "props")
    items = variants.field("record", "array<struct<qty: bigint>>", "$.items")
    quantity = F.nullif(F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["qty"], F.lit(0))), F.lit(0))
    keys = (F.col("record").isNull().alias("broken"), variants.field("record", "string", "$.device.os", "$.Device.os").alias("os"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(variants.field("record", "bigint", "$.k", "$.K")).alias("k"), F.sum(quantity).alias("quantity")
    )


@query(f"""WITH {_PROPS}, o AS (SELECT j, unnest(json_keys(j)) AS field FROM p WHERE json_type(j) = 'OBJECT'),
f AS (SELECT field, json_type(j, '$.' || field) AS t FROM o WHERE field NOT IN ('k', 'device'))
SELECT field, CASE t WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'NULL' THEN 'VOID' ELSE t END AS kind, count(*) AS n FROM f GROUP BY ALL""")
def variant_unseen(spark, sf):
    """The fields of clicks' properties beside the two that are read, with the types they come in."""
    return variants.unseen_fields(variants.opened(read(spark, sf, "clicks", "props"), "props"), "record", ["k", "device"])


@query()
def parts_rewritten(spark, sf):
    """Records kept by year, brought to three states: as they are; again; without the first year and with one more word in each record
    of the last. By year: how often it was written, and the rows and words that are read in the end. It writes files; tests
    compare it with Python."""
    rows = records(spark, sf).select("article_id", "yr", "word_count").where("yr IS NOT NULL")
    path = new_folder(spark, "parts")
    first, last = rows.agg(F.min("yr"), F.max("yr")).first()
    later = rows.where(F.col("yr") > F.lit(first)).withColumn("word_count", F.col("word_count") + (F.col("yr") == F.lit(last)).cast("int"))
    runs = [parts.write_parts(df, path, "yr") for df in (rows, rows, later)]
    times = [(int(p[1:]), sum(p in r["written"] for r in runs)) for p in sorted({p for r in runs for p in r["written"]})]
    own = parts.read_parts(spark, path, rows.schema).groupBy("yr").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"))
    return spark.createDataFrame(times, "yr int, times int").join(own, "yr", "left").select("yr", "times", F.coalesce("n", F.lit(0)).alias("n"), "words")
