"""Tables kept in parts, of which only those that changed are written."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from archivolt.sources.shared import delete, exists, listed, rename


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, parts) of the newest manifest of a table: for each part its folder, digest and rows; (0, {}) where there is none."""
    numbers = [int(n.split("-")[1]) for n in listed(spark, path) if n.startswith("manifest-")]
    if not numbers:
        return 0, {}
    return max(numbers), json.loads(spark.read.text(f"{path}/manifest-{max(numbers)}", wholetext=True).first().value)


def write_parts(df: DataFrame, path: str, part: str, fmt: str = "json", **options) -> dict[str, list[str]]:
    """Brings the table at `path` to the rows of `df`, and says which parts (values of a column) were written, kept and removed.

    A part is compared by its number of rows and two sums of their hashes, which don't depend on their order; those that haven't
    changed aren't written, and a run without a change writes no byte. Changed parts go to folders of their own; the new manifest
    then takes its place by one renaming, so readers see the old table or the new one, never some of both. Folders that it
    doesn't name go last. Null parts and repeated rows are kept as they are. Only the marks of parts reach the driver, so a part
    should be one that there are few of, as a year. One writer at a time. JSON is compressed unless `compression` says else.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    if fmt == "json":
        options = {"compression": "gzip", "ignoreNullFields": "false"} | options
    row, again = F.xxhash64(*df.columns), F.xxhash64(F.lit("again"), *df.columns)
    name = F.coalesce(F.concat(F.lit("="), F.col(part).cast("string")), F.lit("null"))
    sums = (F.concat_ws(" ", F.bit_xor(h).cast("string"), F.sum(F.pmod(h, F.lit(1 << 31))).cast("string")) for h in (row, again))
    marks = df.groupBy(name.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.lit(df.schema.simpleString()), *sums).alias("digest"))
    now = {r.part: {"digest": r.digest, "n": r.n} for r in marks.collect()}
    number, old = manifest(spark, path)
    changed = sorted(p for p in now if p not in old or any(old[p][k] != now[p][k] for k in ("digest", "n")))
    removed = sorted(set(old) - set(now))
    result = {"written": changed, "kept": sorted(set(now) - set(changed)), "removed": removed}
    if not changed and not removed and number:
        return result
    folder = f"parts-{uuid.uuid4().hex}"
    if changed:
        keys = {p: str(k) for k, p in enumerate(changed)}
        key = F.try_element_at(F.create_map(*(F.lit(x) for pair in keys.items() for x in pair)), name)
        rows = df.withColumn("__part", key).where(F.col("__part").isNotNull()).hint("rebalance", F.col("__part"))
        rows.write.format(fmt).options(**options).partitionBy("__part").save(f"{path}/{folder}")
        now |= {p: now[p] | {"folder": f"{folder}/__part={keys[p]}"} for p in changed}
    now |= {p: now[p] | {"folder": old[p]["folder"]} for p in result["kept"]}
    stage = f"{path}/.manifest-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(now, sort_keys=True),)], "value string").coalesce(1).write.text(stage)
    rename(spark, stage, f"{path}/manifest-{number + 1}")
    for gone in ({old[p]["folder"] for p in old} - {m["folder"] for m in now.values()}) | {f"manifest-{number}"}:
        if exists(spark, f"{path}/{gone}"):
            delete(spark, f"{path}/{gone}")
    return result


def read_parts(spark: SparkSession, path: str, schema: StructType, fmt: str = "json", parts: list | None = None) -> DataFrame:
    """The table that the newest manifest names; `parts`: only these values, whose folders alone are opened."""
    found = manifest(spark, path.rstrip("/"))[1]
    wanted = set(found) if parts is None else {"null" if p is None else f"={p}" for p in parts}
    folders = [f"{path.rstrip('/')}/{m['folder']}" for p, m in sorted(found.items()) if p in wanted]
    return spark.read.schema(schema).format(fmt).load(folders) if folders else spark.createDataFrame([], schema)
