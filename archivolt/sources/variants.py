"""Records whose fields change their names or types: kept whole as variants, read by paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opened(df: DataFrame, text: str, name: str = "record") -> DataFrame:
    """`df` with its JSON text as a variant: nothing is lost that a schema would not name. Text that is no JSON gives null."""
    return df.withColumn(name, F.try_parse_json(F.col(text)))


def field(record: str | Column, kind: str, *paths: str) -> Column:
    """The first of some paths that holds a value of a kind: a field's spellings, in order. Other types are cast where that
    can be; null where it can't."""
    col = F.col(record) if isinstance(record, str) else record
    return F.coalesce(*(F.try_variant_get(col, p, kind) for p in paths))


def unseen_fields(df: DataFrame, record: str, known: list[str]) -> DataFrame:
    """(field, kind, n): the fields of records that no reader knows, with the types they come in. Records that are no objects
    have no fields."""
    objects = df.select(F.when(F.schema_of_variant(F.col(record)).startswith("OBJECT"), F.col(record)).alias("whole"))
    each = objects.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("whole").outer())).where(~F.col("key").isin(list(known)))
    kind = F.substring_index(F.schema_of_variant("value"), "<", 1)
    return each.groupBy(F.col("key").alias("field"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
