"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.statistics import held_out, scorer, train
from archivolt.llm.common import table


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 8000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: quality 1 likelier), predicted.

    The model learns from at most `max_rows` labelled rows whose crc32(doc_id as text) mod 4 isn't 2. Scoring is one
    scan without any exchange: the flattened trees travel with the task. A null text is scored as an empty one; a null
    doc_id keeps its row and isn't held out. Labels that are null or whose document is missing teach nothing; without
    labels every score is 0.5. Repeated rows are scored alike. An empty table gives an empty one. A long text is measured
    whole, in memory of a few times its size.
    """
    score = scorer(train(docs, labels, max_rows))
    return (
        docs.select("doc_id", score(F.col("text")).alias("s"))
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("s.score").alias("score"))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    )
