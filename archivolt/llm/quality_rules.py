"""Quality rules: base counts, and boosted trees that are monotonic in the counts of junk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import table
from archivolt.llm.statistics import COUNTS, DECREASING, FEATURES, scorer, train


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 8000) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept added (columns of
    these names in `docs` are replaced).

    base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. kept: not base_failed,
    and the trees give at least `threshold`. The trees never score a document higher for more symbols, repeated lines,
    repeated words, shouting or bars. They learn from at most `max_rows` labelled rows. One scan, no exchange. A null
    or empty text has no words and fails; without labels the base rules decide alone. Repeated rows are judged alike. An empty
    table gives an empty one. A long text is measured whole, in memory of a few times its size.
    """
    sense = {FEATURES.index(name): -1 for name in DECREASING}
    score = scorer(train(docs, labels, max_rows, monotone=sense))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    with_counts = docs.withColumn("__s", score(F.col("text"))).withColumns({c: F.col(f"__s.{c}") for c in COUNTS})
    return with_counts.withColumns(
        {"base_failed": failed, "kept": ~failed & (F.col("__s.score") >= threshold)}
    ).drop("__s")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).drop("text")
