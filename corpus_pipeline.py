"""The corpus pipeline: quality rules, line dedup, near-dedup, PII redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm.common import stored, table
from archivolt.llm.line_dedup import drop_repeated_lines
from archivolt.llm.packing import pack
from archivolt.llm.pii import redact
from archivolt.llm.quality_rules import judge
from archivolt.llm.simhash import near_duplicates


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one struct, whose names can't clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("__rest"))


def _as_documents(result: DataFrame, docs: DataFrame) -> DataFrame:
    """`result` of packed documents in the columns of `docs`, with n_chars following the text."""
    out = result.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged. The trees learn from the labels of documents that are there. Null and empty texts
    have no words and go; null ids stay as others do; repeated rows stay or go together; no table gives none."""
    judged = judge(_packed(docs), table(spark, sf_dir, "labels", "doc_id", "quality")).where("kept")
    return judged.select(*(F.col(c) if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds; a document may end up empty. A null text becomes an empty one;
    repeated rows are one document; columns with an operator's names keep their values."""
    return _as_documents(drop_repeated_lines(_packed(docs)), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id,
    unchanged. Null ids stay; rows that repeat an id stay or go together; null and empty texts are one group. The three words and two bits of op1_ are that query's contract, not this stage's."""
    groups = near_duplicates(docs, shingle=5, similarity="0.8").where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in brackets. Null texts stay null; repeated rows come out alike."""
    return _as_documents(redact(_packed(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, a row for each piece; tokens holds its ids. A null or empty text is the one id that ends it; other
    columns are left out; no documents give no sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: The trees, SimHash and the span classifier have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
