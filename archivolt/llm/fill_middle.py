"""Fill-in-middle: a Split pre-tokenizer's code-point offsets say where prefix, middle and suffix end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from archivolt.llm.common import table, texts

#: A unit of text: a line with its end. A unit never goes on after a line feed.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that the pre-tokenizer takes at once; longer texts are handed over in blocks that end after a line feed.
BLOCK = 1 << 20

_ROW = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
     T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
)


def offsets(text: str, split: Split, block: int = BLOCK) -> list[int]:
    """0 and the code-point offset at which each unit ends. The last is the length of the text."""
    ends, at = [0], 0
    while at < len(text):
        to = len(text)
        if to - at > block:
            to = (text.find("\n", at + block - 1) + 1) or to
        ends += [at + end for _, (_, end) in split.pre_tokenize_str(text[at:to] if (at, to) != (0, len(text)) else text)]
        at = to
    return ends


def draws(seed: str, doc_id: str) -> tuple[int, ...]:
    """Four numbers of 32 bits from the hash of the seed and the id."""
    found = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return tuple(int(found[k : k + 8], 16) for k in range(0, 32, 8))


def arrange(text: str, doc_id: str, split: Split, seed: str, rate: int, spm: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    ends = offsets(text, split)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(
    docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50, units: str = LINES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text.

    Two of the n + 1 ends of units, drawn by a hash of the seed and the id, part a text in prefix, middle and suffix.
    form: `psm` or `spm` (of `spm` in a hundred texts) by the order of the parts in `output`; `plain`, with the text itself
    as output and null counts, for empty texts, for texts that hold a sentinel, and for all but `rate` in a hundred others.
    units: a regular expression whose matches cover a text and never reach over a line feed.

    Rows are independent: one scan without exchange, and a lost task is run again with the same draws. A null text is
    empty; a null id draws as the empty string; repeated rows come out alike; an empty table gives an empty one; other columns
    are left out. Memory is bounded by Arrow's batch, or the longest text.
    """
    # The pre-tokenizer is made in the worker, as are all objects of its library.
    @F.arrow_udf(_ROW)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        split = Split(Regex(units), "isolated")
        kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for ids, bodies in batches:
            rows = [arrange(t.as_py(), i.as_py() or "", split, seed, rate, spm) for i, t in zip(ids, bodies)]
            yield pa.array([dict(zip(_ROW.names, r)) for r in rows], kind)

    body = texts(docs, id_col, text_col)
    return body.select("doc_id", run(F.col("doc_id").cast("string"), F.col("text")).alias("r")).select("doc_id", "r.*")


def _after(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def restored(form: Column, output: Column) -> Column:
    """The text again, from form and output. Each sentinel stands once in an output that isn't plain."""
    of = lambda mark, until: F.substring_index(_after(output, mark), until, 1)
    middle = _after(output, MIDDLE)
    return (
        F.when(form == "psm", F.concat(of(PREFIX, SUFFIX), middle, of(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(of(PREFIX, MIDDLE), middle, of(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
