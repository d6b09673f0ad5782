"""Statistics of whole documents, from their UTF-8 bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archivolt.llm.boosting import Forest, constant, fit

SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_LARGE = 50_000

#: Ratios that the models see; never an id, a source, a language or a label.
FEATURES = (
    "symbol_ratio", "dup_line_ratio", "repeat_ratio", "same_word_ratio", "upper_ratio", "shout_ratio", "bar_ratio",
    "distinct_ratio", "word_length", "digit_ratio", "stop_ratio", "comma_ratio", "log_words", "line_words", "quote_ratio",
)
#: More of any of these never makes a document better.
DECREASING = ("symbol_ratio", "dup_line_ratio", "repeat_ratio", "same_word_ratio", "shout_ratio", "bar_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of `window` words found twice or more, its first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n <= _LARGE:
        grams = list(zip(*(words[i:] for i in range(window))))
        if len(set(grams)) == n:
            return 0
        count = Counter(grams)
        again = np.fromiter((count[g] > 1 for g in grams), bool, n)
    else:  # dense numbers instead of tuples: 8 bytes a word
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        gram = ids[:n]
        for i in range(1, window):
            pair = gram * len(words) + ids[i : i + n]
            gram, count = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        again = count[gram] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window : n + window] -= again
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a text."""
    words = text.split()
    n = len(words)
    bare = text.translate(None, _BLANKS)
    chars = len(bare.translate(None, _CONTINUED))
    symbols = len(bare) - len(bare.translate(None, SYMBOLS))
    lines, seen, dup, filled = text.split(b"\n"), set(), 0, 0
    for line in lines:
        if line.strip(_BLANKS):
            filled += 1
            dup += line in seen
        seen.add(line)
    repeats = repeat_words(words)
    c, w = max(chars, 1), max(n, 1)
    small = lambda set_: len(bare) - len(bare.translate(None, set_))
    features = [
        symbols / w,
        dup / max(filled, 1),
        repeats / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        small(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c,
        bare.count(b"!") / w,
        bare.count(b"|") / w,
        len(set(words)) / w,
        c / w,
        small(b"0123456789") / c,
        bare.count(b".") / w,
        bare.count(b",") / w,
        float(np.log1p(n)),
        n / max(filled, 1),
        (bare.count(b'"') + bare.count(b"=")) / w,
    ]
    return [n, chars, symbols, dup, repeats], features


_COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField("score", T.DoubleType())])
_FEATURE_TYPE = T.ArrayType(T.DoubleType())


@F.pandas_udf(_FEATURE_TYPE)
def features_of(bodies: pd.Series) -> pd.Series:
    return pd.Series([measure(b)[1] for b in bodies], dtype=object)


def scorer(forest: Forest):
    """A column function: the counts and the forest's score of a text column."""

    @F.pandas_udf(_COUNT_TYPE)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for bodies in batches:
            both = [measure(b) for b in bodies]
            out = pd.DataFrame([c for c, _ in both], columns=list(COUNTS), dtype="int64")
            x = np.array([f for _, f in both]).reshape(-1, len(FEATURES))
            yield out.assign(score=forest.probability(x) if len(x) else np.zeros(0))

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, monotone: dict[int, int] | None = None, **fit_args) -> Forest:
    """A forest for labels.quality from at most `max_rows` labelled documents that aren't held out.

    The rows are those with the least XXH64 of the id, so they don't depend on the layout; `max_rows` bounds the
    broadcast and what reaches the driver (len(FEATURES) doubles a row; one row for an id that repeats). Without any labelled row the score is 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", F.struct("quality", features_of(body).alias("x")).alias("row"))
        .groupBy("doc_id")
        .agg(F.min("row").alias("row"))
        .select("doc_id", "row.*")
        .toPandas()
        .sort_values("doc_id")
    )
    if rows.empty:
        return constant(0.5)
    return fit(np.stack(rows.x), rows.quality.to_numpy() == 1, monotone=monotone, **fit_args)
