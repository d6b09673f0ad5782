"""Toxicity: disguised words are restored through a noisy channel, then the restored words are scored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.boosting import Forest, constant, fit
from archivolt.llm.common import drop_stored, stored, table
from archivolt.llm.noisy_channel import WORD, Decoder, gram_counts, language_model
from archivolt.llm.statistics import held_out

#: A word's terms: itself between ^ and $, and ^ with its first letters.
SHORTEST, LONGEST = 3, 10
FOLDS = 3
#: Standard errors taken off a term's log odds, and what must be left.
CAUTION, LEAST = 1.5, 0.7
FEATURES = ("log_words", "log_hits", "hit_ratio", "log_distinct", "log_sum", "highest", "second", "strong_ratio")


def terms_of(word: str) -> list[str]:
    return [f"^{word}$", *(f"^{word[:k]}" for k in range(SHORTEST, min(len(word), LONGEST) + 1))]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """How much likelier documents with a term are toxic, with CAUTION for rare terms."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds - CAUTION * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


class Scorer:
    """Numbers of a text for one lexicon (term -> weight): a word weighs as much as the heaviest of its terms."""

    def __init__(self, weights: dict[str, float], decoder: Decoder | None = None, remembered: int = 8_000_000):
        self.weights, self.decoder, self.remembered, self.held = weights, decoder, remembered, 0
        self.known: dict[str, tuple[int, list[tuple[str, float]]]] = {}

    def weigh(self, token: str) -> tuple[int, list[tuple[str, float]]]:
        """(words, those that weigh something) of a token."""
        found = self.known.get(token)
        if found is None:
            words = WORD.findall(self.decoder.token(token) if self.decoder else token)
            heavy = [(w, max(self.weights.get(t, 0.0) for t in terms_of(w))) for w in words]
            found = len(words), [x for x in heavy if x[1] > 0]
            if self.held > self.remembered:
                self.known.clear()
                self.held = 0
            if len(token) <= 128:
                self.known[token] = found
                self.held += len(token)
        return found

    def numbers(self, text: str) -> list[float]:
        """FEATURES of a text (with a decoder: one that isn't restored yet)."""
        n, hits, weight = 0, Counter(), {}
        for token, times in Counter((self.decoder.spaced(text) if self.decoder else text).split()).items():
            words, heavy = self.weigh(token)
            n += times * words
            for w, x in heavy:
                hits[w] += times
                weight[w] = x
        total = sum(hits.values())
        high = sorted(weight.values(), reverse=True)[:2] + [0.0, 0.0]
        strong = sum(k for w, k in hits.items() if weight[w] >= 2)
        return [
            float(np.log1p(n)), float(np.log1p(total)), total / max(n, 1), float(np.log1p(len(hits))),
            float(np.log1p(sum(k * weight[w] for w, k in hits.items()))), high[0], high[1], strong / max(n, 1),
        ]


def restore(docs: DataFrame, costs: np.ndarray) -> DataFrame:
    """`docs` with its whole texts restored: a column `restored` (lower case, blanks single, line feeds kept)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(costs)
        for texts in batches:
            yield texts.map(decoder.restore)

    return docs.withColumn("restored", run(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _sample(docs: DataFrame, labels: DataFrame, costs: np.ndarray, max_rows: int) -> DataFrame:
    """(toxic, fold, restored) of at most `max_rows` labelled documents that aren't held out; one row for an id that repeats."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("r"))
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("fold")), F.lit(FOLDS)).cast("int")
    return stored(restore(one.select((F.col("r.toxic") == 1).alias("toxic"), fold.alias("fold"), "r.text"), costs).drop("text"), "restored")


def _lexicons(sample: DataFrame, max_terms: int) -> list[dict[str, float]]:
    """FOLDS lexicons, each learned without one fold, and last the one learned from all."""
    names = [f"{kind}{k}" for k in range(FOLDS) for kind in ("clean", "toxic")]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for toxic, fold, text in zip(batch.toxic, batch.fold, batch.restored):
                for term in {t for w in set(WORD.findall(text)) for t in terms_of(w)}:
                    seen.setdefault(term, [0] * len(names))[2 * fold + toxic] += 1
            yield pd.DataFrame([(t, *c) for t, c in seen.items()], columns=["term", *names])

    counts = sample.mapInPandas(count, "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term")
    counts = counts.agg(*(F.sum(c).alias(c) for c in names))
    toxic = sum((F.col(f"toxic{k}") for k in range(FOLDS)), F.lit(0))
    clean = sum((F.col(f"clean{k}") for k in range(FOLDS)), F.lit(0))
    n = {(r.toxic, r.fold): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()}
    of = lambda kind, k: sum(c for (t, fold), c in n.items() if t == kind and fold != k)
    odds = F.log((toxic + 0.5) / (of(True, None) + 1)) - F.log((clean + 0.5) / (of(False, None) + 1))
    odds = odds - CAUTION * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    # A fold's own lexicon may hold terms that the other folds make less likely, so terms are chosen a little below LEAST.
    rows = counts.where((toxic >= 3) & (odds > LEAST - 0.5)).orderBy(odds.desc(), "term").limit(max_terms).toPandas()
    out = []
    for k in [*range(FOLDS), None]:
        t, c = (sum((rows[f"{kind}{j}"].to_numpy(float) for j in range(FOLDS) if j != k), np.zeros(len(rows))) for kind in ("toxic", "clean"))
        weight = log_odds(t, c, of(True, k), of(False, k))
        out.append({term: float(w) for term, w, x in zip(rows.term, weight, t) if w > LEAST and x >= 3})
    return out


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray, max_rows: int = 8000, max_terms: int = 20_000) -> tuple[dict[str, float], Forest]:
    """The lexicon and the trees over FEATURES. Trees learn from numbers that come of lexicons without the document's fold.
    `max_rows` bounds the sample, `max_terms` what of it reaches the driver besides FEATURES."""
    sample = _sample(docs, labels, costs, max_rows)
    lexicons = _lexicons(sample, max_terms)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorers = [Scorer(w) for w in lexicons[:FOLDS]]
        for batch in batches:
            x = [scorers[fold].numbers(text) for fold, text in zip(batch.fold, batch.restored)]
            yield pd.DataFrame(x, columns=list(FEATURES)).assign(toxic=batch.toxic.to_numpy())

    rows = sample.mapInPandas(measure, ", ".join(f"{c} double" for c in FEATURES) + ", toxic boolean").toPandas()
    drop_stored(sample)
    if rows.empty:
        return {}, constant(0.5)
    rows = rows.sort_values([*FEATURES, "toxic"])  # whatever order they came in
    return lexicons[-1], fit(rows[list(FEATURES)].to_numpy(), rows.toxic.to_numpy(), trees=40, depth=3)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 8000, max_terms: int = 20_000) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted.

    A language model of symbols is counted over all whole texts. The noisy channel (see `noisy_channel`) restores words in
    leetspeak, with marks or blanks between their letters, and with letters repeated. Words and beginnings of words that are
    commoner in toxic documents, and trees over how many of them a restored text has, are learned from at most `max_rows`
    labelled rows, none held out. Scoring is one scan without any exchange. A null text is scored as an empty one; a
    null doc_id keeps its row and isn't held out; labels that are null or whose document is missing teach nothing;
    without labels every score is 0.5. Repeated rows are scored alike. An empty table gives an empty one; other columns are
    left out. A long text is read whole; memory follows its distinct tokens.
    """
    costs = language_model(gram_counts(docs))
    lexicon, forest = train(docs, labels, costs, max_rows, max_terms)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(lexicon, Decoder(costs, 2_000_000))
        for texts in batches:
            x = np.array([scorer.numbers(t) for t in texts]).reshape(-1, len(FEATURES))
            yield pd.Series(forest.probability(x) if len(x) else np.zeros(0))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), run(text).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
