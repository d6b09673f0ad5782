import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd

from archivolt.llm import statistics
from archivolt.llm.boosting import fit
from archivolt.llm.quality_classifier import classify, op9_quality_classifier
from archivolt.llm.quality_rules import judge, op10_quality_rules
from archivolt.llm.statistics import repeat_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_rules_counts_match_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op10_quality_rules(spark, sf_dir).collect()
    assert {(r.doc_id, *r[1:7]) for r in got} == {(i, *brute_counts(t)) for i, t in texts.items()}
    assert not any(r.kept for r in got if r.base_failed)


def test_long_texts_count_the_same(monkeypatch):
    words = [b"w%d" % (i * i % 37) for i in range(400)] + [b"a"] * 30
    few = repeat_words(words)
    monkeypatch.setattr(statistics, "_LARGE", 0)
    assert repeat_words(words) == few > 0
    assert repeat_words([b"a"] * 4) == 0


def brute_features(text):
    """The models' statistics, counted one by one."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, dup, repeats, _ = brute_counts(text)
    w, c = max(n, 1), max(chars, 1)
    of = lambda marks: sum(x in marks for x in text)
    return [
        symbols / w, dup / max(len(lines), 1), repeats / w, sum(a == b for a, b in zip(words, words[1:])) / w, of("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c,
        of("!") / w, of("|") / w, len(set(words)) / w, c / w, of("0123456789") / c, of(".") / w, of(",") / w, float(np.log1p(n)),
        n / max(len(lines), 1), of('"=') / w,
    ]


def walk(forest, row):
    """The probability of one row, by a walk down every tree."""
    total = forest.base
    for at in forest.roots:
        while forest.left[at] != at:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return 1 / (1 + np.exp(-total))


def test_scores_match_a_walk_of_every_tree(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: brute_features(r.text) for r in docs.collect()}
    forest = statistics.train(docs, labels)
    got = {r.doc_id: r.score for r in op9_quality_classifier(spark, sf_dir).collect()}
    assert set(got) == set(rows) and all(abs(got[i] - walk(forest, x)) < 1e-9 for i, x in rows.items())
    sense = {statistics.FEATURES.index(name): -1 for name in statistics.DECREASING}
    forest = statistics.train(docs, labels, monotone=sense)
    for r in op10_quality_rules(spark, sf_dir).collect():
        assert r.kept == (not r.base_failed and bool(walk(forest, rows[r.doc_id]) >= 0.5))
    for f, name in enumerate(statistics.FEATURES):
        if name in statistics.DECREASING:  # more of it never makes a document better
            for x in list(rows.values())[:40]:
                more = [*x[:f], x[f] + 0.1, *x[f + 1 :]]
                assert walk(forest, more) <= walk(forest, x) + 1e-12


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    got = op9_quality_classifier(spark, sf_dir).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    assert len(both) > 20 and (both.predicted == both.quality).mean() >= 0.95


def test_monotone_constraint_holds():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.random(800) < 0.6).astype(int)
    forest = fit(x, y, monotone={0: -1})
    line = np.stack([np.linspace(0, 1, 200), np.full(200, 0.5), np.full(200, 0.5)], axis=1)
    assert (np.diff(forest.margin(line)) <= 1e-12).all()
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.85


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 8), (None, "one two " * 20, 7), (4, "x" * 100_000, 6), (4, "x" * 100_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    labels = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id bigint, quality int")
    scored = classify(docs, labels).collect()
    assert len(scored) == 5 and {r.score for r in scored} == {0.5}
    judged = judge(docs, labels).toPandas()
    assert not judged.kept.any() and judged.base_failed.all() and "text" in judged
    assert classify(docs.limit(0), labels.limit(0)).collect() == judge(docs.limit(0), labels).collect() == []


def test_empty_frames():
    assert isinstance(statistics.measure(b""), tuple) and pd.DataFrame([statistics.measure(b"")[1]]).notna().all().all()
