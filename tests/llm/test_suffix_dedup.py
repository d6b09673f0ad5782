import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from archivolt.llm import suffix_dedup
from archivolt.llm.common import settings
from archivolt.llm.suffix_dedup import anchors, decode_run, front_code, merge_runs, op2_suffix_array_dedup, remove_repeats, repeated_passages


def brute(texts, length):
    """[(n_bytes, n_removed, n_spans, kept, stretches)] by counting every window."""
    bodies = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False)).tolist()
        out.append((len(b), len(b) - len(kept), len(edges) // 2, kept, [b[x:y] for x, y in zip(edges[::2], edges[1::2])]))
    return out


def made(seed):
    """Texts of a small alphabet with shared passages of many lengths, runs, copies and edits."""
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abé ", k=n))
    passages = [word(rng.randint(15, 70)) for _ in range(5)]
    texts = [None, "", "a" * 90, "ab" * 40, "a" * 25]
    for _ in range(25):
        texts.append("".join(rng.choice([word(rng.randint(0, 40)), rng.choice(passages)]) for _ in range(rng.randint(1, 5))))
    for _ in range(8):
        t = list(rng.choice(texts[5:]))
        if t:
            t[rng.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize(("seed", "split_over", "entries"), [(1, 5000, 20_000), (2, 1, 20_000), (3, 5000, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, split_over, entries):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ENTRIES", entries)
    texts = made(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: (*r[1:4], bytes(r.kept)) for r in remove_repeats(docs, 20, 6, split_over=split_over).collect()}
    assert got == {i: w[:4] for i, w in enumerate(brute(texts, 20))}


def test_passages_match_brute_force(spark):
    texts = made(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_passages, r.n_passage_words) for r in repeated_passages(docs, 12, 6, 2).collect()}
    counts = [[n for n in (len(x.split()) for x in w[4]) if n >= 2] for w in brute(texts, 12)]
    assert got == {i: (len(c), sum(c)) for i, c in enumerate(counts)}


def brute_words(texts, words):
    """[(n_passages, n_passage_words)] by counting every window of words."""
    found = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(f[i : i + words]) for f in found for i in range(len(f) - words + 1))
    out = []
    for f in found:
        gone = np.zeros(len(f), bool)
        for i in range(len(f) - words + 1):
            if count[tuple(f[i : i + words])] > 1:
                gone[i : i + words] = True
        out.append((int(np.diff(gone, prepend=False).astype(int)[gone].sum()), int(gone.sum())))
    return out


@pytest.mark.parametrize(("seed", "words", "split_over", "entries", "long"), [(7, 9, 5000, 20_000, 64), (8, 6, 1, 20_000, 64), (9, 2, 5000, 3, 4)])
def test_passages_of_words_match_brute_force(spark, monkeypatch, seed, words, split_over, entries, long):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ENTRIES", entries)
    monkeypatch.setattr(suffix_dedup, "LONG_WORD", long)
    rng = random.Random(seed)
    texts = [*made(seed), "\x1f".join(["a b"] * 9), "word\t" * 40, *(" ".join(rng.choices(["a", "b", "ab", "é"], k=40)) for _ in range(12))]
    texts += ["\n ".join(t.split(" ")) for t in texts[-4:]]  # other blanks between the same words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    rows = remove_repeats(docs, 20, 6, split_over=split_over, words=words).collect()
    assert {r.doc_id: (*r[1:4], bytes(r.kept)) for r in rows} == {i: w[:4] for i, w in enumerate(brute(texts, 20))}
    want = dict(enumerate(brute_words(texts, words)))
    assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in rows} == want and len(set(want.values())) > 5


def test_query_tells_passages_of_fifty_words_from_the_rest(spark, tmp_path):
    """Passages of fewer bytes than the contract's 400, and than any window of bytes that is looked for."""
    rng = random.Random(11)
    text = lambda n, size: " ".join("".join(rng.choices("abcdefgh", k=size)) for _ in range(n))
    short, longer = text(51, 3), text(55, 5)
    assert len(short) < 210 and 300 < len(longer) < 400
    rows = [(1, f"{text(40, 5)} {short} {text(30, 5)}"), (2, f"{text(9, 4)} {short}"), (3, text(200, 5)), (4, longer), (5, f"{longer} {text(60, 5)}")]
    spark.createDataFrame([*rows, (6, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_words) for r in op2_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1, 51), 2: (0, 1, 51), 3: (0, 0, 0), 4: (0, 1, 55), 5: (0, 1, 55), 6: (0, 0, 0)}


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in rows], 400)
    got = {r.doc_id: (*r[1:4], r.kept_sha256) for r in op2_suffix_array_dedup(spark, sf_dir).collect()}
    assert got == {r.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for r, w in zip(rows, want)}


def test_everything_removed_comes_from_the_merged_runs(spark, monkeypatch):
    """Copies too: two places of a context meet in the merge, and their bytes decide."""
    docs = spark.createDataFrame([(k, "passage " * 20) for k in range(3)], "doc_id bigint, text string")
    assert {r.n_removed for r in remove_repeats(docs, 20, 6).collect()} == {160}
    monkeypatch.setattr(suffix_dedup, "_merged", lambda pdf, *sizes: pd.DataFrame({c.split()[0]: [] for c in suffix_dedup._FOUND.split(", ")}))
    assert {r.n_removed for r in remove_repeats(docs, 20, 6).collect()} == {0}


def test_one_of_many_copies_stands_for_the_rest():
    word = lambda n, seed: bytes(random.Random(seed).choices(b"ab", k=n))
    same = (b"gram" + word(8, 1), word(8, 2), 7, 0)
    half = (b"gram" + word(8, 1), b"z" * 8, 7, 1)
    other = (b"tram" + word(8, 1), word(8, 2), 8, 2)
    merged = list(merge_runs([decode_run(front_code(sorted(r))) for r in ([same, half], [same], [same, other])]))
    least, most = suffix_dedup.shared_windows(merged, 4, 12)
    found = {(e[3], lo, hi) for (_, e), lo, hi in zip(merged, least.tolist(), most.tolist())}
    assert found == {(0, -2, -1), (1, 0, 0), (2, -2, -2)}


def test_a_passage_of_fifty_words_under_the_length_is_reported_and_stays(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    passage = text(60)
    rows = [(1, f"{text(40)} {passage} {text(30)}"), (2, f"{text(10)} {passage}"), (3, text(90))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert 300 < len(passage) < 400
    assert {r.n_removed for r in remove_repeats(docs).collect()} == {0}
    got = {r.doc_id: (r.n_passages, r.n_passage_words >= 60) for r in repeated_passages(docs).collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (0, False)}


def test_anchors_fall_alike_in_equal_windows():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2100] = data[100:200]
    ends = np.array([5, 900, 900, 3000])
    places, _ = anchors(data, ends, 60, 30)
    chosen = set(places.tolist())
    for begin, end in zip([0, 5, 900, 900], ends):
        for i in range(begin, end - 60 + 1):
            assert chosen & set(range(i, i + 31))
    assert {p - 100 for p in chosen if 130 <= p <= 140} == {p - 2000 for p in chosen if 2030 <= p <= 2040}


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)
    entries = [(bytes(8) + bytes(rng.choices(b"ab", k=rng.randint(0, 12))), b"x" * rng.randint(0, 3), -i, i) for i in range(300)]
    for k in (1, 3, 8):
        runs = [sorted(entries[i::k]) for i in range(k)]
        coded = [front_code(r) for r in runs]
        assert [[e for _, e in decode_run(c)] for c in coded] == runs
        merged = list(merge_runs([decode_run(c) for c in coded]))
        keys = [e[0] for _, e in merged]
        assert keys == sorted(e[0] for e in entries) and {e[3] for _, e in merged} == set(range(300))
        for (_, a), (h, b) in zip(merged, merged[1:]):
            assert h == suffix_dedup.common_prefix(a[0], b[0])


def test_chunks_never_part_a_gram():
    rng = random.Random(6)
    keys = sorted(bytes(rng.choices(b"ab", k=12)) for _ in range(200))
    entries = [(k, bytes(rng.choices(b"ab", k=rng.randint(0, 8))), 0, i) for i, k in enumerate(keys)]
    merged = list(merge_runs([decode_run(front_code(entries[i::5])) for i in range(5)]))
    whole = list(suffix_dedup.in_groups(iter(merged), 4, 10**6))
    parts = list(suffix_dedup.in_groups(iter(merged), 4, 3))
    assert len(whole) == 1 and len(parts) > 5 and [e for p in parts for e in p] == merged
    want = suffix_dedup.shared_windows(whole[0], 4, 12)
    got = [suffix_dedup.shared_windows(p, 4, 12) for p in parts]
    assert all((np.concatenate(g) == w).all() for g, w in zip(zip(*got), want))
    assert (want[1] >= 0).any() and (want[1] == -2).any()


def test_edges(spark):
    long = "".join(random.Random(9).choices("abcdef ", k=1000))
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 1), (None, "x" + long[:300], 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept int")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1000, 1), (3, 1000, 1)]
    assert remove_repeats(docs.limit(0)).collect() == [] and repeated_passages(docs.limit(0)).collect() == []
    got = sorted((r.doc_id or 0, r.n_passages) for r in repeated_passages(docs, words=1).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]


def test_texts_are_moved_once(spark):
    docs = spark.createDataFrame([(k, "some words " * 60 + str(k)) for k in range(9)], "doc_id bigint, text string")
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # as for large tables
        plan = remove_repeats(docs, 20, 6, words=5)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(row") == 1  # that of the answers
