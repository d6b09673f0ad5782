import itertools
import random

import corpus_pipeline
from archivolt.llm.minhash import similar_groups


def grams(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_groups(docs, least=0.8):
    """{doc_id: smallest id reachable over pairs of 5-word Jaccard similarity `least`}, compared pair by pair."""
    sets, root = {i: grams(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        shared, total = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if (not total) or shared >= least * total:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in docs}


def edited(words, changes, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), changes):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def test_stage_finds_copies_at_the_similarity_of_the_contract(spark, sf_dir):
    rng, docs = random.Random(3), {}
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for changes in (0, 2, 4, 6, 9, 15):
            docs[len(docs)] = " ".join(edited(base, changes, rng))
    cloud = [f"c{rng.randrange(5000)}" for _ in range(300)]
    for _ in range(90):  # near copies of one text, many of them under 0.8 to one another
        docs[len(docs)] = " ".join(edited(cloud, rng.randrange(8), rng))
    for text in ("", " \n", None, "one two", "One  two", "one two three"):
        docs[len(docs)] = text
    want = brute_groups(docs)
    assert len(set(want.values())) < len(docs) - 100
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in similar_groups(rows).collect()} == want
    kept = corpus_pipeline.simhash_near_dedup(spark, rows, sf_dir).collect()
    assert {r.doc_id for r in kept} == {i for i, g in want.items() if g == i}


def test_documents_match_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_groups(docs)


def test_null_and_repeated_ids(spark):
    schema = "doc_id bigint, text string"
    rows = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "x y z"), (9, "A b c")], schema)
    got = sorted(((r.doc_id, r.component_id) for r in similar_groups(rows).collect()), key=str)
    assert got == [(4, 4), (4, 4), (9, 4), (None, 4)]
    assert similar_groups(rows.limit(0)).collect() == []
