import itertools

import numpy as np
import pytest
import xxhash

from archivolt.llm.components import components
from archivolt.llm.simhash import fingerprint, links, near_duplicates, op1_simhash_near_dedup


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{doc_id: fingerprint} -> {doc_id: component_id}"""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_fingerprint_matches_brute_force():
    for text in ("", " \n\t", "One", "one TWO", "a b c", "A b C d E", "É été a\x0bb c d", "x y " * 50):
        assert fingerprint(text.encode()) % 2**64 == brute_fingerprint(text)


def test_query_matches_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    want = brute_components(prints)
    got = op1_simhash_near_dedup(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {
        (i, f"{prints[i]:016x}", want[i]) for i in prints
    }


@pytest.mark.parametrize("bucket_limit", [0, 3, 64])
def test_links_keep_components_at_any_bucket_limit(spark, bucket_limit):
    rng = np.random.default_rng(5)
    centres = [int(x) for x in rng.integers(0, 2**62, 6)]
    prints = {}
    for n in range(300):
        value = centres[n % 6]
        for bit in rng.integers(0, 64, int(rng.integers(0, 5))):
            value ^= 1 << int(bit)
        prints[n] = value
    signed = {v - (1 << 64 if v >> 63 else 0) for v in prints.values()}
    nodes = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = components(nodes.withColumnRenamed("fp", "node"), links(nodes, bucket_limit)).collect()
    label = {r.node % 2**64: r.label for r in got}
    want = brute_components(prints)
    for a, b in itertools.combinations(prints, 2):
        assert (label[prints[a]] == label[prints[b]]) == (want[a] == want[b])


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (4, "a b c d", "q"), (4, "a b c d", "q"), (None, "a b c d", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    got = sorted((r.doc_id or -1, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(-1, 4), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]
    assert near_duplicates(docs.limit(0)).collect() == []


def test_fingerprints_propose_pairs_where_a_similarity_decides(spark):
    """Equal and linked fingerprints are compared, by way of the least text of each."""
    from archivolt.llm import minhash

    base = " ".join(f"w{k % 977}x{k}" for k in range(3000))
    docs = [(1, base), (2, base + " end"), (3, "something else that has nothing in common with it"), (4, base.upper()), (5, None), (6, " ")]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    found = {r.doc_id: r.component_id for r in near_duplicates(rows, shingle=5, similarity="0.8").collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}
    fps = spark.createDataFrame([(minhash.xxh3_128_digest(bytes([k])), 9, fp) for k, fp in enumerate((0, 3, 3, 255))], "node binary, size bigint, fp bigint")
    node = {bytes(r.node): k for k, r in enumerate(fps.collect())}
    pairs = {frozenset((node[bytes(r.a)], node[bytes(r.b)])) for r in minhash._proposed(fps, links).collect()}
    assert frozenset((1, 2)) in pairs and len(pairs) == 2 and any(0 in p for p in pairs) and not any(3 in p for p in pairs)
