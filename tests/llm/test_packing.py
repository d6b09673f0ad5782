import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from archivolt.llm import byte_bpe, packing
from archivolt.llm.packing import SEQUENCE_COST, VOCABULARY, best_cuts, op4_packing, pack, split_tail


def test_query_is_a_packing_of_the_library_ids(spark, sf_dir):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    whole = {i: [*e.ids, 1] for i, e in zip(docs, tokenizer.encode_batch(list(docs.values()), add_special_tokens=False))}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in op4_packing(spark, sf_dir).collect():
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in whole.items():
        at = 0
        for start, length in sorted(covered[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * sum(map(len, whole.values()))


def test_added_token_within_texts(spark):
    end = "<|endoftext|>"
    texts = {1: f"a {end} b", 2: end + end, 3: f"words before{end}", 4: f"{end}words after"}
    got = {}
    for r in sorted(pack(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u4").tolist())
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}


def brute_cost(places, costs, window):
    best = {0: 0.0}
    for j, cost in zip(places, costs):
        best[j] = min(
            best[i] + cost + SEQUENCE_COST + (0 if (j - i) & (j - i - 1) == 0 else window - (j - i))
            for i in best if 0 < j - i <= window
        )
    return best[places[-1]]


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for window in (16, 32):
        for _ in range(40):
            places = np.cumsum(rng.integers(1, 9, 60))
            costs = rng.integers(0, 4, 60).astype(float)
            price = dict(zip(places.tolist(), costs))
            cuts = best_cuts(places, costs, window)
            total, at = 0.0, 0
            for j in cuts:
                n = j - at
                assert 0 < n <= window
                total += price[j] + SEQUENCE_COST + (0 if n & (n - 1) == 0 else window - n)
                at = j
            assert at == places[-1] and total == brute_cost(places.tolist(), costs, window)


def test_tail_in_powers_of_two():
    assert split_tail([2048, 2048 + 1024 + 3]) == [2048, 3072, 3074, 3075]
    assert split_tail([2047]) == [2047]


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "x", 2), (3, "y" * 50_000, 3), (3, "z " * 9000, 4), (3, "é" * 20, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, offset int").coalesce(1)
    got = pack(docs).collect()
    assert [(r.doc_id, r.length) for r in got[:2]] == [(1, 1), (2, 1)]
    assert max(r.offset + r.length for r in got) <= 2048
    assert pack(docs.limit(0)).collect() == []


def test_worker_holds_no_more_than_packing_needs():
    """The library merges new words, so the table of merges isn't made; and what is encoded at once is bounded by ENCODED, which
    changes no id."""
    own = byte_bpe.codec.__wrapped__(VOCABULARY, True)
    words = " ".join(f"w{k % 997}x{k}" for k in range(3000))
    bodies = pa.array([f"{words} {n}".encode() for n in range(80)], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(80)), bodies], ["doc_id", "body"])
    parts = list(byte_bpe.blocks(batch, size=packing.ENCODED))
    assert len(parts) > 1 and all(p.num_rows == 1 or sum(map(len, p.column("body").to_pylist())) <= 1 << 20 for p in parts)
    whole = own.encode(bodies)
    pieces = [own.encode(p.column("body")) for p in parts]
    assert all((np.concatenate(got) == want).all() for got, want in zip(zip(*pieces), whole))
    assert "merged" not in vars(own.replay)


def test_words_of_a_block_are_looked_up_once():
    """A block's distinct words cost one look each, so op4 encodes more at once than the pipeline; the pieces are the same."""
    own = byte_bpe.codec.__wrapped__(VOCABULARY, True)
    looks = []

    class Known(dict):
        def get(self, word):
            looks.append(word)
            return super().get(word)

        def __contains__(self, word):
            looks.append(word)
            return super().__contains__(word)

        def __getitem__(self, word):
            looks.append(word)
            return super().__getitem__(word)

    own.known = Known()
    own.encode(pa.array([b"one two three two", b"three two"], pa.binary()))
    assert sorted(looks) == [b" three", b" two", b"one", b"three"]


def test_pieces_are_the_same_for_any_block(spark):
    docs = spark.createDataFrame([(k, f"row {k}, " * (k % 90)) for k in range(300)], "doc_id bigint, text string").coalesce(1)
    assert pack(docs, encoded=500).collect() == pack(docs, encoded=4 << 20).collect()
