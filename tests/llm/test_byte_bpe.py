import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from archivolt.llm import byte_bpe
from archivolt.llm.byte_bpe import RANKS, codec, decode, op8_byte_bpe, round_trip


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec(RANKS).replay.ranks, special_tokens={})


def ids_of(texts, own):
    ids, counts = own.encode(pa.array([t.encode() for t in texts], pa.binary()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])], ids, counts


def test_matches_library_on_odd_texts(library):
    random.seed(7)
    alphabet = [*" \n\t'sStremvld09.,!é　 ñ½Ⅷ中\U0001f600\x1c\x85", "'ll", "'re", "'ve", "  ", " '"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(3000)]
    texts += ["", "a" * 3000, "'" * 50, " " * 40 + "x", "the cat's 'll we'll", "x" * 20_000]
    texts += ["ab0" * 4000]  # one long word that has to be redone would take hours by search
    for own in (codec(RANKS), codec(public_tokenizers.path("byte_bpe_50k.json"), True)):
        got, ids, counts = ids_of(texts, own)
        assert got == [library.encode_ordinary(t) for t in texts]
        assert own.decode(ids, counts).to_pylist() == [t.encode() for t in texts]


def test_added_tokens_are_the_library_s(library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    end, own, tokenizer = "<|endoftext|>", codec(path, True), Tokenizer.from_file(path)
    texts = [f"a {end} b", end, end * 2, f" {end}", f"{end} ", f"it{end}'s  {end}  x", "<|endoftext |>", f"<{end}>", "", f"é{end}\n"]
    got, ids, counts = ids_of(texts, own)
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert own.decode(ids, counts).to_pylist() == [t.encode() for t in texts]
    plain = codec(RANKS)
    assert ids_of(texts, plain)[0] == [library.encode_ordinary(t) for t in texts]


def test_greedy_takes_no_square_of_a_word():
    word = bytes(np.random.default_rng(1).integers(97, 123, 60_000).astype(np.uint8))
    began = time.time()
    ids = codec(RANKS).replay.greedy(word)
    assert b"".join(codec(RANKS).pieces[i] for i in ids) == word and time.time() - began < 10


def test_words_that_the_index_must_redo():
    ranks = {bytes([b]): b for b in range(256)}
    ranks |= {b"ab": 300, b"abc": 299, b"cd": 301, b"bcd": 256}  # ab is merged late, then abc outranks it
    replay = byte_bpe.MergeReplay(ranks)
    words = [b"abcd", b"abc", b"abab", b"aabcdabc", b"xyz"]
    assert replay.encode(words) == [replay.greedy(w) if w not in ranks else [ranks[w]] for w in words]


def test_replay_is_the_rule_for_any_ranks():
    """Random vocabularies, whose merges make pairs of lower and of equal rank, in any number of windows and with long words."""
    rng = random.Random(5)
    for _ in range(60):
        tokens = {bytes(rng.choices(b"abc", k=rng.randint(2, 6))) for _ in range(rng.randint(0, 60))}
        places = rng.sample(range(256, 256 + 4 * len(tokens)), len(tokens))
        ranks = {bytes([b]): b for b in range(256)} | dict(zip(sorted(tokens), places))
        words = [bytes(rng.choices(b"abc", k=rng.choice([1, 2, 3, 9, 40, byte_bpe.LONG, byte_bpe.LONG + 1, 300]))) for _ in range(60)] + [b"a" * 128, b"x"]
        replay = byte_bpe.MergeReplay(ranks)
        assert replay.encode(words) == [[ranks[w]] if w in ranks else replay.greedy(w) for w in words]
    assert byte_bpe.MergeReplay(ranks).encode([]) == []


def test_words_in_use_are_merged_once(monkeypatch):
    """A full memory lets go of the words that no longer come, not of those in use."""
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 40)
    own, asked = byte_bpe.Codec(codec(RANKS).replay.ranks), []
    replayed = own.replay.encode
    monkeypatch.setattr(own.replay, "encode", lambda words: asked.extend(words) or replayed(words))
    for k in range(30):
        text = "ever gofer quux " + " ".join(f"w{chr(97 + k % 26)}{j}" for j in "abcd")
        own.encode(pa.array([text.encode()], pa.binary()))
        assert len(own.known) + len(own.older) <= 40
    assert asked.count(b" gofer") == asked.count(b" quux") == 1 and len(asked) > 100


def test_small_blocks_and_memory(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 10)
    own = codec(RANKS)
    texts = ["some words here", "", "x" * 300, "more words, and more words", "é"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["body"])
    parts = list(byte_bpe.blocks(batch.slice(1)))
    assert sum(p.num_rows for p in parts) == 14 and len(parts) > 3
    got = []
    for part in parts:
        ids, counts = own.encode(part.column("body"))
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library.encode_ordinary(t) for t in texts[1:]]


def test_query_matches_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op8_byte_bpe(spark, sf_dir).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 1), (None, "a b", 2), (3, "rows", 3), (3, "rows", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    coded = round_trip(docs)
    got = {(r.doc_id, len(r.ids), bytes(r.decoded)) for r in coded.collect()}
    assert got == {(1, 0, b""), (2, 0, b""), (None, 2, b"a b"), (3, 1, b"rows")}
    assert {bytes(r.decoded) for r in decode(coded).collect()} == {b"", b"a b", b"rows"}
    assert round_trip(docs.limit(0)).collect() == []
