import itertools
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from archivolt.llm.noisy_channel import BLANK, LETTERS, SYMBOLS, Decoder, gram_counts, language_model, lattice, symbols, viterbi
from archivolt.llm.toxicity import FEATURES, Scorer, op11_toxicity, restore, score, terms_of

BIG = "/root/testdata/sf0.1"


def brute_counts(texts):
    out = Counter()
    for t in texts:
        s = [BLANK, BLANK, *symbols(t or "").tolist(), BLANK]
        out.update(zip(s, s[1:], s[2:]))
    return out


@pytest.fixture(scope="module")
def costs(spark):
    words = "the idiot said that a stupid clown and a moron are pathetic trash well known to us this is an 4711 e-mail"
    docs = spark.createDataFrame([(words,)] * 20 + [("total losers, worthless scum",)] * 5, "text string")
    return language_model(gram_counts(docs))


def test_symbols():
    assert symbols("aB é\n7!Ж😀").tolist() == [1, 2, 0, LETTERS.index("é") + 1, 0, *(SYMBOLS - k for k in (2, 1, 3, 3))]


def test_counts_cover_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    got, want = gram_counts(docs), brute_counts(r.text for r in docs.collect())
    assert {tuple(map(int, k)): int(got[tuple(k)]) for k in np.argwhere(got)} == dict(want)
    long = "ab c" * 700_000  # more than a piece
    odd = spark.createDataFrame([(None,), ("",), (long,)], "text string")
    got = gram_counts(odd)
    assert {tuple(map(int, k)): int(got[tuple(k)]) for k in np.argwhere(got)} == dict(brute_counts([None, "", long]))
    model = language_model(gram_counts(odd.limit(0)))
    assert np.isfinite(model).all() and model.shape == (SYMBOLS,) * 3


def test_model_is_a_distribution(costs):
    total = np.exp(-costs.astype(float)).sum(-1)
    assert (total < 1 + 1e-3).all() and abs(total[BLANK, BLANK] - 1) < 1e-3


def exhaustive(token, costs):
    """The least cost over all readings."""
    found = []
    for choice in itertools.product(*lattice(token)):
        s = [BLANK, BLANK, *itertools.chain.from_iterable(c[0] for c in choice), BLANK]
        cost = sum(c[2] for c in choice) + sum(float(costs[x]) for x in zip(s, s[1:], s[2:]))
        found.append((cost, "".join(c[1] for c in choice)))
    return min(found)[0], found


def test_viterbi_finds_the_cheapest_reading(costs):
    rng = np.random.default_rng(3)
    tokens = ["1d10t", "i.d.i.o.t", "st00pid", "s t u p i d", "m0r0n!!", "$cum", "a", "", "4711", "+|(<"]
    tokens += ["".join(rng.choice(list("aeidot10!$.- 3ssttt"), 6)) for _ in range(60)]
    for token in tokens:
        best, readings = exhaustive(token, costs)
        got = viterbi(lattice(token), costs)
        assert min(c for c, text in readings if text == got) == pytest.approx(best, abs=1e-3)


def test_disguised_words_are_restored(costs):
    d = Decoder(costs)
    for written, meant in {
        "1d10t": "idiot", "i.d.i.o.t": "idiot", "i-d-i-o-t,": "idiot", "STUP1D!!": "stupid", "stuuuupid": "stupid", "m0r0n": "moron", "cl0wn": "clown",
        "tra$h": "trash", "p@th3tic": "pathetic", "w0rthl3ss": "worthless", "$cum": "scum", "that***": "that", "(clown)": "clown", "The": "the", "4711": "4711",
    }.items():
        assert d.token(written) == d.token(written) == meant
    assert d.restore("You i d i o t are\ns t u p i d  now") == "you idiot are\nstupid now"
    assert d.restore("") == "" and d.restore("\n\n") == "\n\n" and d.restore("***") == ""
    assert len(d.restore("x1" * 5000)) >= 5000  # decoded in pieces, whole


def test_remembered_tokens_are_bounded(costs):
    d = Decoder(costs, remembered=200)
    for k in range(500):
        d.token(f"word{'abcdefghij'[k % 10]}{k}")
    assert d.held <= 200 + 2 * 128


def test_numbers_of_a_text(costs):
    weights = {"^idiot$": 3.0, "^stu": 1.0, "^stupid": 2.5}
    got = Scorer(weights, Decoder(costs)).numbers("An 1d10t! said: s t u p i d words, stuff and idiot things")
    hits = {"idiot": (2, 3.0), "stupid": (1, 2.5), "stuff": (1, 1.0)}
    n, total = 9, 4
    want = [np.log1p(n), np.log1p(total), total / n, np.log1p(len(hits)), np.log1p(sum(a * b for a, b in hits.values())), 3.0, 2.5, 3 / n]
    assert got == pytest.approx(want) and len(got) == len(FEATURES)
    assert terms_of("stupid") == ["^stupid$", "^stu", "^stup", "^stupi", "^stupid"] and terms_of("ab") == ["^ab$"]
    assert Scorer({}).numbers("") == [0.0] * len(FEATURES)


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic").toPandas()
    got = op11_toxicity(spark, BIG).toPandas()
    assert len(got) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(labels, on="doc_id")
    both = both[both.held_out]
    toxic, clean = both[both.toxic == 1], both[both.toxic == 0]
    assert len(toxic) > 80 and toxic.predicted.mean() >= 0.9 and clean.predicted.mean() <= 0.02


def test_disguised_documents_score_as_plain_ones(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic")
    # The word list is the test's own way to disguise what its documents hold.
    plain = docs.join(labels.where("toxic = 1"), "doc_id").where("text rlike '(?i)idiot|moron|scum|loser'").limit(40).toPandas()
    hide = lambda t: t.replace("idiot", "1d10t").replace("moron", "m o r o n").replace("scum", "s.c.u.m").replace("loser", "l0s3r")
    more = pd.concat([plain.assign(doc_id=-1 - plain.doc_id, text=plain.text.map(hide)), plain])[["doc_id", "text"]]
    rows = score(docs.union(spark.createDataFrame(more[more.doc_id < 0], docs.schema)), labels)
    got = {r.doc_id: r for r in rows.collect()}
    kept = [got[-1 - i].predicted for i in plain.doc_id]
    assert len(kept) >= 20 and np.mean(kept) >= 0.95 * np.mean([got[i].predicted for i in plain.doc_id])


def test_edges(spark, costs):
    rows = [(1, None, 9), (2, "", 8), (None, "one two " * 20, 7), (4, "x1" * 100_000, 6), (4, "x1" * 100_000, 6), (5, "a b " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    none = spark.createDataFrame([(1, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    got = score(docs, none).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and {r.predicted for r in got} == {1}
    some = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (5, 1)], "doc_id bigint, toxic int")
    got = score(docs, some).collect()
    assert len(got) == 6 and len({r.score for r in got if r.doc_id == 4}) == 1
    assert score(docs.limit(0), none).collect() == []
    assert restore(docs, costs).columns == [*docs.columns, "restored"] and restore(docs, costs).where("restored is null").count() == 0
