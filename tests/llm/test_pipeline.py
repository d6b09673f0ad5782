import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from archivolt.llm.packing import VOCABULARY
from archivolt.llm.pii import detect
from tests.llm.test_minhash import brute_groups
from tests.llm.test_pii import brute
from tests.llm.test_quality import brute_counts


def brute_lines(docs):
    """{doc_id: text} without lines of ten or more code points that a smaller id holds."""
    owner, keyed = {}, {}
    for i in sorted(docs):
        keyed[i] = []
        for line in (docs[i] or "").split("\n"):
            key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
            if len(key) >= 10:
                owner.setdefault(key, i)
            keyed[i].append((line, owner.get(key, i)))
    return {i: "\n".join(line for line, o in lines if o == i) for i, lines in keyed.items()}


def brute_redact(text, spans):
    out, at = "", 0
    for span in sorted(spans, key=lambda x: (x.start, x.rank)):
        if span.start >= at:
            out += text[at : span.start] + f"[{span.kind.upper()}]"
        at = max(at, span.end)
    return out + text[at:]


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = [name for name, _ in corpus_pipeline.STAGES]
    assert seen == ["quality_rules", "line_dedup", "simhash_near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "packing":
            break
        assert out.columns == docs.columns
        docs = out.cache()
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert len(after) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
        if name == "quality_rules":
            assert all(before[i] == t for i, t in after.items())
            fit = {i for i, t in before.items() if not brute_counts(t)[-1]}
            assert set(after) <= fit
            wrong = [i for i in fit & set(labels) if (i in after) != (labels[i] == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "line_dedup":
            assert after == brute_lines(before)
        elif name == "simhash_near_dedup":
            groups = brute_groups(before)
            assert after == {i: t for i, t in before.items() if groups[i] == i}
        elif name == "pii":
            spans = {r.doc_id: r.spans for r in detect(spark.createDataFrame(list(before.items()), "doc_id bigint, text string")).collect()}
            assert after == {i: brute_redact(t, spans[i]) for i, t in before.items()}
            for i, t in before.items():
                assert set(brute(t)) <= {f"{x.kind}:{x.start}:{x.end}" for x in spans[i]}
        before = after
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u4").tolist())
    texts = list(before.values())
    want = {i: [*e.ids, 1] for i, e in zip(before, tokenizer.encode_batch(texts, add_special_tokens=False))}
    assert got == want


def test_run_gives_the_same_pieces(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).where("length <= 0 OR offset + length > 2048").count() == 0


def test_stages_keep_columns_with_clashing_names(spark, sf_dir):
    text = "These are some ten words or more of plain text, so the rules keep it as it is."
    rows = [(1, text, 5, "a", "x", 7), (2, text + " Write to a.b@c.dd now.", 6, "b", "y", 8), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines int, spans string, kept string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert {(r.n_lines, r.spans, r.kept) for r in out.collect()} <= {(5, "a", "x"), (6, "b", "y"), (None, None, None)}
    kept = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.n_chars for r in kept.collect()} <= {7, 8}
    assert corpus_pipeline.line_dedup(spark, docs.limit(0), sf_dir).collect() == []


def test_stages_on_empty_tables_and_very_long_texts(spark, sf_dir):
    schema = "doc_id bigint, text string, n_chars bigint"
    words = " ".join(f"w{k % 9973}x{k}" for k in range(120_000))
    long = f"{words} Write to a.b@c.dd now."
    rows = [(1, long, len(long)), (2, long + " end", len(long) + 4), (3, None, None), (3, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        out = stage(spark, docs, sf_dir).collect()
        if name == "quality_rules":
            assert {r.doc_id for r in out} <= {1, 2}
        elif name == "line_dedup":
            assert len(out) == 4 and {r.text for r in out if r.doc_id == 2} == {long + " end"}
        elif name == "simhash_near_dedup":
            assert [r.doc_id for r in out if r.doc_id < 3] == [1]
        elif name == "pii":
            assert {r.text for r in out if r.doc_id == 1} == {f"{words} Write to [EMAIL] now."}
        else:
            assert {r.doc_id for r in out} == {1, 2, 3} and sum(r.length for r in out if r.doc_id == 1) == max(r.doc_tokens for r in out if r.doc_id == 1)
