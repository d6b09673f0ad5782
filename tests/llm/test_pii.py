import hashlib
import re

import pytest
from pyspark.sql import functions as F

from archivolt.llm import pii
from archivolt.llm.pii import detect, estimate, listed, op5_pii, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in twice) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PATTERNS.items())
             for m in re.finditer(p, text or "") if valid(k, m[0])]
    return [s for _, _, s in sorted(spans)]


TRICKY = [
    None, "", "a@b.cc_x@d.ee x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.001 1.2.3.99999999999999999999",
    "4111 1111-1111 1111 4111111111111111 4111111111111112 12345678901234", "+1 (743) 555-3824, +1 2 +123456789012345678",
    "\U0001f600é +49 30 1234567 x.y+z@m-1.example.org\n10.0.0.1", "a@b.c@d.e.f@g.h", "@a.b a@.b a@b a@b. c@d.e",
    "+1 555 123 4567 4111 1111 1111 1111 1.1.1.1", 'token = "24be64439e3e49cf46b2d7c9aa" page 1234567890123456',
    "é 127.0.0.1,127.0.0.1 " * 700,
]


def test_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    got = detect(docs).select("doc_id", listed("base").alias("base"), listed("spans").alias("spans")).collect()
    for r in got:
        want = brute(TRICKY[r.doc_id])
        assert r.base == ",".join(want)
        assert set(want) <= set(filter(None, r.spans.split(",")))


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op5_pii(spark, sf_dir).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(k) for s in want) for k in PATTERNS]


def brute_candidates(text):
    """{feature: value} with start and end of the further candidates of a text, voted one by one."""
    text = text or ""
    taken = [tuple(map(int, s.split(":")[1:])) for s in brute(text)]
    sign = lambda yes, no: 1 if yes else -1 if no else 0
    out = []
    for kind, pattern in (("secret", pii.SECRET), ("number", pii.NUMBER)):
        last = 0
        for m in re.finditer(pattern, text):
            before, match, low = text[last : m.start()][-24:].lower(), m[0], m[0].lower()
            last = m.end()
            if kind == "number" and len(re.sub("[^0-9]", "", match)) < 9 or any(a < m.end() and m.start() < b for a, b in taken):
                continue
            if kind == "secret":
                shape = sign(re.search("^(?:[0-9a-f]{24,}|[0-9A-F]{24,})$", match), re.search("^[0-9_-]+$", match))
                known = sign(low.startswith(pii.SECRET_STARTS), False)
            else:
                shape = sign(
                    re.search(r"^(?:[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$", match),
                    re.search(r"^(?:[0-9]+\.[0-9]+|(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}.*)$", match),
                )
                known = sign(False, match.startswith(("19", "20", "0.")))
            near = [re.search(r"(?:^|[^a-z])(?:" + "|".join(w) + r")[^a-z]*$", before) for w in (pii.ASKED, pii.OTHER)]
            values = {"regex": shape, "gazetteer": known, "context": sign(*near), "kind": kind, "size": min(len(match) // 8, 5),
                      "after_sign": bool(re.search("[=:][^a-z0-9]*$", before))}
            out.append((m.start(), m.end(), values))
    return out


def test_added_spans_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model, added = pii.train(docs), 0
    got = {r.doc_id: r for r in op5_pii(spark, sf_dir).collect()}
    for r in docs.collect():
        want = brute(r.text)
        for start, end, values in brute_candidates(r.text):
            if model["bias"] + sum(model[f].get(v, 0.0) for f, v in values.items()) > 0:
                want.append(f"{values['kind']}:{start}:{end}")
                added += 1
        spans = got[r.doc_id].spans
        assert sorted(filter(None, spans.split(","))) == sorted(want) and got[r.doc_id].n_spans == len(want)
    assert added


def test_long_texts(spark):
    rows = [(1, "7" * 300_000), (2, "1.2.3.4 " * 20_000), (3, "x" * 400_000), (4, "a@b.cc " * 20_000)]
    got = {r.doc_id: (r.n, r.first) for r in detect(spark.createDataFrame(rows, "doc_id bigint, text string")).selectExpr("doc_id", "size(base) AS n", "get(base, 0).end AS first").collect()}
    assert got == {1: (0, None), 2: (20_000, 7), 3: (0, None), 4: (20_000, 6)}


def test_prefix_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "_BLOCK", 3)
    row = spark.range(1).select(pii._offsets(F.sequence(F.lit(1), F.lit(10)).cast("array<bigint>"))).first()
    assert row[0] == [sum(range(1, k)) for k in range(1, 11)]


def test_em_learns_reliabilities():
    say = lambda r, g, c: {"regex": r, "gazetteer": g, "context": c}
    patterns = [(say(1, 1, 1), 90), (say(1, -1, 1), 10), (say(-1, -1, -1), 90), (say(-1, 1, -1), 10)]
    prior, reliability, post = estimate(patterns)
    assert prior == pytest.approx(0.5, abs=0.02)
    assert reliability["gazetteer"][1][1] < reliability["regex"][1][1]
    assert [p > 0.5 for p in post] == [True, True, False, False]


def test_redact(spark):
    rows = [(1, "mail a.b@c.dd or 1.2.3.4 now", 5), (2, None, 6), (2, "clean text", 7), (None, "x +1 (743) 555-3824", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans int")
    out = redact(docs)
    assert out.columns == docs.columns and {r.spans for r in out.collect()} == {5, 6, 7, 8}
    got = {r.text for r in out.collect()}
    assert got == {"mail [EMAIL] or [IP] now", None, "clean text", "x [PHONE]"}
    assert detect(docs.limit(0)).collect() == []
