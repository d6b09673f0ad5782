import hashlib
import re

from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from archivolt.llm import fill_middle
from archivolt.llm.fill_middle import LINES, offsets, op13_fill_in_middle, restored, transform


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        *head, output = brute(r.doc_id, r.text)
        want[r.doc_id] = (*head, sha(output), sha(r.text or ""))
    got = {r.doc_id: tuple(r)[1:] for r in op13_fill_in_middle(spark, sf_dir).collect()}
    assert got == want and {r[1] for r in got.values()} >= {"psm", "spm"}


TEXTS = ["", "\n", "\n\n\n", "one line", "a\nb\n", "\r\n x \r\ny", "é😀\n z\nlast", "<\n<S\n<P", "has <M> inside\nb", "a<\nP>S>\nM><", " \t\n ", "x" * 50 + "\n"]


def test_edges_and_other_rates(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS * 8)] + [(3, None, 1), (None, "a\nb\nc", 1), (None, None, 1), (900, "a\nb", 1), (900, "a\nb", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n int")
    made = transform(docs, rate=60, spm=30).withColumn("back", restored(F.col("form"), F.col("output"))).collect()
    key = lambda x: (x[0] is not None, x)
    assert sorted((tuple(r)[:6] for r in made), key=lambda r: str(key(r))) == sorted(
        ((i, *brute(i, t, 60, 30)) for i, t, _ in rows), key=lambda r: str(key(r))
    )
    text = {r[0]: r[1] or "" for r in rows}
    assert all(r.back == text[r.doc_id] for r in made if r.doc_id not in (None, 3))
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert transform(docs.limit(0)).count() == 0 and "n" in transform(docs).columns


def test_blocks_end_after_lines():
    split = Split(Regex(LINES), "isolated")
    for text in [*TEXTS, "ab\nc\n\nlonger line é\nend", "no end at all " * 9]:
        whole = offsets(text, split)
        assert whole == [0, *[m.end() for m in re.finditer(LINES, text)]]
        assert all(offsets(text, split, block) == whole for block in (1, 2, 3, 7, 20))


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "BLOCK", 1 << 16)
    text = "a line of some words\n" * 60_000 + "z" * 300_000
    docs = spark.createDataFrame([(5, text)], "doc_id bigint, text string")
    (r,) = transform(docs).collect()
    assert tuple(r)[1:] == brute(5, text)
