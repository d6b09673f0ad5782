"""Page items, closing slices, sorted neighbours, matches by rare words, observed writes: each against brute force."""

import datetime as dt
import hashlib
import random
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from archivolt.operators import marts as M
from archivolt.operators import matching as J
from archivolt.operators.prefixes import prefix_relatives
from archivolt.plans.catalogue import QUERIES
from archivolt.sources import archive as A
from archivolt.sources import pages as P
from archivolt.sources import shared
from archivolt.streaming import timers


class Tree(HTMLParser):
    """A whole tree of nested lists: [name, attributes, children]."""

    def __init__(self):
        super().__init__()
        self.root = ["", {}, []]
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in P.VOID:
            self.path.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.path[1:]]:
            while self.path.pop()[0] != tag:
                pass

    def handle_data(self, data):
        children = self.path[-1][2]
        if children and isinstance(children[-1], str):
            children[-1] += data
        else:
            children.append(data)

    def handle_comment(self, data):
        self.path[-1][2].append(["!", {}, []])


def nodes(node):
    for child in node[2]:
        if not isinstance(child, str):
            yield child
            yield from nodes(child)


def strings(node):
    for child in node[2]:
        if isinstance(child, str):
            if child.strip():
                yield child.strip()
        elif child[0] not in P.SILENT:
            yield from strings(child)


def brute_items(html, link=lambda u: u if u.startswith("/") else None):
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    bodies = [n for n in nodes(tree.root) if n[0] == "section" and n[1].get("name") == "articleBody"] or [n for n in nodes(tree.root) if n[0] == "article"]
    out = []
    for p in (n for n in nodes(bodies[0]) if n[0] == "p") if bodies else ():
        text = " ".join(strings(p))
        links = [u for a in nodes(p) if a[0] == "a" and (u := link((a[1].get("href") or "").strip()))]
        if 40 <= len(text) <= 2000:
            out.append((len(out), text, links[0] if links else None))
    return out


LONG = "some words of a paragraph that is long enough to be an item"
BROKEN = [
    None, "", "no markup", f"<p>{LONG}</p>", f"<article><p>{LONG}<p>{LONG} two<b>bold</p></b> after</article><p>{LONG} outside</p>",
    f"<article><p>a<!-- c -->b <i>{LONG}</i><br>x&amp;y &eacute;&#233;&nbsp;z<script>var p='<p>';</script><style>p{{}}</style></p>",
    f"<section name='articleBody'><p>{LONG} in the section <a href=' /a?x '>l</a><a href='/b'>m</a></p></section><article><p>{LONG} in the article</p></article>",
    f"<article><p>{LONG}</p></article><article><p>{LONG} second</p></article>", "<article>" + f"<p>{LONG} " * 60, f"<article></p></div><p>{LONG}<div><p>{LONG}</div> tail",
    f"<article><p><a href='https://x/c'>{LONG}</a><p><a>none</a><a href='/in'>{LONG}</a></article>", f"<article><p>{'w ' * 999}</p><p>{'w ' * 1001}</p><p>short</p></article>",
    f"<article><P CLASS=x>{LONG}</P><p/>{LONG}<img src=a><hr/></article>", f"<article><p>{LONG} <", f"<article><p>{LONG}<section name='articleBody'><p>{LONG} inner</article>",
]


def test_page_items_of_broken_markup(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 7)
    pages = spark.createDataFrame([(i, h, "x") for i, h in enumerate(BROKEN)], "page_id int, html string, text0 string")
    got = P.page_items(pages, "html", article=r"(/[^\s]*)", skip="^$").collect()
    want = [(i, *item) for i, h in enumerate(BROKEN) for item in brute_items(h)]
    assert sorted((r.page_id, r.no, r.text, r.link) for r in got) == want and len(want) > 20
    leads = P.page_items(pages, "html", lead="(?i)some WORDS").select("text").distinct().collect()
    assert leads and all(r.text.startswith("some words") for r in leads)


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = QUERIES["page_items_lateral"](spark, sf_dir).collect()
    want = [(r.page_id, *item) for r in pages for item in brute_items(r.html)]
    assert sorted((r.page_id, r.no, r.text) for r in got) == sorted(w[:3] for w in want) and len(want) > len(pages)
    assert all(r.refers_to is not None for r in got)


def test_an_unclosed_paragraph_keeps_no_more_than_an_item():
    parser = P.PageParser(P.re.compile("(/.*)"), P.re.compile("^$"), 40, 2000)
    parser.feed("<article><p>" + "<b>ten chars </b>" * 100_000)
    assert sum(map(len, parser.open[0].parts)) < 4000


def test_days_close_once_and_late_rows_are_told(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    batches = [
        [(1, day(1, 1), day(1, 2)), (2, day(1, 23), day(2, 1)), (3, None, day(1, 5)), (4, day(2, 1), day(2, 2))],
        [(5, day(1, 20), day(2, 3)), (6, day(2, 9), day(2, 9)), (7, day(1, 8), day(2, 7)), (8, day(3, 1), day(3, 1))],
        [(9, day(1, 9), day(3, 2)), (10, day(2, 22), day(3, 5)), (11, day(4, 1), day(4, 1)), (12, day(2, 1), day(4, 2))],
    ]
    base, states, out = f"file://{tmp_path}", [], []
    for rows in batches:
        df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, at timestamp_ntz")
        df.coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{base}/in")
        progress = timers.resume(timers.closing_days(stream, "ts", "at", F.col("id")), f"{base}/out", f"{base}/checkpoint")
        states.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
        kept = spark.read.schema("slice date, kind string, n long").option("recursiveFileLookup", True).parquet(f"{base}/out")
        out.append(sorted((r.slice.day, r.kind, r.n) for r in kept.groupBy("slice", "kind").agg(F.sum("n").alias("n")).collect()))
    assert out[0] == []  # nothing is closed yet
    assert out[1] == [(1, "closed", 3), (1, "refetch", 1)]
    assert out[2] == [(1, "closed", 3), (1, "refetch", 2), (2, "closed", 3), (2, "refetch", 1)]
    assert states[2] < states[1]  # the state of closed days is gone


@pytest.mark.parametrize("partitions", ["1", "4", "23"])
def test_sorted_neighbours(spark, partitions):
    rng = random.Random(int(partitions))
    texts = ["é" * 3, "a" * 3]
    for _ in range(250):
        base = rng.choice(texts)
        texts.append(base[: rng.randint(0, len(base))] + "".join(rng.choices("abé", k=rng.randint(0, 4))))
    texts += ["boilerplate " * k for k in range(1, 40)] + ["boilerplate " * 5 + str(k) for k in range(60)]
    rows = [(t, {g: rng.randrange(1000) for g in rng.sample((1, 2), rng.randint(0, 2))}, rng.sample((1, 2, 3), rng.randint(0, 3))) for t in sorted(set(texts))]
    want = {}
    for t, _, asked in rows:
        for g in asked:
            near = [known[g] for u, known, _ in rows if g in known and (t.startswith(u) or u.startswith(t))]
            if near:
                want[hashlib.sha256(t.encode()).digest(), g] = min(near)
    made = [(t, [(g, v) for g, v in known.items()], asked) for t, known, asked in rows] + [(None, [(1, 1)], [1])]
    frame = spark.createDataFrame(made, "text string, known array<struct<group:bigint,value:bigint>>, asked array<bigint>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = prefix_relatives(frame, boundary=6 if partitions == "4" else 512).collect()
        none = prefix_relatives(frame.limit(0)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(bytes(r.digest), r.group): r.value for r in got} == want and len(got) == len(want) > 200
    assert none == []


def brute_best(items, pool, days):
    out = {}
    for item, day, words, title in items:
        found = []
        for partner, other, theirs, text in pool:
            o = (other - day).days
            if abs(o) > days:
                continue
            n, size = len(set(words) & set(theirs)), min(max(len(theirs), 4), 8)
            if len(title) >= 6 and title in text:
                found.append((False, 0, o, partner, True, 0, 1.0))
            elif n:
                found.append((True, -n / size, o, partner, False, n, n / size))
        if found:
            _, _, o, partner, inside, n, score = min(found)
            if inside or n >= 2 or score == 1:
                out[item] = (partner, o, inside, n, score)
    return out


def test_matches_by_rare_words(spark):
    rng = random.Random(5)
    common, rare = [f"common{k}" for k in range(15)], [f"rare{k}" for k in range(400)]
    day = lambda: dt.date(2024, 1, rng.randint(1, 6))
    pool = []
    for k in range(300):
        words = rng.sample(common, rng.randint(0, 6)) + rng.sample(rare, rng.randint(1, 9))
        pool.append((k, day(), words, " ".join(words)))
    items = []
    for k in range(80):
        _, d, words, text = rng.choice(pool)
        own = rng.choice([rng.sample(words, max(1, len(words) - 2)), rng.sample(common, 8), rng.sample(common, 2) + rng.sample(rare, 3), ["nowhere"]])
        items.append((k, d, own, text if k % 9 == 0 else "no such title"))
    schema = lambda key: f"{key} int, day date, words array<string>, title string"
    frames = spark.createDataFrame(items, schema("item")), spark.createDataFrame(pool, schema("partner"))
    got = {r.item: (r.partner, r.offset, r.inside, r.n, r.score) for r in J.best_match(*frames).collect()}
    assert got == brute_best(items, pool, 3)
    assert {x[2] for x in got.values()} == {True, False}


def test_items_with_a_partner_try_few_others(spark):
    rng = random.Random(8)
    common, rare = [f"common{k}" for k in range(15)], [f"rare{k}" for k in range(2000)]
    pool = [(k, dt.date(2024, 1, rng.randint(1, 6)), rng.sample(common, 6) + rng.sample(rare, 8), "") for k in range(300)]
    items = [(k, day, rng.sample(words, 12), "") for k, day, words, _ in rng.sample(pool, 60)]
    schema = lambda key: f"{key} int, day date, words array<string>, title string"
    frames = spark.createDataFrame(items, schema("item")), spark.createDataFrame(pool, schema("partner"))
    sharing = sum(bool(set(i[2]) & set(p[2])) and abs((p[1] - i[1]).days) <= 3 for i in items for p in pool)
    assert J.word_candidates(*frames).count() < sharing / 20
    assert {(r.item, r.partner) for r in J.best_match(*frames).collect()} == {(k, k) for k, *_ in items}


def test_sketches_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 12).cast("int").alias("mon"), F.concat(F.lit("n"), F.col("id") % 7000).alias("who"))
    months = M.distinct_sketches(rows.withColumn("yr", F.lit(1)), ["yr", "mon"], "who")
    (r,) = M.merged_distinct(months, ["yr"]).collect()
    assert r.low <= 7000 <= r.high and r.high - r.low < 400


def test_a_broken_expectation_leaves_the_old_table(spark, tmp_path):
    path, metrics = f"file://{tmp_path}/t", {"n": F.count(F.lit(1)), "none": F.count_if(F.col("v").isNull())}
    holds = {"nulls": lambda m: m["none"] == 0}
    good, bad = (spark.createDataFrame(rows, "k int, v int") for rows in ([(1, 1), (2, 2)], [(1, None)]))
    assert A.write_observed(good, path, metrics, holds) == {"n": 2, "none": 0}
    with pytest.raises(ValueError, match="nulls"):
        A.write_observed(bad, path, metrics, holds)
    assert spark.read.parquet(path).count() == 2 and len(list(tmp_path.iterdir())) == 1
    assert A.write_observed(good.limit(1), path, metrics, holds)["n"] == spark.read.parquet(path).count() == 1


def test_written_tables_go(spark):
    df = shared.written(spark.range(3), "some")
    assert df.count() == 3 and shared._written
    path = list(shared._written)[-1]
    shared.release()
    assert not shared.exists(spark, path)
    assert Counter(shared._written) == {}
