import datetime as dt
import json

from pyspark.sql import functions as F

from archivolt.operators import marts as M
from archivolt.operators import matching as J
from archivolt.operators import quality as Q
from archivolt.operators import themes as T
from archivolt.sources import archive as A
from archivolt.streaming import streams as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bins(spark):
    df = spark.createDataFrame([(0,), (199,), (200,), (3999,), (4000,), (9999,)], "w int")
    assert rows(M.histogram(df, [], "w")) == [(0, 1), (1, 1), (19, 1), (20, 2)]


def test_half_even_and_median(spark):
    df = spark.createDataFrame([("a", 2000, 2), ("a", 2000, 3), ("a", 2002, 0), ("b", 2001, 7)], "k string, y int, w int")
    got = {(r.k, r.y): (r.n, r.avg_words, r.median_words) for r in M.trend(df, "k", "y", "w").collect()}
    assert got[("a", 2000)] == (2, 2, 2) and got[("a", 2001)] == (0, 0, 0) and len(got) == 6


def test_quintile_is_not_ntile(spark):
    df = M.quintile(spark.range(7).withColumn("g", F.lit(1)), ["g"], [F.asc("id")])
    assert [r.quintile for r in df.orderBy("id").collect()] == [1, 1, 2, 3, 3, 4, 5]


def test_buckets_partition_the_count(spark):
    df = spark.range(50).select(F.lit(1).alias("m"), F.col("id").cast("int").alias("w"))
    r = M.bucketed(df, ["m"], "w", {"x": F.col("w") % 2 == 0, "y": F.col("w") % 3 == 0}, "z").first()
    assert r.n == r.n_x + r.n_y + r.n_z == 50 and r.words == r.words_x + r.words_y + r.words_z


def test_name_variants(spark):
    counts = [("Jonah Engel Bromwich", 90), ("Jonah E. Bromwich", 20), ("Jonah Bromwich", 3), ("jonah bromwich", 1),
              ("Ann Lee Fox", 30), ("Ann May Fox", 20), ("Ann Fox", 15), ("Solo Name", 2)]
    got = dict(rows(J.name_variants(spark.createDataFrame(counts, "name string, n int"))))
    assert {got[n] for n, _ in counts[:4]} == {"Jonah Engel Bromwich"}
    assert all(got[n] == n for n, _ in counts[4:])


def test_person_prefixes(spark):
    totals = [("Doe, Jo", 3, 0), ("Doe, Jo Q", 60, 1), ("Roe, Al", 2, 2), ("Roe, Al Jr", 90, 3), ("Poe, Ed", 51, 4), ("Poe, Ed X", 9000, 5)]
    assert rows(J.person_prefixes(spark.createDataFrame(totals, "name string, n int, seq int"))) == [("Doe, Jo", "Doe, Jo Q")]


def test_person_prefixes_follow_links_without_a_call_a_group(spark):
    totals = [("Doe, Jo", 3, 0), ("Doe, Jo Q", 60, 1), ("Doe, Jo Q R", 1000, 2), ("Fox, Al", 2, 3), ("Fox, Al B", 29, 4), ("Fox, Al C", 30, 5)]
    totals += [(f"Last{k}, Ann{m}", 1 + 99 * (m != ""), 10 + 2 * k + (m != "")) for k in range(300) for m in ("", " M.")]
    got = J.person_prefixes(spark.createDataFrame(totals, "name string, n int, seq int"))
    want = [("Doe, Jo", "Doe, Jo Q R"), ("Fox, Al", "Fox, Al C")] + [(f"Last{k}, Ann", f"Last{k}, Ann M.") for k in range(300)]
    assert rows(got) == sorted(want, key=str)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_contained_step_gives_each_row_one_hit_without_pairs(spark):
    pool = spark.createDataFrame([(5, 1, "/a/Example"), (3, 1, "/b/eXAMPLES"), (9, 2, "/c/xa"), (8, 2, None), (1, None, "/example")], "hit bigint, d int, url string")
    asked = [(1, 1, "example"), (2, 1, "EXAMPLES"), (3, 2, "A"), (4, 2, "example"), (5, 1, ""), (6, 2, None), (7, None, "example"), (1, 1, "example")]
    held = J.contained_step(spark.createDataFrame(asked, "r int, d int, word string"), pool, "d", "word", "url", "hit")
    assert rows(held.select("r", "word", "hit")) == [(1, "example", 3), (1, "example", 3), (2, "EXAMPLES", 3), (3, "A", 9)]


def test_duplicates_by_ratio(spark):
    df = [("h", 1, 900, "aa"), ("h", 1, 1000, "a"), ("g", 1, 899, "a"), ("g", 1, 1000, "b"), ("", 1, 5, "a"), ("", 1, 5, "b"), ("z", 1, 0, "a"), ("z", 1, 0, "b")]
    got = J.duplicates(spark.createDataFrame(df, "h string, d int, n int, u string"), ["h", "d"], "n", "u", "u")
    assert rows(got.where("is_duplicate").select("h", "u")) == [("h", "aa")]


def test_override_chains(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "k string, v string")
    assert rows(J.closure(pairs, "k", "v")) == [("a", "d"), ("b", "d"), ("c", "d")]


def test_bursts(spark):
    counts = [("p", "one", 2000, 9), ("p", "one", 2005, 1), ("p", "pair", 2000, 5), ("p", "pair", 2001, 4), ("p", "pair", 2009, 1), ("p", "flat", 2000, 5), ("p", "flat", 2005, 5)]
    got = T.bursts(spark.createDataFrame(counts, "place string, tag string, yr int, n long"), "place", "tag", "yr", 0.85)
    assert {r.tag: r.is_event for r in got.collect()} == {"one": True, "pair": True, "flat": False}


def test_band_join_plans_an_equi_join(spark):
    a = spark.createDataFrame([(1, dt.date(2024, 1, 4))], "i int, d date")
    b = spark.createDataFrame([(k, dt.date(2024, 1, k)) for k in range(1, 10)], "j int, e date")
    out = J.band_join(a, b, "d", "e", 3)
    assert sorted(r.offset for r in out.collect()) == list(range(-3, 4))
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def test_archive_round_trip(spark, tmp_path):
    docs = [
        {"pub_date": "2020-05-01T23:59:00-04:00", "headline": {"main": "One"}, "word_count": "12", "section_name": "Old", "web_url": "https://x/1",
         "keywords": [{"name": "Subject", "value": "A"}, {"name": "subject", "value": "A"}, {"name": "subject", "value": None}], "print_section": "A", "print_page": "1"},
        {"pub_date": "0001-01-01T00:00:00Z"}, {"pub_date": None}, {"pub_date": "2021-01-01", "section_name": "Archives"},
        {"pub_date": "2021-02-03T00:00:00Z", "word_count": "many", "headline": None},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2020_05.json").write_text(json.dumps(docs))
    (tmp_path / "in" / "2020_06.json").write_text("[{broken")
    out = A.normalise(A.read_records(spark, str(tmp_path / "in")), {"Old": "New"})
    got = {r.year_month: r for r in out.collect()}
    assert set(got) == {"2020-05", "2021-02"}
    assert got["2020-05"].subjects == ["A"] and got["2020-05"].section == "New" and got["2020-05"].front_page
    assert got["2021-02"].word_count == 0 and got["2021-02"].headline == ""
    flat = out.select("yr", "headline", "word_count")
    A.write_by_year(flat, str(tmp_path / "out"))
    A.write_by_year(flat.where("yr = 2021").withColumn("headline", F.lit("x")), str(tmp_path / "out"))
    again = spark.read.schema(flat.schema).parquet(str(tmp_path / "out"))
    assert rows(again.select("yr", "headline", "word_count")) == [(2020, "One", 12), (2021, "x", 0)]
    assert not A.round_trips(flat, again.select(flat.columns)) and A.round_trips(again, again)
    assert json.loads(A.as_document(again).first().document)[0]["headline"] == "One"


def test_complete_months(spark):
    months = spark.createDataFrame([("a", 694, 4046), ("b", 10, 10), ("c", 1, None)], "month string, n_docs int, hits int")
    assert [r.month for r in A.complete(months).orderBy("month").collect()] == ["b", "c"]


def test_expectation_fails_fast(spark):
    import pytest

    assert Q.expect(spark.range(3), F.col("id") >= 0, "no").count() == 3
    with pytest.raises(Exception, match="words are zero"):
        Q.expect(spark.range(3), F.col("id") > 0, "words are zero").collect()


def test_streams_with_late_data(spark, tmp_path):
    schema = "id int, ts timestamp, k string"
    stamp = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    parts = [[(1, stamp(1), "a"), (2, stamp(9), "a")], [(3, stamp(1, 5), "a"), (2, stamp(9), "a"), (4, stamp(30), "b")], [(5, stamp(1), "a")], [(6, stamp(1), "a")]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    for i in range(4):
        for f in (tmp_path / f"in/{i}").glob("*.parquet"):
            f.rename(tmp_path / f"in/{i}-{f.name}")
            import os

            os.utime(tmp_path / f"in/{i}-{f.name}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    kept = S.drain(S.without_repeats(stream, ["id"], "ts", "20 days"), "kept", "append", f"file://{tmp_path}/c1")
    assert sorted(r.id for r in kept.collect()) == [1, 2, 3, 4, 5]  # a batch is held to the watermark of the one before it
    monthly = S.drain(S.monthly_counts(stream, "ts", ["k"], "62 days"), "monthly", "update", f"file://{tmp_path}/c2", ["month", "k"])
    assert rows(monthly.select("k", "n")) == [("a", 6), ("b", 1)]
    chains = S.drain(S.sessions(stream, "ts", "k", "10 days", "62 days"), "chains", "complete", f"file://{tmp_path}/c3")
    assert rows(chains.select("k", "n")) == [("a", 6), ("b", 1)]
    S.replace_slices(stream.withColumn("m", F.month("ts")), f"{tmp_path}/t", "m", f"{tmp_path}/c4").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/t").where("m = 1").count() == 1


def test_year_of_file(spark):
    paths = [("file:///a/2018/records_2019.json",), ("b/2020_05.json",), ("none.json",)]
    got = [r.y for r in spark.createDataFrame(paths, "p string").select(A.year_of_file("p").alias("y")).collect()]
    assert got == [2019, 2020, None]


def test_tables_are_written_once_and_stale_ones_go(spark, tmp_path):
    df, path = spark.range(5).withColumn("x", F.lit("a")), f"file://{tmp_path}/marts/one"
    assert [A.write_if_changed(df, path), A.write_if_changed(df.orderBy(F.desc("id")), path), A.write_if_changed(df.limit(4), path)] == [True, False, True]
    assert A.write_if_changed(df, f"file://{tmp_path}/marts/two")
    assert A.remove_stale(spark, f"file://{tmp_path}/marts", ["two"]) == ["one", "one.digest"]
    assert sorted(p.name for p in (tmp_path / "marts").iterdir() if not p.name.startswith(".")) == ["two", "two.digest"]


def test_best_match(spark):
    day = dt.date(2024, 1, 10)
    items = [(1, day, ["alpha", "beta"], "the long title here"), (2, day, ["gamma"], ""), (3, day, ["delta"], "ab cd ef"), (4, day, ["alpha"], "two words")]
    pool = [
        (10, day, ["alpha", "beta", "x", "y", "z"], "nothing"), (11, dt.date(2024, 1, 12), [], "see the long title here now"), (12, day, ["gamma"], "g"),
        (13, dt.date(2024, 1, 14), ["delta"], "ab cd ef"), (14, day, ["alpha"] + [f"w{k}" for k in range(20)], "in two words"),
    ]
    schema = "k int, day date, words array<string>, title string"
    frames = (spark.createDataFrame(r, schema).withColumnRenamed("k", n) for r, n in ((items, "item"), (pool, "partner")))
    got = {(r.item, r.partner, r.offset, r.inside) for r in J.best_match(*frames).collect()}
    assert got == {(1, 11, 2, True), (4, 14, 0, True)}


def test_chains_cross_pieces_of_time(spark):
    times = [0, 10, 20, 29, 31, 45, 46, 100, 129, 131]  # days; pieces of 30
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=t), t) for t in times], "k int, ts timestamp, t int")
    gap = F.col("__now") - F.col("__before") > F.expr("interval 12 days")
    got = {r.t: r.chain for r in J.chains(df, "k", F.col("ts"), gap, "t").collect()}
    assert got == {0: 1, 10: 1, 20: 1, 29: 1, 31: 1, 45: 2, 46: 2, 100: 3, 129: 4, 131: 4}


def test_year_tags_are_events(spark):
    counts = spark.createDataFrame([("p", t, y, 5) for t in ("Vote (2004)", "War 2003 - 2011", "plain") for y in (2000, 2001, 2002)], "place string, subject string, yr int, n long")
    rows = spark.createDataFrame([("p", k) for k in range(20)], "place string, article_id int")
    found = T.themes(counts, rows, counts.groupBy("subject").agg(F.lit(1).alias("freq")), spark.range(1).select(F.lit(20).alias("corpus")))
    assert {r.subject: r.is_event for r in found.collect()} == {"Vote (2004)": True, "War 2003 - 2011": True, "plain": False}
