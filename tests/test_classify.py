from pyspark.sql import functions as F

from archivolt.functions.text import script_strings
from archivolt.operators import classify as C


def test_rules_apply_in_order(spark):
    rows = [
        (1, "Quote of the Day", "Corrections", "News", ["A B"]), (2, "Lottery Numbers", "New York", "News", []), (3, "Lottery Numbers", "Arts", "News", ["A B"]),
        (4, "Iowa Election Results", "U.S.", "News", ["Wire"]), (5, "Doubt Over Election Result", "U.S.", "News", ["A B"]),
        (6, "Winning Lottery Numbers", "New York", "Obituary", ["A B"]), (7, None, "Arts", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, headline string, section string, material string, authors array<string>")
    got = {r.id: (r.section, r.is_lottery, r.is_election) for r in C.reclassify(df, ["Wire"]).collect()}
    assert got == {
        1: (C.DUMPS, False, False), 2: (C.DUMPS, True, False), 3: ("Arts", False, False), 4: (C.DUMPS, False, True),
        5: ("U.S.", False, False), 6: ("Obituaries", True, False), 7: ("Arts", False, False),
    }


def test_features(spark):
    df = spark.createDataFrame([("https://x/style/a-wedding.html", "", ["Weddings and Engagements"], ""), ("u", "Weddings", [], "Mini-Vows"), ("u", "", None, "WEDDINGS: VOWS"), (None, None, None, None)],
                               "u string, s string, t array<string>, k string")
    got = [tuple(r.x) for r in df.select(C.weddings(F.col("u"), F.col("s"), F.col("t"), F.col("k")).alias("x")).collect()]
    assert got == [(True, False), (True, False), (True, True), (False, False)]
    flags = spark.range(1).select(
        C.is_quote_of_day(F.lit("Quote of the Day: x"), F.lit(""), F.lit("")), C.is_recommendation(F.lit("Letter of Recommendation: x"), F.lit("")),
        C.is_correction(F.array(F.lit("a")), F.lit("News"), F.lit("/2010/c-corrections-1")), C.is_listing(F.lit("Today's Events"), F.lit("x"), starts=["Today"]), C.is_lottery(F.lit("News")),
    ).first()
    assert tuple(flags) == (True, True, True, True, False)


def test_obituary_gate(spark):
    rows = [
        (1, "Jane Roe, Painter, Dies at 80", "Arts", "Obits", "News", "https://x/a"), (2, "An Appreciation", "Obituaries", "", "News", "https://x/a"),
        (3, "Jane Roe Dies", "Arts", "", "News", "https://x/a"), (4, "Jane Roe Dies", "Obituaries", "", "Video", "https://x/a"), (5, "A Profile", "", "National / Portraits of Grief", None, "https://x/a"),
        (6, "Jane Roe Dies", "Obituaries", "", "Correction", "https://x/a"), (7, "Deaths Last Week: Some Died", "Obituaries", "", "", "https://x/a"), (8, "Jane Roe", "", "", "", "https://x/obituaries/jane-roe-dead.html"),
    ]
    df = spark.createDataFrame(rows, "id int, headline string, section string, desk string, material string, url string")
    assert sorted(r.id for r in C.obituaries(df).collect()) == [1, 5, 8]


def test_republished(spark):
    rows = [("a", "1", 1, False), ("a", "2", 9, True), ("a", "3", 5, False), ("b", "4", 7, True), ("b", "5", 3, True), ("c", "6", 1, True)]
    df = spark.createDataFrame(rows, "name string, url string, day int, republished boolean")
    got = {r.url: [x.url for x in r.later] for r in C.attach_republished(df, "name", [F.col("day")]).collect()}
    assert got == {"1": ["2"], "3": [], "5": ["4"], "6": []}


def test_embedded_json(spark):
    html = r'<script>{"text":"One \"two\"","x":{"text" : "three"}}</script>'
    assert spark.createDataFrame([(html,)], "h string").select(script_strings(F.col("h"), "text").alias("t")).first().t == 'One "two" three'
