import datetime as dt

import pytest
from pyspark.sql import functions as F

from archivolt.functions import dates as D
from archivolt.functions import names as N
from archivolt.functions import text as X


def one(spark, expression, **values):
    kinds = {str: "string", int: "int", dt.date: "date"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("name", "want"), [
    ("AGRICULTURE", "Agriculture and Farming"), ("JEWS", "Jews"), ("F.B.I.", "F.B.I."), ("AMERICA'S CUP", "America's Cup"),
    ("CAPITOL (WASHINGTON, DC)", "Capitol (Washington, DC)"), ("Capitol (Washington, Dc)", "Capitol (Washington, DC)"),
    ("transit_systems", None), ("BOOKS AND LITERATURE", "Books and Literature"), ("transit", "transit"),
])
def test_subjects(spark, name, want):
    assert one(spark, X.normalise_subject("s", {"AGRICULTURE": "Agriculture and Farming"}), s=name) == want


def test_cycle_years(spark):
    for year, want in ((2002, "C (2004)"), (2019, "C (2020)"), (1990, "C (2000)"), (2050, "C (2024)")):
        assert one(spark, X.nearest_cycle(F.lit("C"), F.col("y"), ["C"], [2000, 2004, 2008, 2012, 2016, 2020, 2024]), y=year) == want


def test_places(spark):
    states = ["New York", "Arizona", "New Jersey"]
    for place, want in (("New York City", "New York"), ("ARIZONA", "Arizona"), ("Newark (NJ)", "New Jersey"), ("Paris", None)):
        assert one(spark, X.state_of("p", states), p=place) == want
    for place, want in (("City (Sub) (India)", "India"), ("FRANCE", "France"), ("Great Britain", "United Kingdom"), ("Mosul (Iraq)", "Iraq")):
        assert one(spark, X.country_of("p", {"Great Britain": "United Kingdom"}, {}), p=place) == want


def test_urls(spark):
    flags = F.struct(X.is_blog(F.col("u")), X.is_live(F.col("u")), X.is_podcast(F.lit("News"), F.col("u"), F.col("k")))
    assert tuple(one(spark, flags, u="https://x.blogs.example.com/a", k="")) == (True, False, False)
    assert tuple(one(spark, flags, u="https://www.example.com/live/2020/a", k="")) == (False, True, False)
    assert tuple(one(spark, flags, u="https://www.example.com/a", k=" The Daily")) == (False, False, True)


@pytest.mark.parametrize(("original", "want"), [
    ("By Arash Khamooshi/Polaris for The Daily Example", ["Arash Khamooshi"]), ("Malia Mills: Written With Alex Kuczynski", ["Malia Mills"]),
    ("By A.o. Scott", ["A. O. Scott"]), ("By Ann Lee (XYZ COMPILED BY STAFF)", ["Ann Lee"]), ("and Y NEWMAN", ["Andy Newman"]), ("By Sarah Mervosh and Mark Bonamo", ["Sarah Mervosh", "Mark Bonamo"]),
    ("By Ann Lee, Bo Day, and Cy Fox", ["Ann Lee", "Bo Day", "Cy Fox"]), ("wire reports", []), (None, []), ("By &amp; Reuters", []),
])
def test_bylines(original, want):
    assert [p["fullname"] for p in N.parse_byline(original)] == want


def test_structured_bylines():
    person = {"firstname": "Photographs Jo", "middlename": None, "lastname": "SMITH"}
    assert [p["fullname"] for p in N.parse_byline("By X Y", [person, person])] == ["Jo Smith", "Jo Smith"]
    assert [p["fullname"] for p in N.parse_byline("By Xa Yb", [{"firstname": "A", "middlename": "", "lastname": "None"}])] == ["Xa Yb"]


def test_person_keys():
    assert N.person_key("R.W. Apple") == N.person_key("R. W. Apple Jr.") == "apple"
    assert N.person_key("Dr. José O'Neil") == "jose oneil"


def test_obituary_names(spark):
    for headline, want in (
        ("Killed at 71, Ayman al-Zawahri Led a Life of Secrecy", "Ayman al-Zawahri"),
        ("A Man of Many Words, David Shulman Dies at 91", "David Shulman"), ("Joe Moakley of Massachusetts Dies at 74", "Joe Moakley"),
        ("Choreographer, Sophie Maslow, Dies at 95", "Sophie Maslow"), ("Ann Poe, Wife of a Mayor, Dies at 70", "Ann Poe"),
        ("Old Force Dies at 50", None), ("From 1992: Jane Roe Is Dead at 90", "Jane Roe"), ("Overlooked No More: Ann Poe, Painter", "Ann Poe"),
        ("Long May She Reign: Jane Roe Dies at 80", "Jane Roe"), ("‘Slim’: Ann Poe Dies at 66", "Ann Poe"), ("Russia's Jane Roe Dies at 71", "Jane Roe"),
        ("Late Rev. Dr. Jane Roe Dies at 80", "Jane Roe"), ("", None),
        ("Jane Roe, Painter, Dies at 80", "Jane Roe"), ("Former Giants Linebacker Brad Van Pelt Dies at 57", "Brad Van Pelt"),
    ):
        assert one(spark, X.person_in_headline("h"), h=headline) == want
    nothing = spark.createDataFrame([(None,)], "h string")
    assert tuple(nothing.select(X.person_in_headline("h"), X.person_in_headline("h", F.lit(True)), X.person_in_abstract("h")).first()) == (None,) * 3
    portrait = X.person_in_headline("h", F.lit(True))
    assert one(spark, portrait, h="Ann Lee Poe: A Man of Boats") == "Ann Lee Poe"
    assert one(spark, portrait, h="Ann Poe, Painter, Dies at 80") == "Ann Poe"
    assert one(spark, X.person_in_abstract("h"), h="Rev. Jane Roe, 81, a minister") == "Jane Roe"
    assert one(spark, X.person_in_abstract("h"), h="Former Leader, 81, a minister") is None
    assert one(spark, X.person_in_abstract("h"), h="a minister, 81") is None
    assert one(spark, X.state_of("h"), h="Erie (PA)") == one(spark, X.state_of("h"), h="Erie (Pa)") == "Pennsylvania"
    assert one(spark, X.person_in_slug("h"), h="jim-fassel-giants-dead") == "Jim Fassel"
    assert one(spark, X.person_in_slug("h"), h="01mancuso") is None


def test_age_gender_profession(spark):
    age = X.age_of(F.col("h"), F.col("a"))
    assert one(spark, age, h="Jane Roe, Painter, Dies at 80", a="") == 80
    assert one(spark, age, h="Jane Roe, 17, of note", a="Mr. Gugino, 81, had filed") == 81
    assert tuple(one(spark, X.gender_of("t"), t="Mrs. Roe met Mr. Poe and Ms. Day")) == ("F", "honorific")
    assert tuple(one(spark, X.gender_of("t"), t="a painter and his wife")) == ("M", "kinship")
    assert tuple(one(spark, X.gender_of("t"), t="then she left")) == ("F", "pronoun")
    assert one(spark, X.profession_of(F.col("h"), F.col("a")), h="Jane Roe, Painter, Dies at 80", a="") == "Painter"
    assert one(spark, X.display_name("n", F.col("h")), n="Jane Roe", h="Dr. Jane Roe, Dead") == "Dr. Jane Roe"


def test_dates(spark):
    day = dt.date(2024, 1, 10)
    weekday = D.mentioned_weekday(F.col("t"), F.col("d"))
    assert one(spark, weekday, t="an article on Monday", d=day) == dt.date(2024, 1, 8)
    assert one(spark, weekday, t="last Monday", d=day) == dt.date(2024, 1, 1)
    monday = dt.date(2024, 1, 8)
    assert one(spark, weekday, t="on Monday", d=monday) == monday
    reference = D.reference_date(F.col("t"), F.col("d"))
    assert one(spark, reference, t="on Monday", d=monday) == dt.date(2024, 1, 1)
    assert one(spark, reference, t="an article on Dec. 30 about", d=day) == dt.date(2023, 12, 30)
    assert one(spark, reference, t="this weekend", d=day) == dt.date(2024, 1, 7)
    assert one(spark, reference, t="nothing, Feb. 30", d=day) == day
    assert one(spark, D.iso_day(F.col("t")), t="2024-01-31T23:30:00-05:00") == dt.date(2024, 1, 31)
    assert one(spark, D.date_in_path(F.col("t")), t="https://x/2020/02/03/a.html") == dt.date(2020, 2, 3)


def test_slugs(spark):
    for name, want in (("Michael S. Schmidt", "michael-s-schmidt"), ("C.J. Chivers", "c-j-chivers"), ("Zoë O'Reilly Jr.", "zoe-o-reilly"), ("Łukasz Šimić", "ukasz-simic"), ("Bjørn Ōno", "bjrn-ono")):
        assert one(spark, X.slug_of("n"), n=name) == want


def test_abbreviations(spark):
    restored = X.restore_abbreviations(F.col("t"))
    for text, want in (("About Us", "About US"), ("Parks-Nyc", "Parks-NYC"), ("Capitol (Washington, Dc)", "Capitol (Washington, DC)"), ("Us Dcx, Ny.", "Us Dcx, Ny."), ("Ny-Nj Ct", "Ny-NJ CT")):
        assert one(spark, restored, t=text) == want
    assert one(spark, X.normalise_subject("t"), t="PARKS-NYC AND US") == "Parks-NYC and US"


def test_pages_and_bios(spark):
    html = "<script>var t='</p>'</script><p>One &amp; two<p class=x>Three <b>four</b></p><div></div>"
    assert one(spark, X.paragraphs("h"), h=html) == ["One & two", "Three four"]
    assert tuple(one(spark, X.bio_flags("t"), t="She is a reporter for us. He was formerly a freelance photographer.")) == (True, False, False)
    assert one(spark, X.quoted_headline(F.col("t")), t='An article "Some Words" had') == "Some Words"
    assert one(spark, X.labels(F.col("t"), X.CORRECTION_LABELS), t="Because of an editing error, a picture caption was") == ["photo_caption", "editing_error"]
    assert one(spark, X.token_bag("t"), t="Schlöndorff and this THEATER theater") == ["schlöndorff", "theater"]


def test_gender_looks_for_each_sign_once(spark):
    texts = ["Mrs. Roe met Mr. Poe and Ms. Day", "Duchess Ann", "a painter and his wife", "then she left", "Mx. Roe", "Mr roe", "xSir Al", "Dr. Ann", None, ""]
    texts += ["survived by her children", "the widow of X", "his widow of X", "his  wife", "the father of one, she left and she her"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    found = rows.select("k", X.gender_of("t").alias("g"))
    got = [r.g and tuple(r.g) for r in found.orderBy("k").collect()]
    want = [("F", "honorific"), ("F", "honorific"), ("M", "kinship"), ("F", "pronoun"), ("X", "honorific"), None, None, None, None, None]
    assert got == [*want, ("F", "kinship"), None, *[("M", "kinship")] * 3]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
