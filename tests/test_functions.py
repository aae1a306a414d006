import pytest
from pyspark.sql import functions as F

from refmill.functions import citations as C
from refmill.functions import similarity as S
from refmill.functions import text as T
from refmill.operators import bibliography as B

REC = "title string, authors array<string>, year int, journal string, doi string, isbn string"


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def score(spark, a, b):
    empty = {"title": "", "authors": [], "year": None, "journal": "", "doi": "", "isbn": ""}
    return one(spark, f"a struct<{REC}>, b struct<{REC}>", ({**empty, **a}, {**empty, **b}), S.match_score(F.col("a"), F.col("b")))


@pytest.mark.parametrize(("text", "expected"), [("Kâşifî", "kasifi"), ("İnönü  CAFÉ!", "inonu cafe"), ("", "")])
def test_normalized(spark, text, expected):
    assert one(spark, "t string", (text,), T.normalized(F.col("t"))) == expected


@pytest.mark.parametrize(("author", "year", "expected"), [("Smith", "2020", "smith:2020"), ("Yılmaz", "t.y.", "yılmaz:nodate"), ("YILMAZ", "2019 a", "yilmaz:2019a")])
def test_key(spark, author, year, expected):
    assert one(spark, "a string, y string", (author, year), T.key(F.col("a"), F.col("y"))) == expected


@pytest.mark.parametrize(("text", "expected"), [("Smith, 2020", True), ("2020", False), ("Smith", False)])
def test_looks_like_citation(spark, text, expected):
    assert one(spark, "t string", (text,), C.looks_like_citation(F.col("t"))) is expected


def test_citations_of_both_kinds(spark):
    text = "Metinde bir atıf var (Smith, 2020) ve bir de anlatı atfı var: Yılmaz (2019) makalesinde."
    assert [r["display"] for r in one(spark, "t string", (text,), C.parenthetical(F.col("t")))] == ["Smith, 2020"]
    got = one(spark, "t string", (text,), C.narrative(F.col("t")))
    assert [(r["display"], r["keys"]) for r in got] == [("Yılmaz (2019)", ["yılmaz:2019"])]


@pytest.mark.parametrize("line", ["References", "1. KAYNAKÇA:", "IV) Kaynakca / References", "Bibliography"])
def test_heading(spark, line):
    assert one(spark, "t string", (line,), C.is_references_heading(F.col("t")))


def test_no_heading(spark):
    assert not one(spark, "t string", ("References are many",), C.is_references_heading(F.col("t")))


@pytest.mark.parametrize(("a", "b", "expected"), [("night", "nacht", 0.25), ("aaaa", "aa", 0.5), ("", "", 0.0), ("ab", "ab", 1.0), ("a", "b", 0.0)])
def test_dice(spark, a, b, expected):
    assert one(spark, "a string, b string", (a, b), S.dice(F.col("a"), F.col("b"))) == pytest.approx(expected)


def test_identifiers_decide(spark):
    assert score(spark, {"doi": "10.1234/abc"}, {"doi": "https://doi.org/10.1234/ABC"}) == 100
    assert score(spark, {"isbn": "978-3-16-148410-0"}, {"isbn": "9783161484100"}) == 100


def test_surnames_are_no_substrings(spark):
    base = {"title": "Deep learning methods", "year": 2020}
    exact = score(spark, {**base, "authors": ["Smith, J."]}, {**base, "authors": ["Smith, J."]})
    wrong = score(spark, {**base, "authors": ["Smith, J."]}, {**base, "authors": ["Smithson, J."]})
    assert exact - wrong == 25


def test_name_orders_and_titles(spark):
    base = {"title": "Makine Öğrenmesine Giriş", "year": 2020}
    assert score(spark, {**base, "authors": ["Yılmaz, A."]}, {**base, "authors": ["A. Yılmaz"]}) >= 90
    assert score(spark, {"title": "Café Society Dergisi", "year": 2020}, {"title": "Cafe Society Dergisi", "year": 2020}) >= 60
    assert score(spark, {"title": "The Study of Water", "year": 2020}, {"title": "The Study of Oil", "year": 2020}) < 40


@pytest.mark.parametrize(
    ("part", "expected"),
    [("Yılmaz, A., & Demir, B.", ["Yılmaz, A.", "Demir, B."]), ("Kaya, C.", ["Kaya, C."]), ("Ak, A., Bal, B., & Can, C.", ["Ak, A.", "Bal, B.", "Can, C."])],
)
def test_authors(spark, part, expected):
    assert one(spark, "t string", (part,), B.authors(F.col("t"))) == expected


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Kopetsch, T. (2009) The migration of doctors, Health Policy, 33–39. Labonté, R. ve Schrecker, T. (2007) Globalization, Global Health, 3(6). Leitão, C. A. vd. (2024) Paths, Journal, 2.", 3),
        ("Kaya, C. B. ve Demir, D. (2020) Bir başlık, Dergi, 3(2).", 1),
        ("Smith, J. vd. Ankara (2020) Title, Journal, 1.", 1),
        ("Tek, A. (2021). Tek kaynak. Dergi.", 1),
    ],
)
def test_split_entries(spark, text, n):
    assert len(one(spark, "t string", (text,), B.split_entries(F.col("t")))) == n


def test_entries_by_number_block_and_line(spark):
    split = lambda t: one(spark, "t string", (t,), B.entries_of(F.col("t")))
    assert len(split("1. Ak, A. (2020). Bir.\n2. Bal, B. (2021). İki.")) == 2
    assert split("Ak, A. (2020). Bir\nbaşlık.\n\nBal, B. (2021). İki.") == ["Ak, A. (2020). Bir\nbaşlık.", "Bal, B. (2021). İki."]
    assert split("Ak, A. (2020). Bir\nuzun başlık.\nBal, B. (2021). İki.") == ["Ak, A. (2020). Bir uzun başlık.", "Bal, B. (2021). İki."]


def test_sections(spark):
    text = "Giriş\n## Kaynakça\nAk, A. (2020). Bir.\nAPPENDIX\nx"
    assert one(spark, "t string", (text,), B.section(F.col("t"))) == "Ak, A. (2020). Bir."
    assert one(spark, "t string", ("no heading",), B.section(F.col("t"))) is None
    assert one(spark, "t string", ("Ak, A. (2020). Bir.\nBal, B. (2021). İki.",), B.section_of_plain_text(F.col("t"))) is not None
    assert one(spark, "t string", ("plain words\nand more words",), B.section_of_plain_text(F.col("t"))) is None


def test_parsed_quoted_title(spark):
    df = spark.createDataFrame([(1, "Botezat, A. ve Ramos, R. (2020) “Physicians’ brain drain”, Global Health, 16(12), 1-13."), (2, "short")], "ref_idx long, entry string")
    rows = B.parsed(df).collect()
    assert [(r["year"], r["title"], r["journal"], r["pages"]) for r in rows] == [(2020, "Physicians’ brain drain", "Global Health", "1-13")]
