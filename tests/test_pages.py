import pytest

from refmill.operators import document as D
from refmill.operators import pages as P

LINES = "doc_id long, page_no int, line_no int, text string, min_x double, max_x double, y int"


@pytest.fixture
def lines(spark):
    def make(rows):
        return spark.createDataFrame([(1, *r) for r in rows], LINES)

    return make


def test_margins_and_sections(lines):
    df = D.parted(lines([(1, 0, "top", 10.0, 50.0, 700), (1, 1, "Body text", 10.0, 50.0, 600), (1, 2, "Kaynakça", 10.0, 50.0, 500), (1, 3, "Ak, A. (2020). Bir.", 10.0, 50.0, 400), (2, 0, "EKLER", 10.0, 50.0, 600), (2, 1, "more", 10.0, 50.0, 500)]))
    assert [r["part"] for r in df.orderBy("page_no", "line_no").collect()] == ["body", "heading", "bibliography"]


def test_headers_go(lines):
    rows = [(p, i, t, 10.0, 90.0, y) for p in (1, 2, 3) for i, (t, y) in enumerate([(f"{p} Journal of Things", 630), (f"Ak, A. (202{p}). Bir başlık.", 600), (f"line a{p} of text", 588), (f"line b{p} of text", 576), (f"line c{p} of text", 564), (f"{p}1", 30)])]
    got = [r["text"] for r in D.without_headers(D.listed(lines(rows))).collect()]
    assert len(got) == 12 and not any("Journal" in t or t.isdigit() for t in got)


def test_two_columns(lines):
    rows = [(1, 0, "L1", 10.0, 100.0, 600), (1, 1, "R1", 150.0, 240.0, 600), (1, 2, "L2", 10.0, 100.0, 580), (1, 3, "R2", 150.0, 240.0, 581)]
    assert [r["text"] for r in D.in_columns(D.listed(lines(rows))).orderBy("_page", "_right", "_down", "line_no").collect()] == ["L1", "L2", "R1", "R2"]


def test_bibliography_paragraphs(lines):
    rows = [
        (1, 0, "Ak, A. (2020). A long title that goes", 10.0, 90.0, 600), (1, 1, "on the next line. Some Journal, 1(2),", 20.0, 90.0, 588), (1, 2, "12–20.", 20.0, 90.0, 576), (1, 3, "Bal, B. (2021). Hyphen-", 10.0, 90.0, 564), (1, 4, "ated title. Press.", 20.0, 90.0, 552),
        (2, 0, "Can, C. (2022). Third entry. Press.", 10.0, 90.0, 600),
    ]
    got = [r["text"] for r in D.bibliography(lines(rows)).orderBy("para_idx").collect()]
    assert got == ["Ak, A. (2020). A long title that goes on the next line. Some Journal, 1(2), 12–20.", "Bal, B. (2021). Hyphenated title. Press.", "Can, C. (2022). Third entry. Press."]


def test_markdown(lines):
    rows = [(1, 0, "short", 10.0, 90.0, 630), (1, 1, "INTRODUCTION", 10.0, 90.0, 600), (1, 2, "A first line of a paragraph", 10.0, 90.0, 588), (1, 3, "and its second line here", 10.0, 90.0, 576), (1, 4, "• a point", 10.0, 90.0, 564), (1, 5, "A new paragraph after it all", 10.0, 90.0, 552), (1, 6, "7", 10.0, 90.0, 30)]
    assert P.markdown(lines(rows)).first()["text"] == "\n## INTRODUCTION\n\n\nA first line of a paragraph and its second line here\n\n- a point\n\nA new paragraph after it all"


def test_footnotes_in_body(spark):
    body = spark.createDataFrame([(1, 0, 1, "¹ Yazıcı, Cami Tarihi, 12."), (1, 1, 1, "2. A.g.e., s. 5."), (1, 2, 2, "3 no citation here"), (1, 3, 1, "Plain text.")], "doc_id long, para_idx int, page_no int, text string")
    refs = spark.createDataFrame([(1, 0, ["y:2012"], ["Yazıcı"], "Cami Tarihi")], "doc_id long, ref_idx int, keys array<string>, families array<string>, title string")
    got = P.footnotes_in_body(body, refs).orderBy("foot_ord").collect()
    assert [(r["foot_id"], r["text"]) for r in got] == [("1", "Yazıcı, Cami Tarihi, 12."), ("2", "A.g.e., s. 5.")]
