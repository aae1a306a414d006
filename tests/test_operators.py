import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from refmill.functions import export as X
from refmill.operators import citations as OC
from refmill.operators import footnotes as OF
from refmill.operators import layout as L
from refmill.operators import verification as V
from refmill.sources import files, http, reports
from refmill.streaming import intake

REFS = "doc_id long, ref_idx int, keys array<string>, families array<string>, title string"
NOTES = "doc_id long, foot_ord int, foot_id string, text string"


def resolved(spark, notes, refs=()):
    rows = spark.createDataFrame([(1, i, str(i + 1), t) for i, t in enumerate(notes)], NOTES)
    return {(r["foot_ord"], r["part_idx"]): r for r in OF.resolved(rows, spark.createDataFrame(list(refs), REFS)).collect()}


def test_repeats_take_the_last_resolved(spark):
    got = resolved(spark, ["(Smith, 2020)", "A.g.e., s. 50.", "A.g.m., s. 55."])
    assert [got[i, 0]["kind"] for i in range(3)] == ["footnote-inline", "footnote-repeat", "footnote-repeat"]
    assert all(got[i, 0]["keys"] == ["smith:2020"] for i in range(3))
    assert [got[i, 0]["resolved_from"] for i in range(3)] == [None, "1", "2"]


def test_unresolved(spark):
    got = resolved(spark, ["A.g.e., s. 10.", "Burada hiçbir atıf bilgisi yok."])
    assert {r["kind"] for r in got.values()} == {"footnote-unresolved"}


def test_shortened(spark):
    refs = [(1, 0, ["yazıcı:2012"], ["Yazıcı"], "Bir Eğitim-Öğretim Kurumu Olarak Cami"), (1, 1, ["barthold:nodate"], ["Barthold"], "İslam Medeniyeti Tarihi"), (1, 2, ["hodgson:nodate"], ["Hodgson"], "İslam’ın Serüveni")]
    got = resolved(spark, ["Nesimi Yazıcı, “Bir Eğitim-Öğretim Kurumu Olarak Cami”", "Barthold, İslam Medeniyeti Tarihi, 69; Hodgson, İslam’ın Serüveni, 2/472."], refs)
    assert got[0, 0]["keys"] == ["yazıcı:2012"]
    assert [got[1, i]["keys"] for i in (0, 1)] == [["barthold:nodate"], ["hodgson:nodate"]]
    assert {r["kind"] for r in got.values()} == {"footnote-shortened"}


def test_written_out(spark):
    got = resolved(spark, ["Yılmaz, A., Kitap Adı (2020), s. 45.", "Mustafa Diğler- Seçkin Aydın, “Hüsn-i Hat ve Mimarimizdeki Yeri”, 2008.", "Johnson, A., Title (2021)", "Op. cit., p. 30."])
    assert [got[i, 0]["kind"] for i in range(4)] == ["footnote-inline", "footnote-fulltext", "footnote-inline", "footnote-repeat"]
    assert any("2020" in k for k in got[0, 0]["keys"]) and "digler:2008" in got[1, 0]["keys"]


def test_audit(spark):
    from refmill.plans.audit import audit

    text = "As (Smith, 2020) and (Doe, 2019) say.\nAlso Doe (2019).\nReferences\nSmith, J. (2020). A title. Press."
    docs = spark.createDataFrame([(1, text), (2, "No list (Kaya, 2018)."), (3, None)], "doc_id long, text string")
    got = audit(docs)
    assert {(r["doc_id"], r["display"], r["occurrences"]) for r in got["missing"].collect()} == {(1, "Doe, 2019", 2), (2, "Kaya, 2018", 1)}
    d = {r["doc_id"]: r for r in got["diagnostics"].collect()}
    assert (d[1]["paragraphs"], d[1]["body_paragraphs"], d[1]["citations"], d[1]["references"], d[1]["missing"], d[1]["has_bibliography"]) == (4, 2, 3, 1, 2, True)
    assert not d[2]["has_bibliography"] and d[2]["citations"] == 1


def test_semicolons_in_quotes(spark):
    df = spark.createDataFrame([("a “b; c” d; e ; ; f",)], "t string")
    assert df.select(OF.split_parts(F.col("t")).alias("p")).first()["p"] == ["a “b; c” d", "e", "f"]


def test_matched_and_missing_are_all(spark):
    paragraphs = spark.createDataFrame([(1, 0, "One (Smith, 2020; Doe, 2019) and Kaya (2018)."), (1, 1, "Again (Doe, 2019).")], "doc_id long, para_idx int, text string")
    refs = spark.createDataFrame([(1, 0, ["smith:2020"]), (1, 1, ["smith:2020", "kaya:2018"])], "doc_id long, ref_idx int, keys array<string>")
    cites = OC.extracted(paragraphs)
    hit, miss = OC.matched(cites, refs), OC.missing(cites, refs)
    assert hit.count() + miss.count() == cites.count() == 4
    assert {(r["display"], r["ref_idx"]) for r in hit.collect()} == {("Smith, 2020", 0), ("Kaya (2018)", 1)}
    (g,) = OC.grouped(miss).collect()
    assert (g["display"], g["occurrences"], g["paragraphs"]) == ("Doe, 2019", 2, [1, 2])


def test_best_match_takes_the_first_of_ties(spark):
    fields = "title string, authors array<string>, year int, journal string, doi string, isbn string"
    refs = spark.createDataFrame([(1, "A title of some length", ["Doe, J."], 2020, "", "", ""), (2, "Nothing alike", [], None, "", "", "")], f"ref_idx long, {fields}")
    hits = spark.createDataFrame([(1, a, h, s, "A title of some length", ["Doe, J."], 2020, "", "", "") for a, h, s in ((1, 0, "b"), (0, 1, "a"), (0, 0, "a"))], f"ref_idx long, api_rank int, hit_rank int, source string, {fields}")
    rows = {r["ref_idx"]: r for r in V.verified(refs, hits).collect()}
    assert rows[1]["found"] and rows[1]["source"] == "a" and rows[1]["confidence"] == "high"
    assert not rows[2]["found"] and rows[2]["score"] is None
    s = V.statistics(V.verified(refs, hits)).first()
    assert (s["total"], s["found"], s["rate"], s["high_confidence"]) == (2, 1, 50, 1)


@pytest.mark.parametrize(("part", "least", "words"), [(1_000, 2, 9), (3, 2, 9), (1_000, 1, 30), (1_000, 2, 30)])
def test_catalog_candidates_of_common_words(spark, part, least, words):
    """Every word is in many of the works, as in the view that the query reads."""
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(words)]
    titles = [" ".join(rng.sample(vocab[: rng.choice((4, words))], rng.randrange(1, 5 if words < 10 else 4))) for _ in range(50)] + [" ".join(rng.sample(vocab, rng.randrange(1, min(9, words)))) for _ in range(100)] + ["Unseen w1 W2", "the of", ""]
    works = spark.createDataFrame([(i, t, [], 2000, "", "", "") for i, t in enumerate(titles[:140])], "work_id long, title string, authors array<string>, year int, journal string, doi string, isbn string")
    refs = spark.createDataFrame(list(enumerate(titles)), "ref_idx long, title string")
    got = {}
    connector = V.CatalogTableConnector(works.withColumn("journal", F.col("work_id").cast("string")), "c", 0, least=least, part=part)
    for r in connector.candidates(refs).collect():
        got.setdefault(r["ref_idx"], {})[r["hit_rank"]] = int(r["journal"])
    for i, t in enumerate(titles):
        mine = t.lower().split()
        hits = [(t.lower() != o, -n, k) for k, o in enumerate(titles[:140]) if (n := len(set(mine) & set(o.split()))) >= least or t.lower() == o]
        assert [got.get(i, {}).get(k) for k in range(len(got.get(i, {})))] == [k for _, _, k in sorted(hits)[:5]]


def docx(paragraphs, notes=()):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        if notes:
            z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{w}"><w:footnote w:id="0"><w:p/></w:footnote>' + "".join(f'<w:footnote w:id="{i + 1}"><w:p><w:r><w:t>{t}</w:t><w:br/></w:r></w:p></w:footnote>' for i, t in enumerate(notes)) + "</w:footnotes>")
    return out.getvalue()


def test_docx(spark):
    rows = [("a.docx", bytearray(docx(["One  two", "Kaynakça"], ["(Doe, 2019)"]))), ("b.docx", bytearray(b"no zip"))]
    parts = files.docx_parts(spark.createDataFrame(rows, "path string, content binary")).cache()
    assert [r["text"] for r in files.paragraphs(parts).orderBy("para_idx").collect()] == ["One two", "Kaynakça"]
    assert [(r["foot_id"], r["text"]) for r in files.footnotes(parts).collect()] == [("1", "(Doe, 2019)")]
    assert parts.filter("part = 'error'").select("path").first()["path"] == "b.docx"


def test_pdf_lines(spark):
    tokens = [(1, 1, 0, "Hello", 10.0, 700.0, 30.0), (1, 1, 1, "world", 45.0, 701.5, 30.0), (1, 1, 2, "far", 300.0, 700.0, 20.0), (1, 1, 3, "below", 10.0, 650.0, 30.0)]
    df = spark.createDataFrame(tokens, "doc_id long, page_no int, item_no int, str string, x double, y double, width double")
    assert [r["text"] for r in files.pdf_lines(df).orderBy("line_no").collect()] == ["Hello world", "far", "below"]


def test_running_lines_and_paragraphs(spark):
    """Counts are of one document's pages: three of them, and two fifths, at least."""
    one = [(1, p, p * 9, f"Journal of Things {p}") for p in range(1, 5)]
    many = [(2, p, p * 9, "Journal of Things" if p < 4 else f"page {p} of many") for p in range(1, 11)]
    apart = [(d, 1, 0, "Stands on one page each") for d in (3, 4, 5)]
    rows = spark.createDataFrame(one + many + apart, "doc_id long, page_no int, line_no int, line string")
    assert [(r["doc_id"], r["form"], r["pages"]) for r in L.running_lines(rows).orderBy("doc_id", "form").collect()] == [(1, "journal of things", 4), (2, "page of many", 7)]
    assert L.without_running_lines(rows).count() == 3 + 3
    lines = spark.createDataFrame([(9, 0, "A hyphen-"), (9, 1, "ated line"), (9, 2, "ends here."), (9, 3, "New one.")], "doc_id long, line_no int, line string")
    got = L.paragraphs(L.paged(lines, 3)).orderBy("para_idx").collect()
    assert [(r["text"], r["page_no"]) for r in got] == [("A hyphenated line ends here.", 1), ("New one.", 2)]


def test_citations_by_their_place(spark):
    text = "Smith (2020) says so (see Smith, 2020; Smith, 2020; Çelik & World Bank, 2019a), and 😀 Doe et al. (1999)."
    rows = OC.extracted(spark.createDataFrame([(1, 0, text), (1, 1, ""), (1, 2, None)], "doc_id long, para_idx int, text string")).orderBy("cit_no").collect()
    assert [(r["kind"], r["display"]) for r in rows] == [
        ("narrative", "Smith (2020)"), ("parenthetical", "see Smith, 2020"), ("parenthetical", "Smith, 2020"), ("parenthetical", "Çelik & World Bank, 2019a"), ("narrative", "Doe et al. (1999)"),
    ]
    assert [text[r["start"] : r["end"]] for r in rows] == [" (2020)", "(see Smith, 2020; Smith, 2020; Çelik & World Bank, 2019a)"] + ["(see Smith, 2020; Smith, 2020; Çelik & World Bank, 2019a)"] * 2 + [" (1999)"]
    assert rows[3]["keys"] == ["celik:2019a", "worldbank:2019a"]


def test_groups_show_the_first_and_keep_all(spark):
    paragraphs = spark.createDataFrame([(1, 1, "Çelik (2020), and Zeki (2001)."), (1, 0, "Dağ (2000). Smith (2020) says so (see Smith, 2020)."), (1, 2, "Cebeci (2011)")], "doc_id long, para_idx int, text string")
    refs = spark.createDataFrame([], "doc_id long, ref_idx int, keys array<string>")
    groups = OC.in_turkish_order(OC.grouped(OC.missing(OC.extracted(paragraphs), refs))).orderBy("position").collect()
    assert [r["display"] for r in groups] == ["Cebeci (2011)", "Çelik (2020)", "Dağ (2000)", "Smith (2020)", "Zeki (2001)"]
    smith = groups[3]
    assert (smith["occurrences"], smith["paragraphs"], [i["display"] for i in smith["items"]]) == (2, [1], ["Smith (2020)", "see Smith, 2020"])


def test_more_references_than_a_thousand_in_one_paragraph(spark):
    from refmill.plans.audit import references_of

    entries = " ".join(f"Smith, J. ({1950 + i % 70}). Title {i} of things. Press." for i in range(1005))
    rows = spark.createDataFrame([(1, 4, entries, "bibliography"), (1, 5, "Doe, A. (2001). Another title. Press.", "bibliography")], "doc_id long, para_idx int, text string, part string")
    got = references_of(rows).select("ref_idx").collect()
    assert sorted(r["ref_idx"] for r in got) == list(range(1006))


def test_audit_of_footnotes(spark):
    from refmill.plans.audit import audit
    from refmill.sources import reports

    docs = spark.createDataFrame([(1, "A body.\nReferences\nSmith, J. (2020). A title. Press.")], "doc_id long, text string")
    notes = [(1, 0, "1", "(Smith, 2020)"), (1, 1, "2", "Ibid., p. 4."), (1, 2, "3", "(Doe, 2019)"), (1, 3, "4", "A.g.e., s. 50."), (1, 4, "5", "Nothing cited here."), (1, 5, "6", ";")]
    got = audit(docs, spark.createDataFrame(notes, "doc_id long, foot_ord int, foot_id string, text string"))
    assert [(r["group_key"], r["display"], r["occurrences"], r["foot_ids"]) for r in got["missing_footnotes"].collect()] == [("doe:2019", "(Doe, 2019)", 2, ["3", "4"])]
    assert sorted((r["foot_id"], r["part"]) for r in got["unresolved_footnotes"].collect()) == [("5", "Nothing cited here."), ("6", ";")]
    d = got["diagnostics"].first()
    assert (d["footnotes"], d["unresolved_footnotes"], d["citations"], d["references"]) == (6, 2, 0, 1)
    assert reports.audit_report(got, "2024-01-31", footnotes=True).first()["report"].split("\n") == [
        "Date: 2024-01-31", "Citations in footnotes: 6", "References: 1", "Sources missing: 1", "Footnotes not resolved: 2", "", "Sources missing:", "- (Doe, 2019) | 2 times", "", "Footnotes not resolved:",
        "- 5: Nothing cited here.", "- 6: ;", "", "Records:", "- Smith, J. (2020). A title. Press. | scholar-needed",
    ]
    (record,) = got["records"].collect()
    assert (record["id"], record["verification_kind"], record["verification_label"], record["author"]) == ("src-1", "google", "Google", "J. Smith")
    report = reports.audit_report(audit(spark.createDataFrame([(1, "So (Doe, 2019).\nAnd Doe (2019).")], "doc_id long, text string")), "2024-01-31").first()["report"]
    assert "- Doe, 2019 | 2 times | paragraph 1, 2" in report


def test_audit_of_pages(spark):
    from refmill.plans.audit import audit_pages

    texts = {1: ["Journal of Lines", "Smith (2020) found things that", "matter. Doe (2019) did not.", "A second line ends here."], 2: ["Journal of Lines", "More is in the text (Kaya, 2018).", "1 (Smith, 2020) is a note."], 3: ["Journal of Lines", "References", "Smith, J. (2020). A title of some length", "that goes on. Press."]}
    rows = [(1, p, i, t, 50.0, 400.0, 650 - 14 * i) for p, ts in texts.items() for i, t in enumerate(ts)]
    got = audit_pages(spark.createDataFrame(rows, "doc_id long, page_no int, line_no int, text string, min_x double, max_x double, y int"))
    assert sorted(r["display"] for r in got["missing"].collect()) == ["Doe (2019)", "Kaya, 2018"]
    assert [r["display"] for r in got["references"].collect()] == ["Smith, J. (2020). A title of some length that goes on. Press."]
    assert got["diagnostics"].first()["has_bibliography"] and got["unresolved_footnotes"].count() == 0


def test_verification_of_texts(spark):
    from refmill.operators import verification as V
    from refmill.plans.verification import verification

    works = spark.createDataFrame([(1, "Modern Web Development", ["Smith, J."], 2020, "Press", "", ""), (2, "Other Web Things", ["Doe, A."], 2001, "", "", "")], "work_id long, title string, authors array<string>, year int, journal string, doi string, isbn string")
    docs = spark.createDataFrame([(1, "Text.\nReferences\nSmith, J. (2020). Modern Web Development. Press.\nKaya, B. (1999). Never seen anywhere. House."), (2, "Doe, A. (2001). Other web things. House.\nSmith, J. (2020). Modern Web Development. Press.")], "doc_id long, text string")
    got = verification(docs, [V.CatalogTableConnector(works, "catalog", 0)])
    assert {(r["doc_id"], r["original_text"][:4], r["found"]) for r in got["results"].collect()} == {(1, "Smit", True), (1, "Kaya", False), (2, "Doe,", True), (2, "Smit", True)}
    s = got["statistics"].first()
    assert (s["total"], s["found"], s["rate"]) == (4, 3, 75)
    assert V.shown(got["results"], "not-found").count() == 1 and V.shown(got["results"]).count() == 4
    with pytest.raises(ValueError, match="some"):
        V.shown(got["results"], "some")


@pytest.mark.parametrize(
    ("answers", "calls", "ok"),
    [([(200, None, "{}")], 1, True), ([(429, "0", ""), (200, None, "{}")], 2, True), ([(404, None, "")], 1, False), ([(500, None, "")] * 3, 3, False), ([OSError(), (200, None, "{}")], 2, True)],
)
def test_http_retries(answers, calls, ok):
    asked = []

    def opener(url):
        asked.append(url)
        a = answers[len(asked) - 1]
        if isinstance(a, Exception):
            raise a
        return a

    got = http.fetch_json("x", opener, wait=lambda s: None)
    assert (len(asked), got is not None) == (calls, ok)


def test_http_candidates(spark):
    refs = spark.createDataFrame([(1, "A long enough title", ["Doe, J."], 2020, None)], "ref_idx long, title string, authors array<string>, year int, isbn string")

    def fetch(url):
        return {"results": [{"title": "Found", "publication_year": 2020, "doi": "https://doi.org/10.1/x"}]} if "openalex" in url else None

    (row,) = http.candidates(refs, fetch, pause=0).collect()
    assert (row["source"], row["title"], row["doi"], row["api_rank"]) == ("OpenAlex", "Found", "10.1/x", 0)


def test_notes_and_exports(spark):
    author = "struct<family:string,given:string,full:string>"
    schema = f"s struct<title:string,year:string,type:string,container:string,publisher:string,place:string,url:string,doi:string,authors:array<{author}>,author_text:string,bibliography_author_text:string,date_text:string,access_date:string>"
    item = {"title": "Modern Web Development", "year": "2020", "type": "book", "container": "Publishing Press", "publisher": "", "place": "", "url": "", "doi": "", "authors": [{"family": "Smith", "given": "J.", "full": ""}], "author_text": "J. Smith - A. Doe", "bibliography_author_text": "Smith, J. - A. Doe", "date_text": "2020", "access_date": ""}
    df = spark.createDataFrame([(item,)], schema)
    got = df.select(X.footnote(F.col("s")).alias("f"), X.bibliography_entry(F.col("s")).alias("b"), X.bibtex(F.lit("raw"), F.col("s")).alias("t"), F.to_json(X.csl(F.lit(1), F.lit("raw"), F.col("s"), "2024-01-31")).alias("c")).first()
    assert got["f"] == "J. Smith - A. Doe, Modern Web Development (Publishing Press, 2020)."
    assert got["b"] == "Smith, J. - A. Doe. Modern Web Development. Publishing Press. 2020."
    assert got["t"].startswith("@book{Smith2020ModernWebDevelopme,")
    assert '"date-parts":[[2020]]' in got["c"] and "URL" not in got["c"]


def test_report_numbers_sections(spark):
    rows = [(1, 0, "a", True, "x", 90, ""), (1, 1, "b", False, None, None, None), (1, 2, "c", True, "y", 50, "10.1/z")]
    df = spark.createDataFrame(rows, "doc_id long, ref_idx int, original_text string, found boolean, source string, score int, doi string")
    text = reports.verification_report(df, "2024-01-31").first()["report"]
    assert "Rate: 67%" in text and "2. c\n   y | 50/100\n   DOI: 10.1/z" in text and "1. b" in text


def test_stream_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("As shown (Smith, 2020).\nReferences\nSmith, J. (2020). T.")
    for _ in range(2):
        q = intake.write_citations(intake.arriving_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination(60)
    assert [r["display"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Smith, 2020"]


def test_docx_conversion(spark):
    from refmill.functions import records as R
    from refmill.sources import docx_out

    text = ["As shown (Smith, 2020; Doe, 2019) here.", "Kaya (2018) too.", "References", "Smith, J. (2020). A title. Press."]
    src = spark.createDataFrame([("a.docx", bytearray(docx(text, ["old"])))], "path string, content binary")
    paragraphs = files.paragraphs(files.docx_parts(src)).cache()
    refs = R.parsed(paragraphs.filter("para_idx = 3").select("path", F.col("para_idx").alias("ref_idx"), F.col("text").alias("entry")))
    refs = refs.select("path", "ref_idx", "keys", X.footnote(F.col("structured")).alias("footnote"), X.bibliography_entry(F.col("structured")).alias("entry"))
    notes = docx_out.notes_of(docx_out.located(paragraphs.filter("para_idx < 2")), refs)
    books = refs.groupBy("path").agg(F.lit(2).alias("heading"), F.collect_list("entry").alias("entries"))
    out = docx_out.converted(src, notes, books)
    parts = files.docx_parts(out).cache()
    assert [r["text"] for r in files.paragraphs(parts).orderBy("para_idx").collect()] == ["As shown here.", "Kaya too.", "References", "Smith, J. A title. Press, 2020."]
    got = [r["text"] for r in files.footnotes(parts).orderBy("foot_ord").collect()]
    assert got == ["old", "J. Smith, A title (Press, 2020).", "Kaya (2018)"]
    with zipfile.ZipFile(io.BytesIO(out.first()["content"])) as z:
        assert b"footnotes.xml" in z.read("word/_rels/document.xml.rels") and b"footnotes+xml" in z.read("[Content_Types].xml")
