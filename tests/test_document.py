"""Page documents against plain versions, line by line."""

import random
import time

import pytest
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from refmill.functions import export as X
from refmill.functions import records as R
from refmill.functions.text import bound, trimmed
from refmill.operators import citations as OC
from refmill.operators import document as D
from refmill.operators import layout as L
from refmill.plans import audit as A
from refmill.sources import files, reports

LINES = "doc_id long, page_no int, line_no int, text string, min_x double, max_x double, y int"
TOKENS = "doc_id long, page_no int, item_no int, str string, x double, y double, width double"


def folded(rows):
    """Entries of bibliography lines in their order of reading, by a fold that looks at all of an entry for each line."""
    read = Window.partitionBy("doc_id").orderBy("_page", "_right", "_down", "line_no", "text")
    page = Window.partitionBy("doc_id", "page_no")
    rows = rows.withColumn("n", F.row_number().over(read)).withColumn("base", F.coalesce(F.min(F.when(F.length("text") > 15, F.col("min_x"))).over(page), F.lit(50.0)))
    rows = rows.withColumn("hanging", F.avg((F.col("min_x") > F.col("base") + 5).cast("int")).over(page) > 0.25).withColumn("same", F.coalesce(F.lag("page_no").over(read) == F.col("page_no"), F.lit(False)))
    t = F.col("text")
    like = [t.rlike(p) for p in (D._LINK_START, D._ACCESS_START, D._PAGES_START, D._INITIAL_START)]
    on = like[0] | like[1] | like[2] | like[3] | F.regexp_extract(t, r"(\p{L})", 1).rlike(r"\p{Ll}") | ~R.starts_record(t) | (F.col("same") & F.col("hanging") & (F.col("min_x") > F.col("base") + 4))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", on.alias("on")))).alias("lines"))

    def joined(text: Column, line: Column) -> Column:
        link = F.regexp_extract(text, r"(\S*)$", 1).rlike(r"/|http|www\.")
        return F.when(text.endswith("-") & link, F.concat(text, line)).when(text.endswith("-"), F.concat(F.regexp_replace(text, "-$", ""), line)).otherwise(F.concat(text, F.lit(" "), line))

    def step(acc: Column, line: Column) -> Column:
        text = F.element_at(acc, -1)
        ends = bound(R.year_at(text), lambda y: (y["whole"] != "") & (F.length(trimmed(F.substr(text, y["at"] + F.length(y["whole"]) + 1))) < 5))
        more = line["on"] | text.endswith("-") | ~text.rlike(r"[.!?][\"”»)\]]?\s*$") | ends
        return F.when(F.size(acc) == 0, F.array(line["text"])).when(more, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined(text, line["text"])))).otherwise(F.concat(acc, F.array(line["text"])))

    return {r["doc_id"]: r["e"] for r in docs.select("doc_id", F.aggregate("lines", F.array().cast("array<string>"), step).alias("e")).collect()}


PIECES = [
    "Ak, A. (2020). A title of some length", "Bal, B. (2021). Another title.", "Can, C. Bare year. Press, 1999.", "Dal, D. Bare year again. Press, 1999.", "Eli, E. Yet another. House, 2001.", "Fan, F. Title with year (1987).", "Gul, G. (t.y.). Undated.",
    "and goes on in lower case.", "12–20.", "https://example.org/a-", "b-", "ww-", "w.site.org/x-", "long-", "C. ve Demir, E. (2001). Başlık.", "(Erişim Tarihi: 01.02.2020).", "Press, 2003.", "Journal of Things, 12(3), 4-5.", "Nothing that starts an entry.", "ab", "2004.", "H. (2005)", "International Commission. (2010). Report.",
]


def test_entries_are_those_of_a_fold(spark):
    rng = random.Random(7)
    rows = []
    for d in range(120):
        lines = [rng.choice(PIECES) if rng.random() < 0.9 else f"{rng.choice(PIECES)} {rng.choice(PIECES)}" for _ in range(rng.randrange(1, 14))]
        rows += [(d, 1 + i // 5, i % 5, t, rng.choice([10.0, 10.0, 20.0]), 90.0, 600 - 12 * (i % 5)) for i, t in enumerate(lines)]
    df = spark.createDataFrame(rows, LINES)
    want = folded(D.in_columns(D.without_headers(D.listed(df))).cache())
    got = {}
    for r in D.bibliography(df).orderBy("doc_id", "para_idx").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == want


def test_a_body_keeps_what_its_pages_repeat(spark):
    body = [(1, p, i, t, 50.0, 400.0, 600 - 12 * i) for p in (1, 2, 3) for i, t in enumerate(["Sample 1 was measured again and again.", f"Smith (202{p}) measured it.", "A Journal of Lines"])]
    refs = [(1, p, i, t, 50.0, 400.0, 600 - 12 * i) for p in (4, 5, 6) for i, t in enumerate((["References"] if p == 4 else []) + ["A Journal of Lines", f"Smith, J. (202{p - 3}). A title of some length", f"that goes on. Press {'ABC'[p - 4]}."])]
    got = A.audit_pages(spark.createDataFrame(body + refs + [(2, 1, 0, "Nothing cited.", 50.0, 400.0, 600), (2, 1, 1, None, 50.0, 400.0, 590), (None, 1, 0, "No id (Doe, 2001).", 50.0, 400.0, 600)], LINES))
    one = got["paragraphs"].filter("doc_id = 1").orderBy("para_idx").collect()
    assert sum("Sample 1" in r["text"] for r in one) == 3 and sum("A Journal" in r["text"] for r in one if r["part"] == "body") == 3
    assert [r["para_idx"] for r in one] == list(range(len(one)))
    heading = next(r for r in one if r["part"] == "heading")
    assert heading["para_idx"] == sum(r["part"] == "body" for r in one) and heading["page_no"] == 4
    assert [(r["text"], r["page_no"]) for r in one if r["part"] == "bibliography"] == [(f"Smith, J. (202{p - 3}). A title of some length that goes on. Press {'ABC'[p - 4]}.", p) for p in (4, 5, 6)]
    d = {r["doc_id"]: r for r in got["diagnostics"].collect()}
    assert (d[1]["citations"], d[1]["missing"], d[1]["references"], d[1]["unparsed"], d[1]["has_bibliography"]) == (3, 0, 3, 0, True)
    assert (d[2]["paragraphs"], d[2]["citations"], d[2]["has_bibliography"]) == (1, 0, False) and d[None]["missing"] == 1


def test_nothing_gives_nothing(spark):
    assert D.paragraphs(spark.createDataFrame([], LINES)).count() == 0 and L.page_lines(spark.createDataFrame([], TOKENS)).count() == 0


def test_documents_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, 1, 0, "x y", 1.0, 2.0, 600)], LINES)
    plan = D.paragraphs(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan and "Pandas" not in plan


def test_a_long_document_takes_time_in_proportion(spark):
    def lines(n):
        i = F.col("id")
        text = F.when(i == 0, "References").when(i % 2 == 1, F.concat(F.lit("Surname, A. ("), (1900 + i % 99).cast("string"), F.lit("). Title "), i.cast("string"), F.lit(" of some length"))).otherwise(F.concat(F.lit("that goes on. Press "), i.cast("string"), F.lit(".")))
        return spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (i / 50).cast("int").alias("page_no"), (i % 50).cast("int").alias("line_no"), text.alias("text"), F.lit(50.0).alias("min_x"), F.lit(400.0).alias("max_x"), (600 - 10 * (i % 50)).cast("int").alias("y"))

    assert D.paragraphs(lines(1_001)).count() == 501
    began = time.time()
    assert D.paragraphs(lines(100_001)).count() == 50_001
    assert time.time() - began < 120


def middle(page):
    """The gutter of one page, line by line."""
    found = []
    for r in sorted(page):
        level = next((x for x in found if abs(x[0] - r[4]) < D.SAME_LINE), None)
        if level is None:
            found.append(level := (r[4], []))
        level[1].append((r[2], r[3] or r[2] + 200))
    middles = sorted((a[1] + b[0]) / 2 for _, row in found for a, b in zip(sorted(row), sorted(row)[1:], strict=False) if b[0] - a[1] > D.GUTTER)
    return middles[len(middles) // 2] if len(page) >= 3 and len(middles) >= 2 else None


def test_gutters_are_those_of_levels_one_by_one(spark):
    rng = random.Random(5)
    pages = [[(i, "t", float(rng.choice([10, 10, 120, 250, 260])), float(rng.choice([0, 90, 100, 200, 240])), rng.randrange(560, 600)) for i in range(rng.randrange(1, 30))] for _ in range(150)]
    rows = spark.createDataFrame([(p, [(i, y, x, e or x + 200) for i, _, x, e, y in page]) for p, page in enumerate(pages)], "p int, lines array<struct<line_no:int,y:int,min_x:double,end:double>>")
    got = {r["p"]: r["m"] for r in rows.select("p", D.gutter(F.col("lines")).alias("m")).collect()}
    assert got == {p: middle(page) for p, page in enumerate(pages)} and any(got.values())


def plain_lines(tokens):
    lines = []
    for _, text, x, y, width in sorted(tokens):
        if text.strip():
            y = int(y + 0.5)
            line = next((k for k in lines if abs(k[0] - y) < L.LINE_HEIGHT), None)
            if line is None:
                lines.append(line := (y, []))
            line[1].append((x, len(line[1]), width, text))
    out = []
    for y, run in sorted(lines, key=lambda k: -k[0]):
        parts = []
        for x, _, width, text in sorted(run):
            if parts and x - parts[-1][2] <= L.LINE_GAP:
                parts[-1] = (f"{parts[-1][0]} {text}", parts[-1][1], x + width)
            else:
                parts.append((text, x, x + width))
        out += [(t.strip(), a, b, y) for t, a, b in parts]
    return out


def test_lines_of_tokens_are_those_made_one_by_one(spark):
    rng = random.Random(6)
    pages = [[(i, rng.choice(["a", "bc", " ", "d e", "f"]), float(rng.randrange(0, 400)), rng.randrange(0, 60) + rng.choice([0.0, 0.5, 0.25]), float(rng.randrange(1, 40))) for i in range(rng.randrange(1, 60))] for _ in range(60)]
    df = spark.createDataFrame([(1, p, *t) for p, page in enumerate(pages) for t in page], TOKENS)
    got = {}
    for r in L.page_lines(df).orderBy("page_no", "line_no").collect():
        got.setdefault(r["page_no"], []).append((r["text"], r["min_x"], r["max_x"], r["y"]))
    assert got == {p: plain_lines(page) for p, page in enumerate(pages) if plain_lines(page)}


def test_mixed_files_make_one_table(spark, tmp_path):
    from test_operators import docx

    (tmp_path / "a.docx").write_bytes(docx(["One  two", "Kaynakça"]))
    (tmp_path / "b.TXT").write_text("Plain\ntext", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.png").write_bytes(b"x")
    (tmp_path / "f.docx").write_bytes(b"no zip")
    (tmp_path / "g").write_bytes(b"no ending")
    at = lambda name: f"file:{tmp_path}/{name}"
    said = [(at("c.pdf"), 1, i, t, 10.0, 700.0 - 20 * i, 100.0) for i, t in enumerate(["INTRODUCTION HERE", "A first line of a paragraph.", "A last line that is long enough."])]
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["text"]) for r in files.read_any(spark, str(tmp_path), spark.createDataFrame(said, TOKENS.replace("doc_id long", "path string"))).collect()}
    assert got["a.docx"] == ("docx", "One two\nKaynakça") and got["b.TXT"] == ("txt", "Plain\ntext") and got["f.docx"] == ("docx", None)
    assert got["c.pdf"][0] == "pdf" and "## INTRODUCTION HERE" in got["c.pdf"][1] and "A first line" in got["c.pdf"][1]
    assert got["d.pdf"] == got["e.png"] == got["g"] == ("unsupported", None) and len(got) == 7
    assert {r["kind"] for r in files.read_any(spark, str(tmp_path)).collect()} == {"docx", "txt", "unsupported"}


def test_pasted_texts_and_parts_of_documents(spark):
    assert [r["path"] for r in files.pasted(spark, ["long enough text", "another long text"]).collect()] == ["pasted-0", "pasted-1"]
    with pytest.raises(ValueError, match="ten characters"):
        files.pasted(spark, ["short"])
    xml = "<w:p><w:r><w:t>A &amp; B</w:t><w:br/><w:t>C</w:t></w:r></w:p><w:p/><w:p/><w:p w:x='1'><w:t>&lt;D&gt;</w:t></w:p>"
    assert spark.range(1).select(files.xml_text(F.lit(xml)).alias("t")).first()["t"] == "A & B\nC\n\n<D>"


def test_approved_records_and_shown_lists(spark):
    records = spark.createDataFrame([(1, "src-1"), (1, "src-2"), (2, "src-1")], "doc_id long, id string")
    assert reports.approved(records, None).count() == 3
    assert [tuple(r) for r in reports.approved(records, spark.createDataFrame([(1, "src-2"), (3, "src-1")], "doc_id long, id string")).collect()] == [(1, "src-2")]
    cites = spark.createDataFrame([(d, p, c, f"{d}-{p}-{c}") for d in (1, 2) for p in range(50) for c in range(d)], "doc_id long, para_idx int, cit_no int, display string")
    got = OC.shown(cites).groupBy("doc_id").agg(F.count("*").alias("n"), F.max_by("display", "position").alias("last"))
    assert {r["doc_id"]: (r["n"], r["last"]) for r in got.collect()} == {1: (50, "1-49-0"), 2: (80, "2-39-1")}
    sizes = spark.createDataFrame([(0,), (1_023,), (1_024,), (1_536,), (1_048_576,), (5_452_595,)], "n long")
    assert [r[0] for r in sizes.select(X.shown_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.2 MB"]
    names = spark.createDataFrame([(["A", "B", "C"],), (["A", "B", "C", "D"],), ([],)], "a array<string>")
    assert [r[0] for r in names.select(X.short_authors(F.col("a"))).collect()] == ["A, B, C", "A, B, C vd.", ""]


def test_isnad_bibliography_keeps_its_order(spark):
    docs = spark.createDataFrame([(1, "So (Doe, 2019).\nReferences\nSmith, J. (2020). A title. Press.\n– – – – –.\nDoe, A. (2019). Other. House.")], "doc_id long, text string")
    got = A.audit(docs)
    assert [(r["position"], r["text"].split(",")[0]) for r in got["bibliography"].orderBy("position").collect()] == [(1, "Smith"), (2, "Doe")]
    assert [r["entry"] for r in got["unparsed"].collect()] == ["– – – – –."]
    d = got["diagnostics"].first()
    assert (d["candidates"], d["unparsed"], d["references"], d["missing"]) == (3, 1, 2, 0)


def test_long_words_in_a_line_cost_their_length(spark):
    word = "a" * 200_000
    rows = [(1, 1, 1, f"{word} b", 50.0, 500.0, 600), (1, 1, 2, f"{word} hy-", 50.0, 500.0, 588), (1, 1, 3, f"phen {word}.", 50.0, 500.0, 576), (1, 1, 4, "See http://a.example/x-", 50.0, 500.0, 564), (1, 1, 5, "y.", 50.0, 500.0, 552)]
    lines = spark.createDataFrame(rows, LINES)
    began = time.time()
    got = [r["text"] for r in D.paragraphs(lines).orderBy("para_idx").select("text").collect()]
    assert got == [f"{word} b {word} hyphen {word}.", "See http://a.example/x-y."]
    assert time.time() - began < 60


def test_headings_of_bibliographies_hold_one_of_few_words(spark):
    from refmill.functions import citations as C

    rows = [("Kaynakça", True), ("  KAYNAKLAR: ", True), ("5. Reference  list", True), ("IV) References / Kaynakça", True), ("bibliography", True), ("References are many", False), ("A list", False), ("", False), (None, None)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", C.is_references_heading(F.col("t")).alias("got")).collect()
    assert [r["t"] for r in got if r["got"] != r["want"]] == []
