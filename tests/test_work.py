"""Costly columns: spread over tasks however few files there are, and equal to their plainer forms."""

from pyspark.sql import functions as F

from refmill.plans import registry


def test_rows_of_a_small_file_are_dealt_over_tasks(spark):
    for name in ("citations_parenthetical", "citation_keys", "record_parse", "varied_fields", "footnote_split"):
        tasks = registry.QUERIES[name](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and min(t["count"] for t in tasks) > 0, name


def test_texts_are_parted_by_patterns_compiled_once(spark):
    from refmill.functions import text as T

    rows = spark.createDataFrame([("a , b,c",), ("",), (",",), ("a,￿ ,b",), ("plain",), (None,)], "t string")
    for pattern in (r"\s*,\s*", r",(?=\S)"):
        got = rows.select(T.split_at(F.col("t"), pattern).alias("x"), F.split("t", pattern).alias("y")).collect()
        assert [r["x"] for r in got] == [r["y"] for r in got]


def test_keys_of_plain_names_are_those_of_any_name(spark):
    from refmill.functions import text as T

    rows = [("O'Neill-Smith", "2020A"), ("Öztürk", "n. d."), ("YILMAZ", "1999b"), ("Yılmaz", "ts."), ("İnan", "20 20."), ("", "")]
    got = spark.createDataFrame(rows, "a string, y string").select(T.key(F.col("a"), F.col("y")).alias("k")).collect()
    assert [r["k"] for r in got] == ["oneillsmith:2020a", "ozturk:nodate", "yilmaz:1999b", "yılmaz:nodate", "inan:2020", ":"]


def test_blanks_at_the_ends_go_before_a_next_line_sign_they_stay(spark):
    from refmill.functions import text as T

    rows = spark.createDataFrame([("﻿  a b 　\n",), ("a \x85",), (" \t ",), (None,)], "t string")
    assert [r["t"] for r in rows.select(T.trimmed(F.col("t")).alias("t")).collect()] == ["a b", "a \x85", "", None]


def test_references_are_parsed_once_for_all_catalogues(spark):
    from refmill.operators import verification as V
    from refmill.plans.verification import verification

    docs = spark.createDataFrame([(1, "Body.\nReferences\nLee, K. (2020). A tale of two tables. Data Journal, 3(2), 1-9.\nKim, J. (1999). Rows and columns. Data Journal, 4(2), 1-9.")], "doc_id long, text string")
    works = spark.createDataFrame([(1, "A tale of two tables", ["Lee, K."], 2020, "Data Journal", "", "")], "work_id long, title string, authors array<string>, year int, journal string, doi string, isbn string")
    got = verification(docs, [V.CatalogTableConnector(works, "one", 0), V.CatalogTableConnector(works, "two", 1)])
    assert got["references"]._jdf.queryExecution().analyzed().toString().startswith("LogicalRDD")
    assert {(r["ref_no"], r["found"], r["source"]) for r in got["results"].select("ref_idx.ref_no", "found", "source").collect()} == {(0, True, "one"), (1, False, None)}


def test_years_of_written_out_notes(spark):
    from refmill.functions import records as R

    notes = [("Lee, K., Rows. 1999. https://a.example/2020", ["lee:1999"]), ("Lee, K. (see 2001a), Rows of 1999.", ["lee:2001a"]), ("No year here.", None), (None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notes)], "i int, t string").select("i", R.full_text_keys(F.col("t")).alias("k"))
    assert [k and k[:1] for _, k in sorted(map(tuple, rows.collect()))] == [k for _, k in notes]


def test_entries_of_few_bytes_are_parsed_by_all_tasks(spark):
    from refmill.plans import audit as A

    entries = "\n".join(f"Lee, K. ({y}). A tale of two tables. Data Journal, 3(2), 1-9." for y in (2001, 2002))
    docs = spark.createDataFrame([(i, f"Body.\nReferences\n{entries}") for i in range(40)], "doc_id long, text string")
    got = A.kept(A.entries_of(A.kept(A.paragraphs_of(docs))))
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and sum(t["count"] for t in tasks) == 80
    assert {tuple(r) for r in got.filter("doc_id = 7").select("ref_idx", "structured.year").collect()} == {(0, "2001"), (1, "2002")}


def test_footnotes_are_counted_without_looking_for_citations(spark):
    from refmill.plans.audit import audit

    docs = spark.createDataFrame([(1, "Told (Lee, 2020) and (Kim, 1999).\nReferences\nLee, K. (2020). A tale of two tables. Data Journal, 3(2), 1-9."), (2, "Nothing.")], "doc_id long, text string")
    notes = spark.createDataFrame([(1, 1, "1", "(Lee, 2020)"), (1, 2, "2", "Nothing cited.")], "doc_id long, foot_ord long, foot_id string, text string")
    tables = audit(docs, notes)
    got = tables["footnote_diagnostics"]
    assert {"citations", "missing"} == set(tables["diagnostics"].columns) - set(got.columns)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in tables["diagnostics"].select(*got.columns).collect()}
    assert "posexplode" in tables["diagnostics"]._jdf.queryExecution().analyzed().toString() and "posexplode" not in got._jdf.queryExecution().analyzed().toString()


def test_plain_citations_are_read_as_any(spark):
    from refmill.functions import citations as C

    plain = ["Lee, 2020", "see Lee, 1999a", "Lee & Kim, 2020", "see Lee and Kim, 2020b", "Lee ve Lee, 2001", "Seeger, 2020", "Pressman, 2020", "Etal, 2020", "Novak, 2020", "Union, 2020"]
    other = ["See, 2020", "Vdovin, 2020", "Press, 2020", "Lee & Cf, 2020", "Lee, 2020A", "Lee, 2020, s. 5", "Lee and May, 2020", "lee, 2020", "Öztürk, 2020", "World Bank, 2020", "LEE, 2020", "Lee  & Kim, 2020", "Lee, 2020\n"]
    told = ["Lee (2020)", "Lee and Kim (2020a)", "Lee & Lee (1999)", "Mayer (2020)"]
    rows = [("parenthetical", t) for t in plain + other] + [("narrative", t) for t in (*told, "May (2020)", "Lee  (2020)", "Lee et al. (2020)", "Vdovin (2020)")]
    x = F.struct("kind", "text", F.lit(7).alias("start"), F.lit(30).alias("end"))
    got = spark.createDataFrame(rows, "kind string, text string").select("text", F.col("text").rlike(C.PLAIN).alias("plain"), F.array(C._plain(x)).alias("a"), C._read(x).alias("b")).collect()
    assert {r["text"] for r in got if r["plain"]} == {*plain, *told}
    assert [r["text"] for r in got if r["plain"] and r["a"] != r["b"]] == []
