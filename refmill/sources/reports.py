"""Text reports and export files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import export as X
from ..operators import citations as OC


def _ordered(lines: Column, order: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), lines.alias("line")))), lambda x: x["line"]), sep)


def per_document(records: DataFrame, column: str, sep: str = "\n") -> DataFrame:
    """(doc_id, text): a document's records of ``column`` in order; RIS parts them by a line, BibTeX by two."""
    return records.groupBy("doc_id").agg(_ordered(F.col(column), F.col("ref_idx"), sep).alias("text"))


def csl_json(records: DataFrame, column: str = "csl") -> DataFrame:
    """(doc_id, text): a JSON array of a document's items."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("ref_idx", F.to_json(column).alias("j")))), lambda x: x["j"])
    return records.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("text"))


def export_files(records: DataFrame) -> DataFrame:
    """(doc_id, ris, bibtex, csl): all files of a document, of (doc_id, ref_idx, ris, bibtex, csl), in one aggregation."""
    rows = F.array_sort(F.collect_list(F.struct("ref_idx", "ris", "bibtex", F.to_json("csl").alias("csl"))))
    joined = lambda name, sep: F.array_join(F.transform("rows", lambda x: x[name]), sep)
    files = records.groupBy("doc_id").agg(rows.alias("rows"))
    return files.select("doc_id", joined("ris", "\n").alias("ris"), joined("bibtex", "\n\n").alias("bibtex"), F.concat(F.lit("["), joined("csl", ","), F.lit("]")).alias("csl"))


def write_lines(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.text(path)


def verification_lines(results: DataFrame) -> DataFrame:
    """(doc_id, found, number, line): each result, numbered from 1 in its section.

    ``results`` has doc_id, ref_idx, original_text, found, source, score and doi, and may have isbn, url, authors, year.
    """
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in results.columns else F.lit("")
    told = lambda name, value: F.when(value != "", F.concat(F.lit(f"\n   {name}: "), value)).otherwise("")
    people = F.coalesce(F.array_join("authors", ", "), F.lit("")) if "authors" in results.columns else F.lit("")
    number = F.row_number().over(Window.partitionBy("doc_id", "found").orderBy("ref_idx"))
    head = F.concat(number.cast("string"), F.lit(". "), F.col("original_text"))
    hit = F.concat(F.lit("\n   "), F.col("source"), F.lit(" | "), F.col("score").cast("string"), F.lit("/100"), told("DOI", has("doi")), told("ISBN", has("isbn")), told("URL", has("url")))
    return results.select("doc_id", "found", number.alias("number"), F.concat(head, F.when(F.col("found"), hit).otherwise(F.concat(told("Authors", people), told("Year", has("year"))))).alias("line"))


def verification_report(results: DataFrame, run_date: str) -> DataFrame:
    """(doc_id, report): a summary, what was found, and what was not."""
    lines = verification_lines(results)
    hit, n = F.count_if("found"), F.count("*")
    section = lambda found: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("found") == found, F.struct("number", "line")))), lambda x: x["line"]), "\n\n")
    summary = F.concat(F.lit(f"Date: {run_date}\nReferences: "), n.cast("string"), F.lit("\nFound: "), hit.cast("string"), F.lit("\nNot found: "), (n - hit).cast("string"), F.lit("\nRate: "), F.floor(hit * 100 / n + 0.5).cast("string"), F.lit("%"))
    return lines.groupBy("doc_id").agg(F.concat(summary, F.lit("\n\nFOUND\n\n"), section(True), F.lit("\n\nNOT FOUND\n\n"), section(False)).alias("report"))


def approved(records: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Only the records approved by (doc_id, id), or all if there is no such table."""
    return records if ids is None else records.join(ids, ["doc_id", "id"], "left_semi")


def audit_report(tables: dict[str, DataFrame], run_date: str, footnotes: bool = False) -> DataFrame:
    """(doc_id, report): the offline audit of each document, of its citations in the text or of its footnotes.

    ``tables`` are those of the audit; records that were verified are listed with their status.
    """
    line = lambda df, order, text: df.groupBy("doc_id").agg(_ordered(text, order, "\n").alias("lines"))
    shown = F.concat(F.lit("- "), F.col("display"), F.lit(" | "), F.col("occurrences").cast("string"), F.lit(" times"))
    diagnostics = tables["footnote_diagnostics" if footnotes and "footnote_diagnostics" in tables else "diagnostics"]
    counts = [("Citations in footnotes", "footnotes"), ("References", "references"), ("Sources missing", "missing_sources"), ("Footnotes not resolved", "unresolved_footnotes")] if footnotes else [("Citations", "citations"), ("References", "references"), ("Sources missing", "missing_sources"), ("Citations missing", "missing")]
    groups = OC.in_turkish_order(tables["missing_footnotes" if footnotes else "missing"])
    where = F.lit("") if footnotes else F.concat(F.lit(" | paragraph "), X.paragraph_list(F.col("paragraphs")))
    sections = [("Sources missing", line(groups, F.col("position"), F.concat(shown, where)))]
    if footnotes:
        sections.append(("Footnotes not resolved", line(tables["unresolved_footnotes"], F.struct("foot_ord", "part_idx"), F.concat(F.lit("- "), F.col("foot_id"), F.lit(": "), F.col("part")))))
    sections.append(("Records", line(tables["records"], F.col("ref_idx"), F.concat(F.lit("- "), F.col("display"), F.lit(" | "), F.col("status")))))
    whole = diagnostics.join(groups.groupBy("doc_id").agg(F.count("*").alias("missing_sources")), "doc_id", "left").fillna(0, ["missing_sources"])
    head = [F.lit(f"Date: {run_date}"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in counts)]
    parts = []
    for n, (name, lines) in enumerate(sections):
        whole = whole.join(lines.withColumnRenamed("lines", f"section_{n}"), "doc_id", "left")
        parts.append(F.concat(F.lit(f"\n{name}:\n"), F.coalesce(f"section_{n}", F.lit(""))))
    return whole.select("doc_id", F.concat_ws("\n", *head, *parts).alias("report"))
