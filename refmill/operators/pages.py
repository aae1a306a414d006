"""Lines of PDF pages: margins, Markdown, and footnotes among a body's paragraphs.

Lines are (doc_id, page_no, line_no, text, min_x, max_x, y); y grows upwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.text import trimmed
from .footnotes import ANY_QUOTE, REPEAT, shortened
from .layout import without_running_lines

# The margins of a page, and the distances that part lines.
TOP, BOTTOM = 640, 25
SAME_LINE, GUTTER = 6, 20


def within_margins(lines: DataFrame) -> DataFrame:
    """Lines between the margins, of two characters or more."""
    return lines.withColumn("text", trimmed(F.col("text"))).filter(F.col("y").between(BOTTOM, TOP) & (F.length("text") > 1))


# Headings of sections, and how an entry starts.
_HEADING = r"(?i)^(Kaynak[çÇ]a|Kaynaklar|References|Bibliography|Referanslar|Ekler|Ek\s+\d+|Appendix|Appendices)"
_NEW_ENTRY = r"^(?:\d+[.)]\s*|\[\d+\]\s*)?[A-ZÇĞİÖŞÜ][a-zA-ZçğıöşüÇĞİÖŞÜ\s'-]+?,\s*[A-ZÇĞİÖŞÜ]"


def markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): each page with headings, list items and paragraphs; numbers and page ends go."""
    page = Window.partitionBy("doc_id", "page_no")
    order = page.orderBy("line_no")
    t = trimmed(F.col("text"))
    df = lines.withColumn("t", t).filter("t <> ''").withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(page))
    capitals = F.length("t").between(4, 99) & (F.col("t") == F.upper("t")) & F.col("t").rlike("[A-ZÇĞİÖŞÜ]{2,}")
    heading = capitals | (F.col("t").rlike(r"^\d+(\.\d+)*\s+[A-ZÇĞİÖŞÜa-zçğıöşü]") & (F.length("t") < 80)) | F.col("t").rlike(_HEADING)
    short_end = ((F.col("_i") == 1) | (F.col("_i") == F.col("_n"))) & (F.length("t") < 25)
    kind = F.when(heading, "heading").when(F.col("t").rlike(r"^[•⁃▪\-*]\s+.+"), "bullet").when(F.col("t").rlike(r"^\d+[.)]\s+.+"), "item").otherwise("text")
    df = df.withColumn("kind", kind).filter(~F.col("t").rlike(r"^\d+$") & ((F.col("kind") == "heading") | ~short_end))
    far = F.abs(F.lag("y").over(order) - F.col("y")) > 18
    back = F.col("min_x") < F.lag("min_x").over(order) - 8
    same = (F.col("kind") == "text") & (F.lag("kind").over(order) == "text") & ~far & ~back & ~F.col("t").rlike(_NEW_ENTRY)
    df = df.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("_block", F.sum("_new").over(order))
    shown = F.when(F.col("kind") == "heading", F.concat(F.lit("\n## "), F.col("t"), F.lit("\n"))).when(F.col("kind") == "bullet", F.concat(F.lit("- "), F.regexp_replace("t", r"^[•⁃▪\-*]\s+", ""))).otherwise(F.col("t"))
    ordered = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    blocks = df.withColumn("shown", shown).groupBy("doc_id", "page_no", "_block").agg(F.array_join(ordered("line_no", "shown"), " ").alias("block"))
    return blocks.groupBy("doc_id", "page_no").agg(F.array_join(ordered("_block", "block"), "\n\n").alias("text"))


def document_markdown(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of each document without its running lines, as Markdown, parted by blank lines."""
    kept = without_running_lines(lines.withColumn("line", F.col("text"))).drop("line")
    pages = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return markdown(kept).groupBy("doc_id").agg(F.array_join(F.transform(pages, lambda p: p["text"]), "\n\n").alias("text"))


def footnotes_in_body(paragraphs: DataFrame, references: DataFrame) -> DataFrame:
    """(doc_id, foot_ord, foot_id, text, page_no) of body paragraphs that start with a number and cite something.

    ``paragraphs`` has doc_id, para_idx, page_no, text; ``references`` as for shortened citations.
    """
    start = r"^\s*([¹²³⁴⁵⁶⁷⁸⁹⁰\d]+)\s*[.\s-]*\s*(\p{L}.*)$"
    rows = paragraphs.filter(F.col("text").rlike(start)).withColumn("foot_id", F.translate(F.regexp_extract("text", start, 1), "¹²³⁴⁵⁶⁷⁸⁹⁰", "1234567890")).withColumn("part", trimmed(F.regexp_extract("text", start, 2)))
    plain = F.col("part").rlike(REPEAT) | F.col("part").rlike(ANY_QUOTE) | (R.year_at(F.col("part"))["whole"] != "")
    rows = rows.withColumn("plain", plain).withColumn("foot_ord", F.col("para_idx")).withColumn("part_idx", F.lit(0))
    short = shortened(rows.filter("not plain").select("doc_id", "foot_ord", "part_idx", "part"), references).select("doc_id", "foot_ord", F.lit(True).alias("short"))
    kept = rows.join(short, ["doc_id", "foot_ord"], "left").filter("plain or short")
    order = Window.partitionBy("doc_id").orderBy("page_no", F.col("foot_id").cast("long"), "para_idx")
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("foot_ord"), "foot_id", F.col("part").alias("text"), "page_no")
