"""Lines of pages and documents: running lines, and paragraphs from lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, trimmed


def by_document(df: DataFrame) -> DataFrame:
    """``df`` dealt by doc_id to the session's number of partitions: little data may be much work, so they stay apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of non-empty lines."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", trimmed(F.col("line"))).filter("line <> ''")


def anchors(values: Column, within: float) -> Column:
    """The values that no earlier one of the array is near to: each starts a level.

    A value belongs to the first level that is near (:func:`level_of`). Only distinct values are gone through, and levels
    lie ``within`` apart, so heights on a page cost little however many lines or tokens share them.
    """
    near = lambda found, v: F.exists(found, lambda a: F.abs(a - v) < within)
    return F.aggregate(F.array_distinct(values), F.array().cast("array<int>"), lambda found, v: F.when(near(found, v), found).otherwise(F.concat(found, F.array(v))))


def level_of(found: Column, value: Column, within: float) -> Column:
    return F.get(F.filter(found, lambda a: F.abs(a - value) < within), F.lit(0))


def neighbours(rows: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of each element and the next."""
    return F.zip_with(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))), F.slice(rows, 2, F.size(rows)), use)


#: Heights that make one line, and the gap that parts a line.
LINE_HEIGHT, LINE_GAP = 4, 50


def page_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, min_x, max_x, y) of tokens (doc_id, page_no, item_no, str, x, y, width).

    A token belongs to the first line within ``LINE_HEIGHT``, by the tokens' order; a gap of over ``LINE_GAP`` parts a
    line; lines go down the page. One shuffle by page; blank tokens, and those without a place, are left out.
    """
    y = F.floor(F.col("y") + 0.5).cast("int").alias("y")
    item = F.struct("item_no", F.col("x").cast("double").alias("x"), F.coalesce(F.col("width").cast("double"), F.lit(0.0)).alias("width"), "str", y)
    pages = tokens.filter((trimmed(F.col("str")) != "") & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    heights = anchors(F.transform("items", lambda t: t["y"]), LINE_HEIGHT)
    placed = lambda h: F.array_sort(F.transform("items", lambda t: F.struct((-level_of(h, t["y"], LINE_HEIGHT)).alias("down"), t["x"].alias("x"), t["item_no"].alias("item_no"), (t["x"] + t["width"]).alias("end"), t["str"].alias("str"))))
    starts = lambda ts: F.concat(F.array(F.lit(1)), neighbours(ts, lambda a, b: F.when((a["down"] == b["down"]) & (b["x"] - a["end"] <= LINE_GAP), 0).otherwise(1)))
    flat = pages.select("doc_id", "page_no", F.explode(bound(bound(heights, placed), lambda ts: F.arrays_zip(ts.alias("t"), starts(ts).alias("new")))).alias("i")).select("doc_id", "page_no", "i.t.*", "i.new")
    order = Window.partitionBy("doc_id", "page_no").orderBy("down", "x", "item_no")
    runs = flat.withColumn("line_no", F.sum("new").over(order) - 1)
    words = F.transform(F.array_sort(F.collect_list(F.struct("x", "item_no", "str", "end"))), lambda t: t["str"])
    lines = runs.groupBy("doc_id", "page_no", "line_no").agg(trimmed(F.array_join(words, " ")).alias("text"), F.min("x").alias("min_x"), F.max_by("end", F.struct("x", "item_no")).alias("max_x"), F.min(-F.col("down")).alias("y"))
    return lines.withColumn("line_no", F.col("line_no").cast("int"))


def running_form(line: Column) -> Column:
    """Lower case, blanks for page numbers, blanks joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"(?<![A-Za-z0-9_])\d{1,4}(?![A-Za-z0-9_])", " "), r"\s+", " "))


#: Pages at least, and the share of a document's pages, on which a running line stands.
LEAST_PAGES, LEAST_SHARE = 3, 0.4


def paged(rows: DataFrame, per_page: int) -> DataFrame:
    """Lines (doc_id, line_no, line) with ``page_no``, from 1."""
    return rows.withColumn("page_no", F.floor(F.col("line_no") / per_page).cast("int") + 1)


def _last_page(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_pages``, if they don't have it: what is grouped by document afterwards stays where it is."""
    return rows if "n_pages" in rows.columns else rows.withColumn("n_pages", F.max("page_no").over(Window.partitionBy("doc_id")))


def enough_pages(pages: Column) -> Column:
    return pages >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("n_pages") * LEAST_SHARE))


def running_lines(rows: DataFrame, least_length: int = 8) -> DataFrame:
    """(doc_id, form, pages): a document's lines that stand on enough of its pages, page numbers aside.

    ``rows`` has doc_id, page_no (from 1) and line, and n_pages if it is known. Pages are gathered before rows are
    shuffled: a form travels once. Lower case makes a line twice as long at most.
    """
    rows = _last_page(rows).filter((F.col("n_pages") >= LEAST_PAGES) & (F.length("line") * 2 >= least_length))
    forms = rows.select("doc_id", "n_pages", "page_no", running_form(F.col("line")).alias("form")).filter(F.length("form") >= least_length)
    pages = F.size(F.collect_set("page_no")).cast("long").alias("pages")
    return forms.groupBy("doc_id", "n_pages", "form").agg(pages).filter(enough_pages(F.col("pages"))).select("doc_id", "form", "pages")


def paged_lines(docs: DataFrame, per_page: int) -> DataFrame:
    """(doc_id, n_pages, page_no, line) of the non-empty lines of (doc_id, text), a page for so many lines of the text.

    A document's pages are counted where it stands, before its lines are rows.
    """
    page = lambda i: F.floor(i / per_page).cast("int") + 1
    each = F.filter(F.transform(F.transform(F.split("text", "\n"), trimmed), lambda t, i: F.struct(page(i).alias("page_no"), t.alias("line"))), lambda x: x["line"] != "")
    whole = docs.select("doc_id", each.alias("_lines")).filter(F.size("_lines") > 0)
    return whole.select("doc_id", F.element_at("_lines", -1)["page_no"].alias("n_pages"), F.explode("_lines").alias("_l")).select("doc_id", "n_pages", "_l.*")


def without_running_lines(rows: DataFrame, least_length: int = 8) -> DataFrame:
    """``rows`` whose form isn't a running line of their document; one shuffle, by document."""
    form = F.when(F.length("line") * 2 >= least_length, running_form(F.col("line")))
    found = _last_page(rows).withColumn("_form", F.when(F.length(form) >= least_length, form))
    found = found.withColumn("_pages", F.size(F.collect_set(F.when(F.col("_form").isNotNull(), F.col("page_no"))).over(Window.partitionBy("doc_id", "_form"))))
    return found.filter(~enough_pages(F.col("_pages"))).select(*rows.columns)


def paragraphs(rows: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text, n_lines) of (doc_id, line_no, line): a line goes on if the one before has no sentence end.

    Lines with a page_no give paragraphs the page on which they start.

    It also goes on after a hyphen, which is dropped, and when it starts in lower case.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.lag("line").over(order)
    goes_on = before.isNotNull() & (before.rlike("-$") | F.col("line").rlike(r"^\p{Ll}") | ~before.rlike("[.?!:]$"))
    numbered = rows.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("para_idx", F.sum("new").over(order) - 1)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    joined = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.rlike("-$") & ~acc.rlike(r"(?i)https?:|www\."), F.concat(F.regexp_replace(acc, "-$", ""), x)).otherwise(F.concat(acc, F.lit(" "), x)))
    pages = [F.min("page_no").alias("page_no")] if "page_no" in rows.columns else []
    return numbered.groupBy("doc_id", "para_idx").agg(joined.alias("text"), F.count("*").alias("n_lines"), *pages)
