"""Page lines of whole documents to numbered paragraphs of body, heading and bibliography.

Lines are dealt by document once. All that follows are windows and aggregations whose keys start with the document, so
Spark sorts within the partitions and shuffles nothing again. Lines decide by themselves and their neighbours whether
they go on; entries are then runs of lines, put together by one join of strings each. Only where an entry may go on
because it ends with its year do its runs of lines need to be read one after the other.

Lines are (doc_id, page_no, line_no, text, min_x, max_x, y); y grows upwards. Null texts are no lines; rows without
a doc_id are one document's; of equal places the order is by text. Other columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions.citations import is_references_heading
from ..functions.text import B, bound, trimmed
from .layout import anchors, by_document, level_of, neighbours
from .pages import GUTTER, SAME_LINE, within_margins

PARTS = ("body", "heading", "bibliography")
# What ends a bibliography, and how lines start that go on.
_APPENDIX = rf"(?i)^(?:EKLER|EK\s+\d+|APPENDIX|APPENDICES){B}"
_LINK_START = r"(?i)^https?://"
_ACCESS_START = rf"(?i)^\(?\s*(?:Son\s+Eri[şŞ]im|Eri[şŞ]im|Tarihi|Access(?:ed|\s+Date)?){B}"
_PAGES_START = rf"^\(?\s*\d{{1,4}}\s*[–-]\s*\d{{1,4}}{B}"
_INITIAL_START = r"^[A-ZÇĞİÖŞÜ]\.(?:\s|$)"
# What ends an entry, what ends a sentence, and what makes a word a link.
_ENDED = r"[.!?][\"”»)\]]?\s*$"
_SENTENCE_END = r"[.?!:]\s*$"
_LINK_MARK = r"/|http|www\."
#: Characters that may follow an entry's year where the entry still goes on.
AFTER_YEAR = 5

#: How lines of a part are read.
_READ = ("_page", "_right", "_down", "line_no", "text")


def _of(*keys: str, by: tuple = ()) -> WindowSpec:
    """Rows of a document that agree in ``keys``; every window's keys start with the document."""
    w = Window.partitionBy("doc_id", *keys)
    return w.orderBy(*by) if by else w


def parted(lines: DataFrame) -> DataFrame:
    """Lines inside the margins, dealt by document, with ``part``; what follows an appendix goes."""
    place = F.struct("page_no", "line_no")
    rows = by_document(within_margins(lines.select("doc_id", "page_no", "line_no", "text", "min_x", "max_x", "y")))
    rows = rows.withColumn("_head", F.min(F.when(is_references_heading(F.col("text")), place)).over(_of()))
    rows = rows.withColumn("_after", F.coalesce(place > F.col("_head"), F.lit(False)))
    rows = rows.withColumn("_end", F.min(F.when(F.col("_after") & F.col("text").rlike(_APPENDIX), place)).over(_of()))
    part = F.when(F.col("_after"), "bibliography").when(place == F.col("_head"), "heading").otherwise("body")
    return rows.filter(F.col("_end").isNull() | (place < F.col("_end"))).withColumn("part", part).drop("_head", "_after", "_end")


def _form(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"^\d{1,4}\s+", ""), r"\s+\d{1,4}$", ""))


def without_headers(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`parted` but for the bibliography's running headers; a body keeps its lines, repeated or not.

    A header stands on three pages, page numbers aside, or apart from a page's other lines, or is a bare number.
    Bibliographies of under five lines stay as they are. A page's usual gap is the upper median of its content.
    """
    mine = F.col("part") == "bibliography"
    pages = lambda c: F.size(F.collect_set(F.when(mine, F.col("page_no"))).over(_of("part", c)))
    rows = rows.withColumn("_f", F.when(mine, _form(F.col("text")))).withColumn("_t", F.when(mine, F.col("text")))
    rows = rows.withColumn("_often", ((F.length("text") >= 3) & (pages("_t") >= 3)) | ((F.length("_f") >= 5) & (pages("_f") >= 3)))
    down = _of("part", "page_no", by=(F.desc("y"), "line_no"))
    rows = rows.withColumn("_n", F.count("*").over(_of("part", "page_no"))).withColumn("_i", F.row_number().over(down)).withColumn("_gap", F.lag("y").over(down) - F.col("y")).withColumn("_next", F.col("y") - F.lead("y").over(down))
    content = F.when(mine & (F.col("_i") > 3) & (F.col("_gap") > 3) & (F.col("_gap") < 50), F.col("_gap"))
    rows = rows.withColumn("_gaps", F.sort_array(F.collect_list(content).over(_of("part", "page_no")))).withColumn("_third", F.max(F.when(F.col("_i") == 3, F.col("_gap"))).over(_of("part", "page_no"))).withColumn("_all", F.count("*").over(_of("part")))
    rows = rows.withColumn("_usual", F.get("_gaps", F.floor(F.size("_gaps") / 2).cast("int"))).drop("_gaps")
    number = F.col("text").rlike(r"^\d{1,4}$")
    top = F.when((F.col("_i") == 1) & (F.col("_next") > F.col("_usual") * 2), ~R.starts_record(F.col("text"))).otherwise(False)
    block = (F.col("_i") <= 2) & (F.col("_third") > F.col("_usual") * 2.5)
    foot = (F.col("_i") == F.col("_n")) & (F.col("_gap") > F.col("_usual") * 2.5) & number
    apart = (F.col("_n") >= 4) & F.coalesce(top | block | foot, F.lit(False))
    goes = mine & (F.col("_all") >= 5) & (F.coalesce("_often", F.lit(False)) | apart | number)
    return rows.filter(~goes).drop("_f", "_t", "_often", "_n", "_i", "_gap", "_next", "_third", "_all", "_usual")


def gutter(lines: Column) -> Column:
    """The upper median middle of a page's gaps between lines of one level, if there are two; else null.

    ``lines`` are structs of line_no, y, min_x and end. Neighbours on a level are neighbours in the order of (level,
    min_x). Heights between the margins are integers, so there are some hundreds at most.
    """
    place = lambda at: F.array_sort(F.transform(lines, lambda r: F.struct(level_of(at, r["y"], SAME_LINE).alias("level"), r["min_x"].alias("min_x"), r["end"].alias("end"))))
    gap = lambda a, b: F.when((a["level"] == b["level"]) & (b["min_x"] - a["end"] > GUTTER), (a["end"] + b["min_x"]) / 2)
    middles = lambda s: F.sort_array(F.filter(neighbours(s, gap), lambda m: m.isNotNull()))
    got = bound(bound(anchors(F.transform(lines, lambda r: r["y"]), SAME_LINE), place), middles)
    return F.when(F.size(lines) >= 3, bound(got, lambda m: F.when(F.size(m) >= 2, F.get(m, F.floor(F.size(m) / 2).cast("int")))))


def in_columns(rows: DataFrame) -> DataFrame:
    """``rows`` with their order of reading: the bibliography's left column first, if its pages show a gutter."""
    end = F.when(F.col("max_x") != 0, F.col("max_x")).otherwise(F.col("min_x") + 200)
    line = F.when(F.col("part") == "bibliography", F.struct("line_no", F.col("y").cast("int").alias("y"), "min_x", end.alias("end")))
    rows = rows.withColumn("_nth", F.row_number().over(_of("part", "page_no", by=("line_no",)))).withColumn("_lines", F.array_sort(F.collect_list(line).over(_of("part", "page_no"))))
    rows = rows.withColumn("_mid", F.when(F.col("_nth") == 1, gutter(F.col("_lines")))).drop("_lines").withColumn("_mid", F.avg("_mid").over(_of("part")))
    centre = (F.col("min_x") + F.when(F.col("max_x") != 0, F.col("max_x")).otherwise(F.col("min_x") + 100)) / 2
    right = F.when(F.col("_mid").isNull() | (centre < F.col("_mid")), 0).otherwise(1)
    down = F.when(F.col("_mid").isNull(), 0).otherwise(-F.col("y"))
    return rows.withColumn("_page", F.col("page_no")).withColumn("_right", right).withColumn("_down", down).drop("_nth", "_mid")


def _goes_on(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_on``: by itself and the line before, a line goes on with that line's paragraph."""
    t, before = F.col("text"), F.col("_before")
    base = F.coalesce(F.min(F.when(F.length("text") > 15, F.col("min_x"))).over(_of("part", "page_no")), F.lit(50.0))
    rows = rows.withColumn("_before", F.lag("text").over(_of("part", by=_READ))).withColumn("_same", F.lag("page_no").over(_of("part", by=_READ)) == F.col("page_no")).withColumn("_base", base)
    rows = rows.withColumn("_hanging", F.avg((F.col("min_x") > F.col("_base") + 5).cast("int")).over(_of("part", "page_no")) > 0.25)
    margin = F.when(F.col("_base") == 0, 50.0).otherwise(F.col("_base"))
    like_more = t.rlike(_LINK_START) | t.rlike(_ACCESS_START) | t.rlike(_PAGES_START) | F.regexp_extract(t, r"(\p{L})", 1).rlike(r"\p{Ll}") | t.rlike(_INITIAL_START)
    indented = F.coalesce(F.col("_same"), F.lit(False)) & F.col("_hanging") & (F.col("min_x") > margin + 4)
    in_entry = F.when(before.endswith("-") | ~before.rlike(_ENDED) | like_more | indented, True).otherwise(~R.starts_record(t))
    in_body = before.endswith("-") | t.rlike(r"^\p{Ll}") | ~before.rlike(_SENTENCE_END)
    on = F.when(before.isNull(), False).when(F.col("part") == "bibliography", in_entry).otherwise(in_body)
    return rows.withColumn("_on", F.coalesce(on, F.lit(False))).drop("_same", "_base", "_hanging")


def _pieces(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_piece``: what a line adds to its paragraph.

    A hyphen at its end goes, and no blank follows, unless the word before is a link, which keeps it. A word may reach
    over several lines: those that hold no blank and follow a hyphen. Signs of a link are four characters at most, so
    three lines before tell whether one reaches over their borders. Only lines that end with a hyphen, which are all that
    a chain has before its last one, are looked through for their last word.
    """
    bare = F.regexp_replace(F.col("text"), "-$", "")
    whole = F.col("_on") & F.col("_before").endswith("-") & ~F.col("text").rlike(r"\s")
    rows = rows.withColumn("_pos", F.row_number().over(_of("part", by=_READ))).withColumn("_word", F.sum(F.when(whole, 0).otherwise(1)).over(_of("part", by=_READ)))
    chain = _of("part", "_word", by=("_pos",))
    last = lambda c: F.when(F.col("text").endswith("-"), F.regexp_extract(c, r"((?<!\S)\S*)$", 1))
    over = F.concat(*(F.coalesce(F.lag(last(bare), k).over(chain), F.lit("")) for k in (3, 2, 1)), last(F.col("text")))
    rows = rows.withColumn("_link", F.max(over.rlike(_LINK_MARK).cast("int")).over(chain) == 1)
    goes_on = F.coalesce(F.lead("_on").over(_of("part", by=_READ)), F.lit(False))
    kept = F.when(F.col("text").endswith("-") & goes_on & ~F.col("_link"), bare).otherwise(F.col("text"))
    blank = F.when(~F.col("_on") | F.col("_before").endswith("-"), "").otherwise(" ")
    return rows.withColumn("_piece", F.concat(blank, kept)).drop("_word", "_link", "_before")


def _runs(rows: DataFrame) -> DataFrame:
    """(doc_id, part, run, page_no, text): lines that surely belong together, joined."""
    rows = rows.withColumn("run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(_of("part", by=("_pos",))))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_piece"))), lambda x: x["_piece"])
    return rows.groupBy("doc_id", "part", "run").agg(F.min_by("page_no", "_pos").alias("page_no"), F.array_join(pieces, "").alias("text"))


def _entry_starts(runs: Column) -> Column:
    """Of runs of which all but the last end with their year: whether each starts an entry.

    An entry goes on after its year if that is the first in parentheses, or there is none in parentheses and the entry
    has not named the year before. So an entry takes in each year once, and what is looked through stays small.
    """
    state = F.struct(F.lit(0).alias("first"), F.lit(False).alias("ends"), F.lit(False).alias("paren"), F.array().cast("array<boolean>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        run = F.get(runs, i)
        new = ~acc["ends"]
        first = F.when(new, i).otherwise(acc["first"])
        had = ~new & acc["paren"]
        named = F.exists(F.slice(runs, first + 1, i - first), lambda r: F.contains(r["text"], run["year"]))
        ends = run["ends"] & ~had & (run["paren"] | ~named)
        return F.struct(first.alias("first"), ends.alias("ends"), (had | run["paren"]).alias("paren"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(runs) - 1), state, step, lambda acc: acc["out"])


def _entries(runs: DataFrame) -> DataFrame:
    """``runs`` put together where a bibliography's entry ends with its year and goes on all the same."""
    order = _of("part", by=("run",))
    year = R.year_at(F.col("text"))
    rows = runs.withColumn("_y", F.when(F.col("part") == "bibliography", year))
    rest = trimmed(F.substr(F.col("text"), F.col("_y.at") + F.length("_y.whole") + 1))
    rows = rows.withColumn("ends", F.coalesce((F.col("_y.whole") != "") & (F.length(rest) < AFTER_YEAR), F.lit(False))).withColumn("year", F.col("_y.whole")).withColumn("paren", F.coalesce(F.startswith("_y.whole", F.lit("(")), F.lit(False)))
    rows = rows.withColumn("chain", F.sum(F.when(F.lag("ends").over(order), 0).otherwise(1)).over(order))
    item = F.struct("run", "page_no", "text", "ends", "year", "paren")
    chains = rows.groupBy("doc_id", "part", "chain").agg(F.array_sort(F.collect_list(item)).alias("runs"))
    starts = F.when(F.size("runs") == 1, F.array(F.lit(True))).otherwise(_entry_starts(F.col("runs")))
    each = chains.select("doc_id", "part", F.explode(F.arrays_zip(F.col("runs").alias("r"), starts.alias("starts"))).alias("x")).select("doc_id", "part", "x.r.run", "x.r.page_no", "x.r.text", "x.starts")
    each = each.withColumn("entry", F.sum(F.col("starts").cast("int")).over(order))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda r: r["text"])
    return each.groupBy("doc_id", "part", "entry").agg(F.min_by("page_no", "run").alias("page_no"), F.array_join(joined, " ").alias("text"))


def listed(lines: DataFrame) -> DataFrame:
    """Lines inside the margins, dealt by document, all of them a bibliography's."""
    return by_document(within_margins(lines.select("doc_id", "page_no", "line_no", "text", "min_x", "max_x", "y"))).withColumn("part", F.lit("bibliography"))


def assembled(rows: DataFrame) -> DataFrame:
    """(doc_id, part, entry, page_no, text) of parted lines: headers gone, columns in order, lines joined."""
    return _entries(_runs(_pieces(_goes_on(in_columns(without_headers(rows))))))


def bibliography(lines: DataFrame) -> DataFrame:
    """(doc_id, para_idx, page_no, text) of a bibliography's lines: one row an entry."""
    return assembled(listed(lines)).select("doc_id", (F.col("entry") - 1).cast("int").alias("para_idx"), "page_no", "text")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, para_idx, part, page_no, text): the body's paragraphs, the heading, and the bibliography's entries.

    ``para_idx`` counts through all of a document's paragraphs from 0; ``page_no`` is where one starts.
    """
    rows = assembled(parted(lines))
    rank = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
    number = F.row_number().over(_of(by=(rank, "entry"))) - 1
    return rows.select("doc_id", number.cast("long").alias("para_idx"), "part", "page_no", "text")
