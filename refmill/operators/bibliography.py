"""Bibliography texts to records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, split_at, trimmed

# Headings that open a bibliography, and those that end it.
_HEADER = r"(?:^|\n)\s*(?:#+\s*)?(?i:Kaynak[çÇ]a|Kaynaklar|References|Bibliography|Referanslar)\s*\n"
_APPENDIX = r"(?:^|\n)\s*(?:#+\s*)?(?i:EKLER|EK\s+\d+|APPENDIX|APPENDICES)(?![A-Za-z0-9_])"
_CAPITAL = "A-ZÇĞİÖŞÜ"
# Words before a full stop that end no entry.
ABBREVIATIONS = ("vd", "al", "vb", "vs", "ed", "eds", "der", "ders", "bkz", "cev", "haz", "no", "vol", "nr", "jr", "sr", "dr", "prof", "pp", "ss", "bs", "c")
_BOUNDARY = (
    rf"(?:(?<=[)\]\"”»])|(?<=\.)(?<!(?<!\p{{L}})(?:\p{{L}}|(?i:{'|'.join(ABBREVIATIONS)}))\.)(?<!(?i://|www|http).{{0,15}}\.))"
    rf"\s+(?=[{_CAPITAL}][^\n]{{0,90}}?\((?:19|20)\d{{2}}[a-z]?\))"
)
_YEAR = r"(?<![A-Za-z0-9_])(?:19|20)\d{2}[a-z]?(?![A-Za-z0-9_])"


def section(text: Column) -> Column:
    """The bibliography after the first heading, up to an appendix; null without a heading."""
    after = trimmed(F.regexp_extract(text, f"(?s)^.*?{_HEADER}(.*)$", 1))
    cut = F.split(after, _APPENDIX, 2)[0]
    return F.when(text.rlike(_HEADER), trimmed(cut))


def section_or_null(text: Column) -> Column:
    """The same if it is longer than ten characters, for page texts."""
    return F.when(F.length(section(text)) > 10, section(text))


def section_of_plain_text(text: Column) -> Column:
    """After the heading, appendices included; without one, the whole text if half its lines look like entries."""
    after = trimmed(F.regexp_extract(text, f"(?s)^.*?{_HEADER}(.*)$", 1))
    lines = F.filter(F.split(text, "\n"), lambda x: trimmed(x) != "")
    alike = F.filter(lines, lambda x: trimmed(x).rlike(rf"^\s*(?:\d+[.)]\s*)?[{_CAPITAL}]") & x.rlike(r"\(\d{4}\)|(?<![A-Za-z0-9_])\d{4}(?![A-Za-z0-9_])"))
    whole = (F.size(lines) >= 2) & (F.size(alike) >= F.size(lines) * 0.5)
    return F.when(text.rlike(_HEADER) & (F.length(after) > 10), after).when(whole, trimmed(text))


#: Stands before what starts an entry while texts are joined and parted again; no text holds this code point.
_MARK = "\uffff"


def _parted(marked: Column) -> Column:
    """Texts joined by blanks, parted before marks: one pass, however many there are."""
    return F.filter(F.split(F.array_join(marked, " "), f" {_MARK}"), lambda x: x != "")


def split_entries(text: Column) -> Column:
    """Entries that run together, parted before 'Name ... (year)'; a part without a year goes to the one before."""
    pieces = F.filter(split_at(trimmed(text), _BOUNDARY), lambda p: p != "")

    first = lambda p, i: F.when((i > 0) & ~p.rlike(_YEAR), p).when(i > 0, F.concat(F.lit(_MARK), trimmed(p))).otherwise(trimmed(p))
    merged = _parted(F.transform(pieces, first))
    return F.filter(merged, lambda e: F.length(e) > 5)


def authors(part: Column) -> Column:
    """Names of an author part; a comma parts them only after an initial. Ten at most."""
    marked = F.regexp_replace(F.regexp_replace(part, r"\s*[&;]\s*", "|"), r"(?i)\s+(?:ve|and)\s+", "|")
    marked = F.regexp_replace(marked, r"\.\s*,\s*", ".|")
    names = F.transform(F.split(marked, r"\|"), lambda a: F.regexp_replace(trimmed(a), rf"^(?:{SPACE}|[,;&])+|(?:{SPACE}|[,;&])+$", ""))
    return F.slice(F.filter(names, lambda a: (F.length(a) > 1) & ~a.rlike(r"^\d")), 1, 10)


def clean_title(c: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"\.\s*$", ""), "^\\s*[\"'“”‘’]|[\"'“”‘’]\\s*$", ""))


def container(rest: Column) -> Column:
    """The journal or book that follows a title: up to a volume or the word for 'in'."""
    upto = F.regexp_extract(rest, r"^(.+?)\s*,\s*[(\d]", 1)
    c = F.when(upto != "", upto).otherwise(rest)
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"(?is)\s+[iİ]çinde(?![A-Za-z0-9_]).*$", ""), r"[\s,.:]+$", ""))


def parsed(entries: DataFrame, text: str = "entry") -> DataFrame:
    """``entries`` with original_text, authors, year, title, journal, pages, doi, isbn; without a title a row goes."""
    t = trimmed(F.regexp_replace(F.col(text), r"^\s*(?:\d+[.)]\s*|\[\d+\]\s*)", ""))
    doi_re, isbn_re = r"(?i)(?:doi:\s*|https?://doi\.org/)?(10\.\d{4,}/[^\s,;]+)", r"(?i)ISBN(?:-1[03])?:?\s*((?:97[89][-\s]?)?(?:\d[-\s]?){9}[\dX])"
    df = entries.filter(F.length(text) >= 10).withColumn("original_text", t)
    df = df.withColumn("doi", F.regexp_replace(F.regexp_extract("original_text", doi_re, 1), r"[.)]+$", ""))
    df = df.withColumn("isbn", F.regexp_replace(F.regexp_extract("original_text", isbn_re, 1), r"[-\s]", ""))
    first_gone = lambda c, whole: F.when(whole != "", F.concat(F.left(c, F.instr(c, whole) - 1), F.substr(c, F.instr(c, whole) + F.length(whole)))).otherwise(c)
    bare = first_gone(F.col("original_text"), F.regexp_extract("original_text", doi_re, 0))
    df = df.withColumn("_b", trimmed(bare))
    df = df.withColumn("_b", trimmed(F.regexp_replace(trimmed(first_gone(F.col("_b"), F.regexp_extract("_b", isbn_re, 0))), r"[,.\s\-–]+$", "")))
    year_re = r"\(((?:19|20)\d{2})[a-z]?\)"
    dated = F.col("_b").rlike(year_re)
    df = df.withColumn("_before", F.regexp_replace(trimmed(F.regexp_extract("_b", rf"(?s)^(.*?){year_re}", 1)), r"[,;\s]+$", ""))
    df = df.withColumn("_after", F.regexp_replace(trimmed(F.regexp_extract("_b", rf"(?s)^.*?{year_re}(.*)$", 2)), r"^[.\s]+", ""))
    quote_re, title_re = r"^[\"“«]\s*(.+?)\s*[\"”»]", rf"^(.+?)(?:\s+,\s|,\s+[{_CAPITAL}][^,:]*:|\.\s+|$)"
    quoted = F.col("_after").rlike(quote_re)
    head = F.when(quoted, F.regexp_extract("_after", quote_re, 0)).otherwise(F.regexp_extract("_after", title_re, 0))
    df = df.withColumn("_rest", F.regexp_replace(F.substr(F.col("_after"), F.length(head) + 1), r"^[\s,]+", ""))
    df = df.withColumn("_plain", F.when(~dated, split_at(F.col("_b"), r"\.\s+")))
    plain = F.col("_plain")
    title = F.when(quoted, F.regexp_extract("_after", quote_re, 1)).otherwise(F.regexp_extract("_after", title_re, 1))
    several = F.size(plain) >= 2
    df = df.withColumn("year", F.when(dated, F.regexp_extract("_b", year_re, 1).cast("int")))
    df = df.withColumn("authors", F.when(dated, authors(F.col("_before"))).when(several, authors(plain[0])).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("title", clean_title(F.when(dated, title).when(several, plain[1]).otherwise(F.col("_b"))))
    df = df.withColumn("journal", F.when(dated, container(F.col("_rest"))).when(F.size(plain) > 2, trimmed(F.regexp_replace(F.get(plain, F.lit(2)), r"\.\s*$", ""))).otherwise(""))
    pages = r"(?:pp?\.\s*|s\.\s*|:?\s*)(\d+)\s*[-–]\s*(\d+)"
    df = df.withColumn("pages", F.when(F.col("original_text").rlike(pages), F.concat_ws("-", F.regexp_extract("original_text", pages, 1), F.regexp_extract("original_text", pages, 2))).otherwise(""))
    found = ("original_text", "authors", "year", "title", "journal", "pages", "doi", "isbn")
    keep = [c for c in entries.columns if c not in found]
    # An explode, as a filter on the title would be pushed below all of the above and repeat it.
    record = F.explode(F.filter(F.array(F.struct(*found)), lambda r: r["title"] != ""))
    return df.select(*keep, record.alias("_r")).select(*keep, "_r.*")


_NUMBER = r"^(?:\d+[.)]\s*|\[\d+\]\s*)"
# How an entry of 'Surname, A.' starts.
_NAME = rf"[{_CAPITAL}][a-zA-ZçğıöşüÇĞİÖŞÜ.'’-]+"
_STRICT_AUTHOR = rf"^(?:\d+[.)]\s*|\[\d+\]\s*)?{_NAME}(?:\s+{_NAME})*,\s*[{_CAPITAL}]\."


def starts_entry(line: Column) -> Column:
    """Numbered, 'Surname, A.', or capitalised with a year in parentheses."""
    return line.rlike(_NUMBER) | line.rlike(_STRICT_AUTHOR) | (line.rlike(f"^[{_CAPITAL}]") & line.rlike(r"\((?:19|20)\d{2}[a-z]?\)"))


def _merged(lines: Column) -> Column:
    """Lines joined to the one before unless they start an entry."""
    return _parted(F.transform(lines, lambda line, i: F.when((i > 0) & starts_entry(line), F.concat(F.lit(_MARK), line)).otherwise(line)))


def entries_of(section_text: Column) -> Column:
    """Entries of a bibliography: numbered ones, else blocks between blank lines, else single lines.

    A block is parted at lines that start an entry; one that starts none goes on with the entry before.
    """
    clean = lambda xs: F.filter(F.transform(xs, trimmed), lambda x: x != "")
    numbered = clean(F.split(section_text, r"\n\s*(?=\d+[.)]\s|\[\d+\]\s)"))
    blocks = clean(F.split(section_text, r"\n\s*\n"))
    lines_of = lambda b: clean(F.split(b, "\n"))
    later = lambda ls: F.exists(F.slice(ls, 2, F.greatest(F.size(ls) - 1, F.lit(0))), starts_entry)
    pieces = F.flatten(F.transform(blocks, lambda b: F.when(later(lines_of(b)), _merged(lines_of(b))).otherwise(F.array(b))))
    by_block, by_line = _merged(pieces), _merged(lines_of(section_text))
    is_numbered = section_text.rlike(r"(?:^|\n)\s*(?:\d+[.)]\s*|\[\d+\]\s*)") & (F.size(numbered) > 1)
    return F.when(is_numbered, numbered).when(F.size(by_block) > 1, by_block).otherwise(by_line)


def references(docs: DataFrame, part: Callable[[Column], Column] = section) -> DataFrame:
    """(doc_id, ref_idx, entry) of the bibliographies of (doc_id, text), which ``part`` takes from a text; numbers keep its order."""
    found = docs.select("doc_id", F.explode(F.filter(F.array(part(F.col("text"))), lambda s: s.isNotNull())).alias("s"))
    blocks = found.select("doc_id", F.posexplode(entries_of(F.col("s"))).alias("block", "e"))
    parts = blocks.select("doc_id", "block", F.posexplode(split_entries(F.col("e"))).alias("part", "entry"))
    order = Window.partitionBy("doc_id").orderBy("block", "part")
    return parts.withColumn("ref_idx", F.row_number().over(order) - 1).select("doc_id", "ref_idx", "entry")
