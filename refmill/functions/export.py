"""References as CSL, RIS, BibTeX and formatted notes, as native columns of a ``structured`` struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_accents

# Types of records in each format, and what stands for missing fields.
CSL_TYPES = {"article": "article-journal", "web": "webpage", "chapter": "chapter"}
RIS_TYPES = {"article": "JOUR", "web": "WEB", "chapter": "CHAP"}
BIBTEX_TYPES = {"article": "article", "web": "online", "chapter": "incollection"}
NO_AUTHOR, NO_TITLE = "Yazar belirtilmemiş", "Başlık belirtilmemiş"
SCHOLAR, GOOGLE = "https://scholar.google.com/scholar?q=", "https://www.google.com/search?q="


def _typed(kind: Column, types: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in types.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _some(c: Column) -> Column:
    """Null for an empty text."""
    return F.when(c != "", c)


def _joined(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *map(_some, parts))


def extract_doi(display: Column, doi: Column) -> Column:
    found = F.regexp_extract(F.concat_ws(" ", display, F.coalesce(doi, F.lit(""))), r"(?i)(?<![A-Za-z0-9_])(10\.\d{4,9}/[-._;()/:A-Z0-9]+)", 1)
    return F.regexp_replace(found, r"[).,]+$", "")


def status(display: Column, s: Column) -> Column:
    return F.when(extract_doi(display, s["doi"]) != "", "doi-ready").when(s["url"] != "", "url-ready").otherwise("scholar-needed")


def lookup_query(s: Column) -> Column:
    return _joined(" ", s["title"], s["author_text"], s["year"])


def encoded(c: Column) -> Column:
    """As in a link: blanks are %20 and marks that links allow stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def verification_url(s: Column) -> Column:
    query = encoded(lookup_query(s))
    return F.when((s["type"] == "web") & (s["url"] != ""), s["url"]).when(s["type"] == "book", F.concat(F.lit(GOOGLE), query)).otherwise(F.concat(F.lit(SCHOLAR), query))


def verification_target(s: Column) -> Column:
    """struct<kind, label, url>: where a reference can be looked up."""
    kind = F.when((s["type"] == "web") & (s["url"] != ""), "web").when(s["type"] == "book", "google").otherwise("scholar")
    return F.struct(kind.alias("kind"), F.initcap(kind).alias("label"), verification_url(s).alias("url"))


def record(number: Column, display: Column, s: Column, accessed: str) -> Column:
    """The verification record of a reference, ``number`` counting from 1: its fields, its look-up and its exports."""
    target = verification_target(s)
    fields = {
        "id": F.concat(F.lit("src-"), number.cast("string")),
        "display": display,
        "title": F.coalesce(_some(s["title"]), display),
        "author": F.coalesce(s["author_text"], F.lit("")),
        "year": F.coalesce(s["year"], F.lit("")),
        "type": F.coalesce(_some(s["type"]), F.lit("web")),
        "doi": extract_doi(display, s["doi"]),
        "url": F.coalesce(s["url"], F.lit("")),
        "verification_url": target["url"],
        "verification_label": target["label"],
        "verification_kind": target["kind"],
        "query": lookup_query(s),
        "status": status(display, s),
        "csl": csl(number, display, s, accessed),
        "ris": ris(display, s),
        "bibtex": bibtex(display, s),
    }
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def shown_size(n: Column) -> Column:
    """Bytes as B, KB or MB, with one decimal from a kilobyte on."""
    part = lambda unit, name: F.concat(F.format_string("%.1f", n / float(unit)), F.lit(f" {name}"))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, part(1 << 10, "KB")).otherwise(part(1 << 20, "MB"))


def short_authors(authors: Column, most: int = 3) -> Column:
    """The first names, with 'vd.' for more."""
    return F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.when(F.size(authors) > most, " vd.").otherwise(""))


def paragraph_list(paragraphs: Column) -> Column:
    """Numbers of paragraphs as a list to be read; a dash for none."""
    return F.when(F.size(paragraphs) > 0, F.array_join(F.transform(paragraphs, lambda p: p.cast("string")), ", ")).otherwise("-")


def issued_year(s: Column) -> Column:
    """The number a year starts with, else its text."""
    number = F.regexp_extract(s["year"], r"^\s*(\d+)", 1)
    return F.when(number != "", number.cast("int").cast("string")).otherwise(F.coalesce(s["year"], F.lit("")))


def csl(number: Column, display: Column, s: Column, accessed: str) -> Column:
    """A CSL item; null fields are left out by to_json. ``accessed`` is a date, year-month-day."""
    day = F.array(F.array(*(F.lit(int(x)) for x in accessed.split("-"))))
    numeric = F.regexp_extract(s["year"], r"^\s*(\d+)", 1)
    parts = F.when(numeric != "", F.array(F.array(numeric.cast("int"))))
    return F.struct(
        F.concat(F.lit("item-"), number.cast("string")).alias("id"),
        _typed(s["type"], CSL_TYPES, "book").alias("type"),
        F.coalesce(_some(s["title"]), display).alias("title"),
        F.transform(s["authors"], lambda a: F.struct(F.coalesce(_some(a["family"]), a["full"]).alias("family"), F.coalesce(a["given"], F.lit("")).alias("given"))).alias("author"),
        F.when(s["year"] != "", F.struct(parts.alias("date-parts"), F.when(parts.isNull(), s["year"]).alias("literal"))).alias("issued"),
        F.struct(day.alias("date-parts")).alias("accessed"),
        _some(s["url"]).alias("URL"),
        _some(extract_doi(display, s["doi"])).alias("DOI"),
        _some(s["container"]).alias("container-title"),
        _some(s["publisher"]).alias("publisher"),
        _some(s["place"]).alias("publisher-place"),
        display.alias("note"),
    )


def ris(display: Column, s: Column) -> Column:
    line = lambda tag, c: F.concat(F.lit(f"{tag}  - "), _some(c))  # noqa: E731  null for nothing
    authors = F.transform(s["authors"], lambda a: F.concat(F.lit("AU  - "), _joined(", ", F.coalesce(_some(a["family"]), a["full"]), a["given"])))
    head = F.array(F.concat(F.lit("TY  - "), _typed(s["type"], RIS_TYPES, "BOOK")))
    tail = F.array(
        F.concat(F.lit("TI  - "), F.coalesce(_some(s["title"]), display)), line("T2", s["container"]), line("PB", s["publisher"]), line("CY", s["place"]), line("PY", issued_year(s)),
        line("DO", extract_doi(display, s["doi"])), line("UR", s["url"]), F.concat(F.lit("N1  - Original: "), display), F.lit("ER  -"),
    )
    return F.array_join(F.concat(head, authors, F.filter(tail, lambda x: x.isNotNull())), "\n")


def _slug(c: Column) -> Column:
    return F.regexp_replace(without_accents(c), "[^a-zA-Z0-9]+", "")


def bibtex(display: Column, s: Column) -> Column:
    title = F.coalesce(_some(s["title"]), display)
    family = F.get(s["authors"], F.lit(0))
    year = issued_year(s)
    name = F.concat(_slug(F.coalesce(_some(family["family"]), family["full"], F.lit("source"))), F.coalesce(_some(year), F.lit("nodate")), F.left(_slug(title), F.lit(18)))
    authors = F.array_join(F.transform(s["authors"], lambda a: _joined(" ", a["given"], F.coalesce(_some(a["family"]), a["full"]))), " and ")
    field = lambda n, c: F.when(c != "", F.concat(F.lit(f"  {n} = {{"), F.regexp_replace(c, "[{}]", ""), F.lit("}")))
    only = lambda kind: F.when(s["type"] == kind, s["container"])
    fields = F.array(
        field("title", title), field("author", authors), field("year", year), field("journal", only("article")), field("booktitle", only("chapter")), field("publisher", s["publisher"]),
        field("address", s["place"]), field("doi", extract_doi(display, s["doi"])), field("url", s["url"]), field("note", F.concat(F.lit("Original: "), display)),
    )
    return F.concat(F.lit("@"), _typed(s["type"], BIBTEX_TYPES, "book"), F.lit("{"), name, F.lit(",\n"), F.array_join(F.filter(fields, lambda x: x.isNotNull()), ",\n"), F.lit("\n}"))


def _noted(s: Column, author: Column, sep: str) -> Column:
    """Footnote (sep ', ') or bibliography entry (sep '. ')."""
    note = sep == ", "
    name = F.regexp_replace(F.coalesce(_some(author), F.lit(NO_AUTHOR)), r"[.]+$", "")
    after = lambda c: F.coalesce(F.concat(F.lit(sep), _some(c)), F.lit(""))
    access = F.coalesce(F.concat(F.lit(" ("), _some(s["access_date"]), F.lit(")")), F.lit(""))
    date = F.regexp_replace(s["date_text"], r"\.+$", "")
    dated = F.when(s["date_text"] != "", F.concat(F.lit(" (" if note else sep), date, F.lit(")" if note else ""))).otherwise("")
    quoted = F.coalesce(F.concat(F.lit("“"), _some(s["title"]), F.lit("”")), F.lit(NO_TITLE))
    article = F.concat(name, F.lit(sep), quoted, after(s["container"]), dated, after(s["url"]), access, F.lit("."))
    printed = _joined(", ", _joined(": ", s["place"], s["publisher"]), s["year"])
    title = F.coalesce(_some(s["title"]), F.lit(NO_TITLE))
    if note:
        inside = F.when(s["container"] != "", F.concat(s["container"], F.lit(", "), printed)).otherwise(printed)
        book = F.concat(name, F.lit(", "), title, F.lit(" ("), inside, F.lit(")"), after(s["url"]), access, F.lit("."))
    else:
        book = F.concat(name, F.lit(". "), title, after(s["container"]), F.lit(". "), printed, after(s["url"]), access, F.lit("."))
    return F.when(s["type"].isin("article", "web"), article).otherwise(book)


def footnote(s: Column) -> Column:
    return _noted(s, s["author_text"], ", ")


def bibliography_entry(s: Column) -> Column:
    return _noted(s, F.coalesce(_some(s["bibliography_author_text"]), s["author_text"]), ". ")
