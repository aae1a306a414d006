"""The offline audit of whole documents: which citations have no entry in the bibliography."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import export as X
from ..functions import records as R
from ..functions.citations import is_references_heading
from ..functions.text import visible
from ..operators import bibliography as B
from ..operators import citations as OC
from ..operators import document as D
from ..operators import footnotes as OF
from ..operators import pages as P
from ..operators.layout import by_document
from ..operators.keeping import kept


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text, part) of (doc_id, text): lines, blanks joined; part is body, heading or bibliography.

    Without a heading all is body. A document's lines are parted where they stand, without a shuffle.
    """
    lines = docs.select("doc_id", F.transform(F.split("text", "\n"), visible).alias("lines"))
    head = F.array_position(F.transform("lines", is_references_heading), F.lit(True))
    rows = lines.withColumn("head", head).select("doc_id", "head", F.posexplode("lines").alias("para_idx", "text"))
    at = F.col("para_idx") + 1
    part = F.when((F.col("head") == 0) | (at < F.col("head")), "body").when(at == F.col("head"), "heading").otherwise("bibliography")
    return rows.select("doc_id", "para_idx", "text", part.alias("part"))


def entries_of(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ref_idx, para_idx, entry, display, keys, structured) of bibliography paragraphs, entries that run together apart.

    An entry that doesn't parse has nulls. Entries are dealt once more, as what a window shuffles is put into few tasks
    by its bytes, and parsing is much work for few bytes.
    """
    bare = F.regexp_replace("text", r"^\s*\[\d+\]\s*", "")
    entries = by_document(paragraphs.filter("part = 'bibliography' and length(text) > 5").select("doc_id", "para_idx", F.posexplode(B.split_entries(bare)).alias("part_no", "entry")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("para_idx", "part_no")) - 1
    return R.parsed(entries.withColumn("ref_idx", number.cast("long")).drop("part_no"), unparsed=True)


def references_of(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ref_idx, para_idx, display, keys, structured): the entries that parse."""
    return entries_of(paragraphs).filter("keys is not null").drop("entry")


FOOT_IDS = ("doc_id", "foot_ord", "part_idx")


def audited_footnotes(footnotes: DataFrame, references: DataFrame) -> dict[str, DataFrame]:
    """Tables ``footnotes`` (parts with kind and keys), ``missing_footnotes`` (grouped) and ``unresolved_footnotes``.

    ``footnotes`` has doc_id, foot_ord, foot_id, text; ``references`` doc_id, ref_idx, keys, title, families. A part
    with keys is missing if no reference of its document owns one of them, and a part without keys is unresolved.
    """
    parts = kept(OF.resolved(footnotes, references))
    gaps = OC.missing(parts.filter(F.size("keys") > 0), references, FOOT_IDS)
    order = F.struct("foot_ord", "part_idx", "foot_id", "part", "keys")
    groups = gaps.withColumn("display", F.col("part")).withColumn("group_key", OC.group_key()).groupBy("doc_id", "group_key").agg(F.array_sort(F.collect_list(order)).alias("items"))
    first = F.col("items")[0]
    groups = groups.select("doc_id", "group_key", first["part"].alias("display"), first["keys"].alias("keys"), F.size("items").cast("long").alias("occurrences"), F.array_distinct("items.foot_id").alias("foot_ids"))
    return {"footnotes": parts, "missing_footnotes": groups, "unresolved_footnotes": parts.filter(F.size("keys") == 0)}


def records(references: DataFrame, accessed: str) -> DataFrame:
    """(doc_id, ref_idx, id, display, ...): the verification record of each reference, numbered in its document from 1."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_idx"))
    rows = references.withColumn("number", number).select("doc_id", "ref_idx", X.record(F.col("number"), F.col("display"), F.col("structured"), accessed).alias("r"))
    return rows.select("doc_id", "ref_idx", "r.*")


def isnad_bibliography(references: DataFrame) -> DataFrame:
    """(doc_id, position, ref_idx, text): a document's bibliography in its own order, numbered from 1; empty entries go."""
    rows = references.select("doc_id", "ref_idx", X.bibliography_entry(F.col("structured")).alias("text")).filter("text <> ''")
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("ref_idx")).alias("position"), "ref_idx", "text")


#: What ``diagnostics`` counts: column, kind of fact, and whether only flagged ones count.
COUNTS = (
    ("paragraphs", ("body", "heading", "bibliography"), False), ("body_paragraphs", ("body",), False), ("candidates", ("entry",), False), ("unparsed", ("entry",), True),
    ("citations", ("citation",), False), ("missing", ("citation",), True), ("footnotes", ("footnote",), False), ("footnote_parts", ("footnote", "part"), False), ("unresolved_footnotes", ("footnote", "part"), True),
)


def diagnostics(paragraphs: DataFrame, entries: DataFrame, citations: DataFrame | None, parts: DataFrame | None) -> DataFrame:
    """One row a document: what ``COUNTS`` lists, references, and whether there is a bibliography; one aggregation.

    Facts are a document, a kind and a flag: entries are flagged if they don't parse, citations if nothing owns them,
    a footnote's parts if they don't resolve (the first part stands for the footnote). Without ``citations`` there are
    no counts of them.
    """
    fact = lambda df, kind, flag: df.select("doc_id", kind.alias("kind"), flag.alias("flag"))
    facts = fact(paragraphs, F.col("part"), F.lit(False)).unionByName(fact(entries, F.lit("entry"), F.col("keys").isNull()))
    if citations is not None:
        facts = facts.unionByName(fact(citations, F.lit("citation"), F.col("ref_idx").isNull()))
    if parts is not None:
        facts = facts.unionByName(fact(parts, F.when(F.col("part_idx") == 0, "footnote").otherwise("part"), F.size("keys") == 0))
    of = lambda kinds, flagged: F.count_if(F.col("kind").isin(*kinds) & (F.col("flag") if flagged else F.lit(True)))
    counts = facts.groupBy("doc_id").agg(*(of(kinds, flagged).alias(name) for name, kinds, flagged in COUNTS if citations is not None or kinds != ("citation",)), (of(("heading",), False) > 0).alias("has_bibliography"))
    return counts.withColumn("references", F.col("candidates") - F.col("unparsed"))


def _audited(paragraphs: DataFrame, entries: DataFrame, footnotes: DataFrame | None, accessed: str) -> dict[str, DataFrame]:
    """The tables of an audit, of (doc_id, para_idx, part, text) paragraphs and the bibliography's entries."""
    refs = entries.filter("keys is not null").drop("entry")
    cites = OC.looked_up(OC.extracted(paragraphs.filter("part = 'body'")), refs)
    out = {"paragraphs": paragraphs, "citations": cites.drop("ref_idx"), "references": refs, "missing": OC.grouped(cites.filter("ref_idx is null")), "records": records(refs, accessed)}
    out |= {"unparsed": entries.filter("keys is null").select("doc_id", "ref_idx", "para_idx", "entry"), "bibliography": isnad_bibliography(refs)}
    if footnotes is not None:
        out |= audited_footnotes(footnotes, _titled(refs))
        out["footnote_diagnostics"] = diagnostics(paragraphs, entries, None, out["footnotes"])
    return out | {"diagnostics": diagnostics(paragraphs, entries, cites, out.get("footnotes"))}


def _titled(refs: DataFrame) -> DataFrame:
    return refs.select("doc_id", "ref_idx", "keys", "structured.title", F.col("structured.authors.family").alias("families"))


def audit(docs: DataFrame, footnotes: DataFrame | None = None, accessed: str = "2024-01-31") -> dict[str, DataFrame]:
    """Tables ``paragraphs``, ``citations``, ``references``, ``unparsed``, ``missing`` (grouped), ``records``,
    ``bibliography`` and ``diagnostics`` of (doc_id, text) documents.

    With ``footnotes`` (doc_id, foot_ord, foot_id, text) also those of :func:`audited_footnotes`, which are counted too,
    and ``footnote_diagnostics``: the diagnostics but for citations in the text, which need not be looked for then.
    """
    paragraphs = kept(by_document(paragraphs_of(docs)))
    return _audited(paragraphs, kept(entries_of(paragraphs)), footnotes, accessed)


def audit_pages(lines: DataFrame, accessed: str = "2024-01-31") -> dict[str, DataFrame]:
    """The tables of :func:`audit`, footnotes included, of page lines (doc_id, page_no, line_no, text, min_x, max_x, y).

    Running headers go and columns are put in order in the bibliography only; the body keeps every line inside the
    margins. Footnotes are the body's paragraphs that start with a number and cite something.
    """
    paragraphs = kept(D.paragraphs(lines))
    entries = kept(entries_of(paragraphs))
    body = paragraphs.filter("part = 'body'")
    notes = P.footnotes_in_body(body, _titled(entries.filter("keys is not null")))
    return _audited(paragraphs, entries, notes, accessed)
