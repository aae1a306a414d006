"""Citations of paragraphs against the bibliography of their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T


#: What numbers a citation in a document.
IDS = ("doc_id", "para_idx", "cit_no")


def extracted(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, cit_no, kind, display, keys, start, end): one row a citation, numbered by its place in the paragraph."""
    return paragraphs.select("doc_id", "para_idx", F.posexplode(C.found(F.col("text"))).alias("cit_no", "c")).select("doc_id", "para_idx", "cit_no", "c.*")


def reference_keys(references: DataFrame) -> DataFrame:
    """(doc_id, key, ref_idx): each key goes to the first reference of its document that has it."""
    return references.select("doc_id", "ref_idx", F.explode("keys").alias("key")).groupBy("doc_id", "key").agg(F.min("ref_idx").alias("ref_idx"))


def looked_up(citations: DataFrame, references: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """Citations with ``ref_idx`` of the first of their keys that a reference owns, else null.

    A citation travels with its keys and is put together again, so that it is extracted once.
    """
    keyed = citations.select("*", F.posexplode_outer("keys").alias("_key_no", "key")).join(reference_keys(references), ["doc_id", "key"], "left")
    owned = F.min(F.when(F.col("ref_idx").isNotNull(), F.struct("_key_no", "ref_idx")))["ref_idx"]
    rest = [F.first(c).alias(c) for c in citations.columns if c not in ids]
    return keyed.groupBy(*ids).agg(*rest, owned.alias("ref_idx")).select(*citations.columns, "ref_idx")


def matched(citations: DataFrame, references: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    return looked_up(citations, references, ids).filter("ref_idx is not null")


def missing(citations: DataFrame, references: DataFrame, ids: tuple[str, ...] = IDS) -> DataFrame:
    """Citations none of whose keys is in their document's bibliography; one without keys is always missing."""
    return looked_up(citations, references, ids).filter("ref_idx is null").drop("ref_idx")


def group_key() -> Column:
    return F.when(F.size("keys") > 0, F.array_join(F.array_sort("keys"), "|")).otherwise(T.key_part(F.col("display")))


def grouped(rows: DataFrame) -> DataFrame:
    """(doc_id, group_key, display, keys, occurrences, paragraphs, items) of missing citations; paragraphs count from 1.

    ``items`` are the occurrences by their place in the document, and the first of them is displayed.
    """
    items = F.array_sort(F.collect_list(F.struct("para_idx", "cit_no", "kind", "display", "keys", "start", "end")))
    got = rows.withColumn("group_key", group_key()).groupBy("doc_id", "group_key").agg(items.alias("items"))
    paragraphs = F.array_distinct(F.transform("items", lambda i: i["para_idx"] + 1))
    return got.select("doc_id", "group_key", F.col("items")[0]["display"].alias("display"), F.col("items")[0]["keys"].alias("keys"), F.size("items").cast("long").alias("occurrences"), paragraphs.alias("paragraphs"), "items")


def in_turkish_order(groups: DataFrame) -> DataFrame:
    """``groups`` with ``position``, from 1 in each document: by the displayed text as Turkish sorts it."""
    order = Window.partitionBy("doc_id").orderBy(F.collate("display", "tr"), "display", "group_key")
    return groups.withColumn("position", F.row_number().over(order))


#: Citations of a document that a list shows.
SHOWN = 80


def shown(citations: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first ``most`` citations of each document with ``position``, from 1; no more travel than may be shown."""
    order = Window.partitionBy("doc_id").orderBy("para_idx", "cit_no")
    return citations.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
