"""Bibliographies of whole texts checked against catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import bibliography as B
from ..operators import verification as V
from ..operators.keeping import kept


def bibliography_of(text: Column) -> Column:
    """The section after a heading, else lines that look like entries, else the whole text."""
    return F.coalesce(B.section_or_null(text), B.section_of_plain_text(text), text)


def verification(docs: DataFrame, connectors: list[V.CatalogTableConnector]) -> dict[str, DataFrame]:
    """Tables ``references``, ``candidates``, ``results``, ``statistics`` and ``sources`` of (doc_id, text) documents.

    References are numbered over all documents by (doc_id, ref_no), in the column ``ref_idx``: a struct.
    """
    entries = B.references(docs, bibliography_of).withColumnRenamed("ref_idx", "ref_no")
    # Each catalogue reads the references several times, and so do scores and results.
    refs = kept(B.parsed(entries).withColumn("ref_idx", F.struct("doc_id", "ref_no")))
    candidates = V.all_candidates(refs, connectors)
    results = V.verified(refs, candidates).join(refs.select("ref_idx", "original_text", "authors", "year", "doi", "isbn"), "ref_idx").withColumn("doc_id", F.col("ref_idx.doc_id"))
    return {"references": refs, "candidates": candidates, "results": results, "statistics": V.statistics(results), "sources": V.source_distribution(results)}
