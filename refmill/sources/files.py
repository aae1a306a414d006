"""Documents from files: DOCX, plain text and PDF token tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trimmed, visible
from ..operators.layout import page_lines
from ..operators.pages import document_markdown

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BREAKS = {f"{_W}br": "\n", f"{_W}cr": "\n", f"{_W}tab": "\t"}
PARTS = "path string, part string, idx int, id string, raw_text string, error string"


def _text(node: ElementTree.Element) -> str:
    """Runs of text in document order, breaks and tabs as characters."""
    out = []
    for child in node:
        if child.tag == f"{_W}t":
            out.append("".join(child.itertext()))
        elif child.tag in _BREAKS:
            out.append(_BREAKS[child.tag])
        else:
            out.append(_text(child))
    return "".join(out)


def docx_rows(path: str, content: bytes) -> list[tuple]:
    """(path, part, idx, id, raw_text, error): paragraphs, and footnotes but for Word's own two; or one error."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if "word/document.xml" not in names:
                return [(path, "error", 0, None, None, "word/document.xml is missing")]
            body = ElementTree.fromstring(z.read("word/document.xml"))
            rows = [(path, "paragraph", i, None, _text(p), None) for i, p in enumerate(body.iter(f"{_W}p"))]
            if "word/footnotes.xml" in names:
                notes = [n for n in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{_W}footnote") if n.get(f"{_W}id") not in ("-1", "0")]
                rows += [(path, "footnote", i, n.get(f"{_W}id"), _text(n), None) for i, n in enumerate(notes)]
            return rows
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        return [(path, "error", 0, None, None, f"{type(e).__name__}: {e}")]


def _read_docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["path", "part", "idx", "id", "raw_text", "error"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):  # one file's rows at a time
            yield pd.DataFrame(docx_rows(path, content), columns=columns)


def docx_parts(files: DataFrame) -> DataFrame:
    """(path, part, idx, id, raw_text, error) of a binaryFile table; a broken file is one error row."""
    return files.select("path", "content").mapInPandas(_read_docx, PARTS)


def paragraphs(parts: DataFrame) -> DataFrame:
    return parts.filter("part = 'paragraph'").select("path", F.col("idx").alias("para_idx"), "raw_text", visible(F.col("raw_text")).alias("text"))


def footnotes(parts: DataFrame) -> DataFrame:
    rows = parts.filter("part = 'footnote'").select("path", F.col("idx").alias("foot_ord"), F.col("id").alias("foot_id"), visible(F.col("raw_text")).alias("text"))
    return rows.filter("text <> ''")


def xml_text(xml: Column) -> Column:
    """Plain text of a document part by its tags alone: breaks and paragraphs are line ends; ampersands come first."""
    out = F.regexp_replace(F.regexp_replace(xml, r"<w:br[^>]*/>", "\n"), r"<w:p[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for code, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return trimmed(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return docx_parts(spark.read.format("binaryFile").load(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


TEXT_ENDINGS = ("txt", "text", "md")


def read_any(spark: SparkSession, path: str, tokens: DataFrame | None = None) -> DataFrame:
    """(path, kind, text) of a folder of mixed files, by their endings: docx, txt, pdf, or unsupported with a null text.

    Each kind has its reader, and their rows make one table. PDF files are decoded elsewhere: ``tokens`` (path, page_no,
    item_no, str, x, y, width) holds what they say; one without tokens is unsupported. A broken DOCX has a null text.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == "paragraph", F.struct("idx", visible(F.col("raw_text")).alias("text"))))), lambda x: x["text"])
    docx = docx_parts(files.filter("ending = 'docx'")).groupBy("path").agg(F.lit("docx").alias("kind"), F.when(F.max("error").isNull(), F.array_join(lines, "\n")).alias("text"))
    plain = files.filter(F.col("ending").isin(*TEXT_ENDINGS)).select("path", F.lit("txt").alias("kind"), F.decode("content", "UTF-8").alias("text"))
    other = files.select("path", "ending").filter((F.col("ending") != "docx") & ~F.col("ending").isin(*TEXT_ENDINGS))
    if tokens is not None:
        said = document_markdown(page_lines(tokens.withColumnRenamed("path", "doc_id"))).select(F.col("doc_id").alias("path"), "text")
        other = other.join(said, "path", "left")
    else:
        other = other.withColumn("text", F.lit(None).cast("string"))
    text = F.when(F.col("ending") == "pdf", F.col("text"))
    return docx.unionByName(plain).unionByName(other.select("path", F.when(text.isNotNull(), "pdf").otherwise("unsupported").alias("kind"), text.alias("text")))


def pasted(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Texts given as they are; under ten characters is an error."""
    if any(len(t.strip()) < 10 for t in texts):
        raise ValueError("a pasted text needs ten characters or more")
    return spark.createDataFrame([(f"pasted-{i}", t) for i, t in enumerate(texts)], "path string, text string")


def pdf_lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, text, min_x, max_x, y) of a token table (doc_id, page_no, item_no, str, x, y, width)."""
    return page_lines(tokens)
