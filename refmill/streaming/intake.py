"""A folder as a stream: files that arrive are read, and their citations checked, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import bibliography, citations


def arriving_texts(spark: SparkSession, folder: str, files_per_batch: int = 1_000) -> DataFrame:
    """(path, text) of text files as they arrive in a folder."""
    stream = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    return stream.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def citations_of(texts: DataFrame) -> DataFrame:
    """(path, kind, cit_no, display, keys) of each text's citations; works on a stream, row by row."""
    rows = citations.extracted(texts.select(F.col("path").alias("doc_id"), F.lit(0).alias("para_idx"), "text"))
    return rows.select(F.col("doc_id").alias("path"), "kind", "cit_no", "display", "keys")


def sections_of(texts: DataFrame) -> DataFrame:
    """(path, section) of the texts that have a bibliography."""
    return texts.select("path", bibliography.section(F.col("text")).alias("section")).filter("section is not null")


def write_citations(texts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append citations to a Parquet folder; the checkpoint makes each file count once, through restarts."""
    return citations_of(texts).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
