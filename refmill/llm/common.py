"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word and blank classes fixed by the contract of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; on a cluster that would part the executors' files, so
    it is an error there.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="refmill-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Folder of this driver's tables below the shared one.
RUN = uuid.uuid4().hex


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/refmill/{RUN}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go as soon as the query that wrote them has ended, so they don't add up over the steps of an operator.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a task that writes a table of a known number of rows.
WRITTEN_ROWS = 200_000


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors.

    With ``rows``, about how many it has at most, a small table is not written as one tiny file for each partition.
    """
    return counted(df, name, rows)[0]


def counted(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, int]:
    """``stored`` and the number of rows written, counted on the way (retried tasks may count twice)."""
    spark = df.sparkSession
    path = scratch(spark, name)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if rows is not None:
        out = out.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // WRITTEN_ROWS)))
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        out.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back, int(seen.get.get("n") or 0)


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            _delete(t.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table this driver has stored; results not yet written or collected can't be read after that."""
    _delete(spark, f"{shared_dir(spark)}/refmill/{RUN}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession, times: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * times


#: Rows of one Arrow batch where the session keeps Spark's own 10,000: texts may be long, and each core holds some batches.
BATCH_ROWS = 1_500


def importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was started, and get small batches."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(BATCH_ROWS))
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), str(Path(__file__).resolve().parents[2])]
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys(p for p in paths if p))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
