"""A dataset of immutable shards with size-tiered compaction and atomically committed manifests.

``append`` writes an arrival as a run: a folder of small shards, one for each task that held rows. ``compact``
merges the runs of one size tier once there are ``FANOUT`` of them: Spark packs whole shards into read partitions
of the target size, so each task rewrites its shards into one file and nothing is shuffled; no key decides where a
row goes, so none can be hot. Every change is a new manifest version: a small file that lists the runs, written
aside and renamed to a name that must not exist yet, so readers see the old or the new version and one of two rival
writers fails. ``vacuum`` deletes runs that none of the latest ``RETAIN`` versions lists.

Layout: ``root/runs/<name>/*.parquet`` and ``root/manifests/v<number>.json``. The manifest holds one entry a run
and runs merge by tiers, so it grows with the logarithm of the data.

Edge cases: an empty arrival adds no run; repeated rows are kept, each once for each time it came; null values and
any columns are kept, but all arrivals must have the same columns; a lost task is rewritten by Spark, and files of
failed attempts are in no manifest. The root may be in any store of Spark's Hadoop configuration whose rename is atomic
and refuses a name that exists, as HDFS and local file systems do; plain object stores need a committer for that.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

FANOUT = 4
TARGET_BYTES = 128 << 20
#: Runs under this size are the lowest tier; each tier above is FANOUT times as large.
SMALLEST = 1 << 20


#: Versions that stay readable.
RETAIN = 4


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardedDataset:
    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, target: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.fanout, self.target = spark, root.rstrip("/"), fanout, target
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- files, through Hadoop's interface: the root may be in any store ------------------------------------

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        return max((int(n[1:-5]) for n in self._names("manifests") if n.startswith("v") and n.endswith(".json")), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        """name, tier, bytes, rows and shards of each run."""
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs().open(self._path(f"manifests/v{version:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))["runs"]
        finally:
            stream.close()

    def _commit(self, base: int, runs: list[dict]) -> int:
        """Write the next version aside and rename it; the name must be free."""
        fs, name = self._fs(), f"manifests/v{base + 1:08d}.json"
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(json.dumps({"version": base + 1, "runs": runs}).encode())
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(self._path(name)), options)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # -- runs ---------------------------------------------------------------------------------------------

    def tier(self, size: int) -> int:
        t, limit = 0, SMALLEST
        while size > limit:
            t, limit = t + 1, limit * self.fanout
        return t

    def _described(self, name: str) -> dict | None:
        """Sizes of a run, from its files' own metadata: no column is read."""
        files = self.spark.read.parquet(f"{self.root}/runs/{name}").groupBy("_metadata.file_path", "_metadata.file_size").count()
        n, size, rows = files.agg(F.count("*"), F.sum("file_size"), F.sum("count")).first()
        return {"name": name, "tier": self.tier(size), "bytes": size, "rows": rows, "shards": n} if rows else None

    def append(self, df: DataFrame) -> int:
        """One arrival; returns the version that holds it."""
        return self.append_all(df, None)

    def append_all(self, df: DataFrame, arrival: str | None) -> int:
        """Arrivals told apart by a column (not stored): written in one pass, each committed as a version of its own."""
        base, runs = self.version(), self.runs()
        name = uuid.uuid4().hex
        out = df.write.option("compression", "zstd")
        if arrival:
            out = out.partitionBy(arrival)
        out.parquet(f"{self.root}/runs/{name}")
        parts = [f"{name}/{p}" for p in self._names(f"runs/{name}") if p.startswith(f"{arrival}=")] if arrival else [name]
        for run in filter(None, map(self._described, sorted(parts))):
            runs = [*runs, run]
            base = self._commit(base, runs)
        return base

    @contextmanager
    def _packed(self):
        """Read partitions of whole shards, up to the target size together."""
        own = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in own}
        for k, v in own.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def compact(self) -> int:
        """Merge every tier that has ``fanout`` runs, until none has; returns the current version."""
        while True:
            base, runs = self.version(), self.runs()
            tiers = sorted({r["tier"] for r in runs})
            full = next((t for t in tiers if sum(r["tier"] == t for r in runs) >= self.fanout), None)
            if full is None:
                return base
            old = [r for r in runs if r["tier"] == full]
            name = uuid.uuid4().hex
            with self._packed():
                self.spark.read.parquet(*(f"{self.root}/runs/{r['name']}" for r in old)).write.option("compression", "zstd").parquet(f"{self.root}/runs/{name}")
            new = self._described(name)
            if new["rows"] != sum(r["rows"] for r in old):
                raise RuntimeError("a merge lost or gained rows; nothing was committed")
            new["tier"] = max(new["tier"], full + 1)
            self._commit(base, [r for r in runs if r["tier"] != full] + [new])

    def vacuum(self, retain: int = RETAIN) -> None:
        """Delete runs that none of the latest ``retain`` versions lists. Not while others read older ones."""
        fs, now = self._fs(), self.version()
        live = {r["name"] for v in range(max(1, now - retain + 1), now + 1) for r in self.runs(v)}
        for top in self._names("runs"):
            if top in live:
                continue
            parts = [f"{top}/{p}" for p in self._names(f"runs/{top}") if "=" in p]
            if not live.intersection(parts):
                fs.delete(self._path(f"runs/{top}"), True)
                continue
            for p in parts:
                if p not in live:
                    fs.delete(self._path(f"runs/{p}"), True)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, with _tier, _shard (file name) and _shard_bytes, which replace columns of these names."""
        out = None
        for r in self.runs(version):
            df = self.spark.read.parquet(f"{self.root}/runs/{r['name']}")
            df = df.select(*(f"`{c}`" for c in df.columns if c not in ("_tier", "_shard", "_shard_bytes")), F.lit(r["tier"]).alias("_tier"), F.col("_metadata.file_name").alias("_shard"), F.col("_metadata.file_size").alias("_shard_bytes"))
            out = df if out is None else out.unionByName(df)
        if out is None:
            raise ValueError("the dataset is empty")
        return out


#: Arrivals that the query models: the first ones are compacted before the rest come.
ARRIVALS, EARLY = 16, 12


def shard(docs: DataFrame, root: str | None = None) -> DataFrame:
    """doc_id, n_bytes, text_sha256, tier, shard, shard_bytes, version: where each document is after all arrivals.

    The documents come as ``ARRIVALS`` arrivals, by a hash of doc_id; compaction runs after the first ``EARLY`` and
    after the rest. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    data = ShardedDataset(spark, root or scratch(spark, "shards"))
    arrival = next(n for n in ("arrival", *(f"arrival_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
    waves = docs.withColumn(arrival, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)).cast("int"))
    for part in (waves.filter(F.col(arrival) < EARLY), waves.filter(F.col(arrival) >= EARLY)):
        data.append_all(part, arrival)
        data.compact()
        data.vacuum()
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = ["doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256")]
    if not data.version():
        return docs.select(*cols, F.lit(0).alias("tier"), F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).alias("version"))
    return data.read().select(*cols, F.col("_tier").alias("tier"), F.col("_shard").alias("shard"), F.col("_shard_bytes").alias("shard_bytes"), F.lit(data.version()).alias("version"))
