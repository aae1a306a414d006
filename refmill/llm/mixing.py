"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

A source's target is its weighted share of all words, at most ``max_copies`` times its own words; what lies
above that is shared again by weight among the others. ``target / source_size`` is a source's mean number of
copies: its whole part is certain for each document. The words that are left are sampled with one copy more, and
longer documents are likelier: a document's inclusion probability is proportional to the bits of its size (the
logarithm), at most 1, such that the expected words are those left. Documents are ranked by the odds of a random
number divided by their inclusion odds, and each source takes the lowest ranks until its words are reached, to the
nearest document: the sample's size in words is fixed and not merely expected.

Nothing of a document is shuffled but its size and key: sums over rank cells find the cell in which a source's words
end, that cell's documents give the last key taken, and each document is decided by comparing its own key with it.

Edge cases: a null or blank text has size 0 and is taken 0 times; a null source is a source of its own, after
all others; an empty table gives an empty result; equal ranks go by doc_id and size; rows that agree in rank, id and
size (repeated rows) are taken or left together; other columns are kept by :func:`mixed` unless their names clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, stored

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Rank cells of a source; the running sum over single documents is only needed within one of them.
CELLS = 1 << 14


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, order: list[Column], sums: tuple[str, ...]) -> DataFrame:
    """``df`` with ``before_n`` and ``before_<sum>`` for each of ``sums``: rows and sums before a row in the whole order.

    Rows are sorted over partitions, so that no task holds all of them; only one row a partition meets in one task.
    """
    spread = stored(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), "in-order")
    rows = {"n": F.lit(1)} | {c: F.col(c) for c in sums}
    parts = spread.groupBy("_part").agg(*(F.sum(c).alias(f"all_{n}") for n, c in rows.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *(F.coalesce(F.sum(f"all_{n}").over(earlier), F.lit(0)).alias(f"all_{n}") for n in rows))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for n, c in rows.items():
        spread = spread.withColumn(f"before_{n}", F.coalesce(F.sum(c).over(within), F.lit(0)))
    spread = spread.join(F.broadcast(parts), "_part")  # one row for each partition
    return spread.select(*df.columns, *((F.col(f"before_{n}") + F.col(f"all_{n}")).alias(f"before_{n}") for n in rows))


def source_targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target: one row per source, of (source, source_size).

    Sorted by cap/weight, the sources that reach their cap are a prefix. The words left over per weight rise
    while sources that exceed their cap are set aside and fall beyond them: the highest level is the right one.
    """
    by_source = F.col("source").asc_nulls_last()
    per = in_order(per.select("source", "source_size"), [by_source], ())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_n") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * max_copies).alias("cap"))
    per = in_order(per, [F.col("cap") / F.col("w"), by_source], ("cap", "w"))
    words, weight = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = per.agg(F.max((F.lit(words) - F.col("before_cap")) / (F.lit(weight) - F.col("before_w")).cast("double"))).first()[0]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w")).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """Reproducible number in (0, 1) of a key: 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def bits(size: Column) -> Column:
    """Of a positive size: 1 + the whole part of its binary logarithm."""
    return F.length(F.bin(size)).cast("long")


def inclusion(classes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, bits, source_size, target, whole, rest, p of each size class of each source, of (source, bits, words).

    ``p`` is proportional to ``bits`` and at most 1, so that the expected words of a source are its ``rest``. Classes
    that reach 1 are the largest; as for targets, the highest level is the right one.
    """
    per = stored(source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), max_copies=max_copies), "mix-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = per.withColumn("whole", F.floor(wanted + 1e-12)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    of = classes.join(per, classes["source"].eqNullSafe(per["source"])).drop(per["source"])
    down = Window.partitionBy("source").orderBy(F.desc("bits"))  # one row for each bit of a size
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("words") * F.col("bits")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    of = of.withColumn("level", F.when(below > 0, (F.col("rest") - above) / below.cast("double")))
    level = F.max("level").over(Window.partitionBy("source"))
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(level * F.col("bits"), F.lit(0.0))))
    return of.withColumn("p", p).select("source", "bits", "source_size", "target", "whole", "rest", "p")


def _plan(sizes: DataFrame, seed: str, max_copies: int) -> DataFrame:
    """For each size class of each source: source, bits, source_size, target, whole, p, edge and last.

    Documents of rank cells before ``edge`` get a copy more, and those of that cell whose key is at most ``last``.
    """
    classes = stored(sizes.groupBy("source", bits(F.col("size")).alias("bits")).agg(F.sum("size").alias("words")), "mix-classes")
    of = stored(inclusion(classes, max_copies), "mix-classes")
    keyed = _keyed(sizes.join(of.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (bits(F.col("size")) == F.col("bits"))), seed)
    keyed = keyed.filter("p > 0 and size > 0")
    cells = keyed.groupBy("source", "rest", "cell").agg(F.sum("size").alias("in_cell"))
    running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.sum("in_cell").over(running))  # at most CELLS rows of a source
    edge = cells.filter("upto > rest and upto - in_cell <= rest").select(F.col("source").alias("_source"), F.col("cell").alias("edge"), (F.col("upto") - F.col("in_cell")).alias("below"))
    edge = stored(edge, "mix-edges")
    # Only one cell of each source is open: its documents go by their running sum, to the nearest end.
    opened = keyed.drop("_source").join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("edge"))).groupBy("source", "rest", "below", "key").agg(F.sum("size").alias("words"))
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("below") + F.sum("words").over(by_key)
    last = opened.withColumn("middle", upto - F.col("words") / 2).filter("middle <= rest").groupBy("source").agg(F.max("key").alias("last"))
    last = edge.select("_source", "edge").join(last, F.col("source").eqNullSafe(F.col("_source")), "left").select(F.col("_source").alias("_edge_source"), "edge", "last")
    out = of.join(last, F.col("source").eqNullSafe(F.col("_edge_source")), "left").drop("_edge_source")
    out = stored(out, "mix-plan")
    drop(classes, of, edge)
    return out


def _keyed(df: DataFrame, seed: str) -> DataFrame:
    """``df`` (doc_id, size, p) with ``key``, by which documents are taken, and ``cell``, which rises with it."""
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    odds = lambda x: x / (1 - x)
    rank = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, odds(u) / odds(F.col("p")))
    key = F.struct(rank.alias("rank"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("size").alias("words"))
    return df.withColumn("key", key).withColumn("cell", F.floor(CELLS * (1 - 1 / (1 + F.col("key.rank")))))


def _decided(df: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``df`` (doc_id, source, size, ...) with source_size, target, inclusion and copies."""
    plan = plan.select(*(F.col(c).alias(f"_{c}") for c in ("source", "bits")), "source_size", "target", "whole", "p", "edge", "last")
    got = _keyed(df.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (bits(F.col("size")) == F.col("_bits"))), seed)
    some = (F.col("p") > 0) & (F.col("size") > 0)
    more = some & F.coalesce((F.col("cell") < F.col("edge")) | ((F.col("cell") == F.col("edge")) & F.coalesce(F.col("key") <= F.col("last"), F.lit(False))), F.lit(True))
    copies = F.when(F.col("size") > 0, F.col("whole") + more.cast("long")).otherwise(0).cast("long")
    return got.withColumn("copies", copies).withColumn("inclusion", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))


def mix(docs: DataFrame, seed: str = "mix", max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, size, source_size, target, inclusion, copies, taken for every row of ``docs`` (doc_id, text, source)."""
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    out = _decided(sizes, _plan(sizes, seed, max_copies), seed)
    return out.select("doc_id", "size", "source_size", "target", "inclusion", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` with ``copies``: how often the mix takes each row. A column of that name is replaced, others stay."""
    inner = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(inner).select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), words(F.col("_row.text")).alias("size"))
    sizes = stored(rows.select("doc_id", "source", "size"), "mix-sizes")
    out = _decided(rows, _plan(sizes, seed, max_copies), seed)
    drop(sizes)
    return out.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "copies"), "copies")


#: DuckDB SQL for :func:`mix`, with plain windows over all documents of a source.
ORACLE = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), per0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sizes GROUP BY source
), per1 AS (
  SELECT source, source_size, 3 * source_size AS cap, CAST((n - 1) % 3 + 1 AS DOUBLE) AS w FROM per0
), per2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per1
), per3 AS (
  SELECT source, source_size, cap, w, max(level) OVER () AS level FROM per2
), per4 AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), level * w) AS target FROM per3
), per5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS wanted FROM per4
), per AS (
  SELECT source, source_size, target, CAST(floor(wanted + 1e-12) AS BIGINT) AS whole, target - floor(wanted + 1e-12) * source_size AS rest FROM per5
), classes AS (
  SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM sizes WHERE size > 0 GROUP BY ALL
), level AS (
  SELECT source, max(l) AS level FROM (
    SELECT c.source, (p.rest - coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / CAST(sum(words * bits) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS l
    FROM classes c JOIN per p ON c.source IS NOT DISTINCT FROM p.source) GROUP BY source
), u AS (
  SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.rest,
     CASE WHEN size > 0 THEN greatest(0.0, least(1.0, l.level * length(bin(size)))) ELSE 0.0 END AS p,
     (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM sizes s JOIN per p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN level l ON s.source IS NOT DISTINCT FROM l.source
), k AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS id, CASE WHEN p >= 1 THEN 0.0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u
), r AS (
  SELECT *, sum(size) OVER (PARTITION BY source, p > 0 ORDER BY rank, id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sum_to,
     sum(size) OVER (PARTITION BY source, p > 0, rank, id, size) AS tied FROM k
), c AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN p > 0 AND sum_to - tied / 2 <= rest THEN 1 ELSE 0 END ELSE 0 END AS copies FROM r
)
SELECT doc_id, size, source_size, target, p AS inclusion, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM c
"""
