"""Near-duplicate vectors: an exact range join in the metric space of angles.

Vectors with cosine >= ``THRESHOLD`` are those within the angle r = acos(THRESHOLD), and angles are a metric. Each
distinct vector lives in the cell of its nearest pivot and is copied to another cell p only if something in p
could be within r of it. By the triangle inequality, it can't be if its angle to p exceeds its angle to its own
pivot by more than 2r, or p's radius by more than r; nor if its distance to the plane between the pivots exceeds
the chord of r. Of two cells only the one of the smaller number gets the copy, so a pair meets once.

Within a cell, vectors within r/2 of the pivot are its core: all of them link with each other, which takes no
comparison, so a hot group of near copies costs its size. Vectors farther than 3r/2 from the pivot can't link with
the core. What is left is compared in blocks of ``BLOCK`` by ``BLOCK``, each a group of its own; blocks return
counts and links that keep components, never pairs. Equal vectors are one row with a count throughout.

The pivots are a bounded sample, as their number is a parameter that doesn't change results. Data without clusters
are copied to most cells: no metric index prunes them, and the join then costs what comparing all blocks costs.

Edge cases: null, zero and non-finite vectors, and those of another length than most, link with nothing and are
their own component; repeated rows with one vec_id are one vector; a null vec_id links with nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored
from .graph import components
from .shingles import mixed
from .vectors import batches_of, common_length, matrix, unit, usable

THRESHOLD = 0.9
#: Vectors of a cell, on average, and pivots at most: they go to every task.
CELL, MOST_PIVOTS = 8_192, 4_096
BLOCK = 4_096
#: Rows of a block that are compared at a time, and links of them that are kept as indices.
SLAB, SPARSE = 512, 1 << 16
#: Added to bounds on angles, far above their rounding.
SLACK = 1e-6
CORE, REST, COPY = 0, 1, 2


#: Vectors times pivots that are looked at together, and rows of a batch of copies.
AT_ONCE, BATCH = 1 << 20, 10_000
#: Cosine of two pivots beyond which the plane between them says nothing.
ALIKE = 1 - 1e-9


def _placed(pivots: np.ndarray, radius: np.ndarray | None, r: float):
    """Rows (cell, kind, angle, ...) of each vector: its home, and with radii known its copies.

    Memory is bounded however many pivots there are and copies a vector gets: few vectors meet the pivots together,
    and copies leave in batches.
    """
    chord = 2 * np.sin(r / 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, max(1, min(2_000, AT_ONCE // len(pivots)))):
            u = unit(matrix(b["vec"], pivots.shape[1]))
            cos = u @ pivots.T
            angle = np.arccos(np.clip(cos, -1, 1))
            home = angle.argmin(axis=1)
            own = angle[np.arange(len(u)), home]
            row, cell, kind = np.arange(len(u)), home, np.where(own <= r / 2 - SLACK, CORE, REST)
            if radius is not None:
                reach = (angle - own[:, None] <= 2 * r + SLACK) & (angle <= radius[None, :] + r + SLACK)
                reach &= np.arange(len(pivots))[None, :] < home[:, None]
                alike = pivots[home] @ pivots.T
                gap = np.sqrt(np.maximum(2 - 2 * np.minimum(alike, ALIKE), 1e-9))
                reach &= (alike > ALIKE) | ((cos[np.arange(len(u)), home][:, None] - cos) / gap <= chord + SLACK)
                i, p = np.nonzero(reach)
                row, cell, kind = np.concatenate([row, i]), np.concatenate([cell, p]), np.concatenate([kind, np.full(len(i), COPY)])
            at = angle[row, cell]
            for a in range(0, len(row), BATCH):
                k = slice(a, a + BATCH)
                take = b.take(pa.array(row[k]))
                yield pa.record_batch([take["vec_id"], take["n"], pa.array(cell[k].astype(np.int32)), pa.array(kind[k].astype(np.int32)), pa.array(at[k]), take["vec"]], names=["vec_id", "n", "cell", "kind", "angle", "vec"])

    return run


_PLACED = "vec_id long, n long, cell int, kind int, angle double, vec array<double>"


def _blocked(chunks: dict[tuple[int, int], int], r: float):
    """Rows (cell, left, right, side, ...) of each placed vector, for every block it has a part in.

    Chunks of the core meet chunks of the rest and of copies that can link with it; chunks of the rest meet each
    other and the copies. A chunk is named by its kind and a hash of the id; a block by its cell and its two chunks.
    """

    cells = max((c for c, _ in chunks), default=0) + 1
    number = np.zeros((cells, 3), dtype=np.int64)
    for (c, k), n in chunks.items():
        number[c, k] = n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4_000):
            cell, kind, near = b["cell"].to_numpy().astype(np.int64), b["kind"].to_numpy().astype(np.int64), b["angle"].to_numpy() <= 1.5 * r + 2 * SLACK
            own = (mixed(b["vec_id"].to_numpy().view(np.uint64)) % number[cell, kind].astype(np.uint64)).astype(np.int64)
            for other in (CORE, REST, COPY):
                meets = (kind != other) if other != REST else np.ones(len(kind), dtype=bool)  # only the rest meets its own kind
                if other == CORE:
                    meets &= near
                times = np.where(meets, number[cell, other], 0)
                row = np.repeat(np.arange(len(kind)), times)
                theirs = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = kind[row] << 32 | own[row]
                that = other << 32 | theirs
                left, right = np.minimum(mine, that), np.maximum(mine, that)
                side = np.where(mine == that, 2, np.where(mine == left, 0, 1))
                for a in range(0, len(row), BATCH):
                    k = slice(a, a + BATCH)
                    take = b.take(pa.array(row[k], pa.int64()))
                    yield pa.record_batch([pa.array(cell[row[k]].astype(np.int32)), pa.array(left[k]), pa.array(right[k]), pa.array(side[k].astype(np.int32)), take["vec_id"], take["n"], take["vec"]], names=["cell", "left", "right", "side", "vec_id", "n", "vec"])

    return run


def _linked(threshold: float, dim: int):
    """Of a block: vec_id, links (with equal vectors counted), root (smallest id of its links' component here)."""

    def run(t: pa.Table) -> pa.Table:
        side, ids, n = (t[c].to_numpy() for c in ("side", "vec_id", "n"))
        u = unit(matrix(t["vec"], dim))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links, slabs = np.zeros(len(ids)), []
        # A slab of rows at a time: its links are counted at once and kept as indices, or as bits where there are many.
        for a in range(0, len(left), SLAB):
            rows = left[a : a + SLAB]
            hit = u[rows] @ u[right].T >= threshold
            hit[rows[:, None] == right[None, :]] = False
            links[rows] += hit @ n[right]
            once = np.flatnonzero(side[rows] != 2)  # within one chunk a pair shows from either end
            links[right] += n[rows[once]] @ hit[once]
            i, j = np.nonzero(hit) if np.count_nonzero(hit) <= SPARSE else (None, np.packbits(hit, axis=1))
            slabs.append((rows, i, j))
        root = ids.copy()
        none = np.iinfo(np.int64).max
        while True:
            before = root.copy()
            for rows, i, j in slabs:
                if i is not None:
                    np.minimum.at(root, rows[i], root[right[j]])
                    np.minimum.at(root, right[j], root[rows[i]])
                    continue
                hit = np.unpackbits(j, axis=1, count=len(right)).astype(bool)
                root[rows] = np.minimum(root[rows], np.where(hit, root[right][None, :], none).min(axis=1))
                root[right] = np.minimum(root[right], np.where(hit, root[rows][:, None], none).min(axis=0))
            if (before == root).all():
                break
        some = links > 0
        return pa.table({"vec_id": pa.array(ids[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(root[some], pa.int64())})

    return run


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``df`` (vec_id, embedding)."""
    r = float(np.arccos(threshold))
    good = usable(df)
    every = stored(good.withColumn("key", F.xxhash64("vec")), "vectors")
    dim = common_length(every)
    good = every.filter(F.size("vec") == dim)
    # Equal vectors are one: the digest groups them before the vector itself is compared.
    distinct = stored(good.groupBy("key", "vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")), "distinct-vectors")
    total = distinct.count()
    out = df.select(F.col("vec_id").cast("long").alias("vec_id"))
    plain = out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return plain
    n_pivots = min(MOST_PIVOTS, max(1, -(-total // cell)))
    pivots = unit(np.array([x["vec"] for x in distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("vec").collect()], dtype=np.float64))
    homes = distinct.select("vec_id", "n", "vec").mapInArrow(_placed(pivots, None, r), _PLACED)
    # Of each cell: one row to the driver.
    stats = homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.min(F.when(F.col("kind") == CORE, F.col("vec_id"))).alias("core_id"), F.sum(F.when(F.col("kind") == CORE, F.col("n"))).alias("core_n")).collect()
    radius = np.full(len(pivots), -np.inf)
    for s in stats:
        radius[s["cell"]] = s["radius"]
    placed = stored(distinct.select("vec_id", "n", "vec").mapInArrow(_placed(pivots, radius, r), _PLACED), "placed")
    chunks = {(c["cell"], c["kind"]): -(-c["count"] // block) for c in placed.groupBy("cell", "kind").count().collect()}  # at most three rows a cell
    blocks = placed.mapInArrow(_blocked(chunks, r), "cell int, left long, right long, side int, vec_id long, n long, vec array<double>")
    got = stored(blocks.groupBy("cell", "left", "right").applyInArrow(_linked(threshold, dim), "vec_id long, links long, root long"), "block-links")
    links = got.select("vec_id", "links")
    edges = got.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
    cores = [(s["cell"], s["core_id"], s["core_n"]) for s in stats if s["core_id"] is not None]
    if cores:
        known = F.broadcast(df.sparkSession.createDataFrame(cores, "cell int, core_id long, core_n long"))  # MOST_PIVOTS rows at most
        core = placed.filter(F.col("kind") == CORE).select("cell", "vec_id", "n").join(known, "cell")
        links = links.unionByName(core.select("vec_id", (F.col("core_n") - F.col("n")).alias("links")))
        edges = edges.unionByName(core.select(F.col("vec_id").alias("a"), F.col("core_id").alias("b")))
    comps = components(edges)
    summed = links.groupBy("vec_id").agg(F.sum("links").alias("links"))
    each = distinct.select("key", "vec", F.col("vec_id").alias("first"), "n").join(summed.withColumnRenamed("vec_id", "first"), "first", "left").join(comps.withColumnRenamed("id", "first"), "first", "left")
    each = each.select("key", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    each = good.select("vec_id", "key", "vec").join(each, ["key", "vec"]).select("vec_id", "n_links", "component_id")
    out = out.join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = stored(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "joined")
    drop(every, distinct, placed, got)
    return out


def report(df: DataFrame) -> DataFrame:
    return near_vectors(df)


#: DuckDB SQL for :func:`report` on vectors of one length: all pairs, and what links reach.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), n AS (
  SELECT a, count(*) AS links FROM l GROUP BY a
), c AS (
  SELECT a, min(b) AS low FROM r GROUP BY a
)
SELECT m.vec_id, coalesce(n.links, 0) AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id, m.vec_id <= coalesce(c.low, m.vec_id) AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN c ON c.a = m.vec_id
"""
