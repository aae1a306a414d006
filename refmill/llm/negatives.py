"""Hard negatives by Strassen multiplication of integer tiles and mergeable heaps.

Vectors become integers (``floor(256 * x)``) and are packed in tiles: candidates in order of label, so that a tile has
few labels, anchors dealt by a hash of their id. A task gets one tile of anchors and some tiles of candidates and
multiplies them by Strassen's recursion, odd sides padded with zeros, all sums in int64. Two rounds:

1. Rows of the anchors' own labels: each task keeps, for each anchor, a heap of the ``POSITIVES`` best; heaps merge.
2. Rows of other labels: with the positives known, each (anchor, positive) has a window of scores, from half to
   95 hundredths of the positive's; each task keeps the ``NEGATIVES`` best in every window; heaps merge again.

So each pair of an anchor and a row is multiplied in one round only; a label that holds most rows only makes more tiles.

Sums modulo 2**64 are exact if the true score fits in a long. A vector whose scaled squared norm reaches 2**62 takes no
part, so by Cauchy and Schwarz every score fits, whatever overflows within the recursion.

Edge cases: rows with a null id or label, a null vector, or a null or non-finite component take no part; zero and empty
vectors do, and components that a shorter vector lacks count as 0; of several rows with one id the least (label, then
vector) counts; ties go to smaller ids; anchors without positives, and windows without rows, have no row; a negative
positive score has an empty window; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import counted, drop, partitions, stored

POSITIVES, NEGATIVES = 5, 3
ANCHOR_EVERY, MOVED_EVERY, LABELS, SCALE = 50, 7, 10, 256
#: Rows of a tile at most, of candidates and of anchors, and values of one.
TILE, ANCHOR_TILE, TILE_VALUES = 2_048, 1_024, 1 << 20
#: Tiles of candidates that meet a tile of anchors in one task, about.
MEETING = 16
#: Sides up to which blocks are multiplied plainly.
LEAF = 16
_NONE = np.iinfo(np.int64).min
_TILE_SCHEMA = "tile long, ids array<long>, labels array<long>, width int, kind string, data binary, n_pos array<int>, pos_id array<long>, pos_score array<long>"
_ARROW = pa.schema(
    [("tile", pa.int64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("width", pa.int32()), ("kind", pa.string()), ("data", pa.binary())]
    + [("n_pos", pa.list_(pa.int32())), ("pos_id", pa.list_(pa.int64())), ("pos_score", pa.list_(pa.int64()))]
)


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b in int64 (modulo 2**64) with seven half-sized products a step."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, q = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :q], b[:j, q:], b[j:, :q], b[j:, q:]
    out = np.zeros((2 * i, 2 * q), dtype=np.int64)
    c11, c12, c21, c22 = out[:i, :q], out[:i, q:], out[i:, :q], out[i:, q:]
    for left, right, plus, minus in (
        (a11 + a22, b11 + b22, (c11, c22), ()),
        (a21 + a22, b11, (c21,), (c22,)),
        (a11, b12 - b22, (c12, c22), ()),
        (a22, b21 - b11, (c11, c21), ()),
        (a11 + a12, b22, (c12,), (c11,)),
        (a21 - a11, b11 + b12, (c22,), ()),
        (a12 - a22, b21 + b22, (c11,), ()),
    ):
        product = strassen(left, right, leaf)
        for c in plus:
            c += product
        for c in minus:
            c -= product
    return out[:m, :n]


def taking_part(df: DataFrame) -> DataFrame:
    """(vec_id, label, v): one row for each id that takes part, with its label as it counts here and integer components."""
    v = F.col("_v")
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("_v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x * SCALE) * (x * SCALE)) < 2.0**62
    df = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(finite & small)
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label")
    rows = df.select("vec_id", moved, F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.label", "row.v")


def _packed(rows: list[pa.Table], tile: int) -> pa.RecordBatch:
    """One tile of the rows, by id, in the narrowest type that holds their components."""
    t = pa.concat_tables(rows).sort_by("vec_id").combine_chunks()
    v = t["v"].combine_chunks()
    sizes = np.diff(np.asarray(v.offsets))
    flat = np.asarray(v.flatten(), dtype=np.int64)
    width = int(sizes.max(initial=0))
    full = np.zeros((len(sizes), width), dtype=np.int64)
    full[np.arange(width) < sizes[:, None]] = flat
    kind = next(k for k in ("int16", "int32", "int64") if not flat.size or (flat.min() >= np.iinfo(k).min and flat.max() <= np.iinfo(k).max))
    pos = t["positives"].combine_chunks() if "positives" in t.column_names else None
    extra = [[np.diff(np.asarray(pos.offsets)).tolist()], *([np.asarray(pos.flatten().field(f)).tolist()] for f in ("vec_id", "score"))] if pos is not None else [[[]]] * 3
    return pa.record_batch([[tile], [t["vec_id"].to_pylist()], [t["label"].to_pylist()], [width], [kind], [full.astype(kind).tobytes()], *extra], schema=_ARROW)


def _tiles(batches: Iterator[pa.RecordBatch], first: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Tiles of at most ``rows`` rows and ``TILE_VALUES`` values (one row may have more), numbered from ``first``."""
    held: list[pa.Table] = []
    n = width = 0
    for batch in batches:
        sizes = np.diff(np.asarray(batch["v"].offsets))
        begin = 0
        for i, size in enumerate(sizes.tolist()):
            wide = max(width, size)
            if n and (n == rows or (n + 1) * wide > TILE_VALUES):
                held.append(pa.Table.from_batches([batch.slice(begin, i - begin)]))
                yield _packed(held, first)
                held, first, begin, n, wide = [], first + 1, i, 0, size
            n, width = n + 1, wide
        held.append(pa.Table.from_batches([batch.slice(begin)]))
    if n:
        yield _packed(held, first)


def _candidate_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    yield from _tiles(batches, TaskContext.get().partitionId() << 32, TILE)


def _anchor_tiles(key: tuple, t: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_tiles(iter(t.combine_chunks().to_batches()), key[0].as_py(), ANCHOR_TILE), schema=_ARROW)


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.array(row["ids"], dtype=np.int64)
    return ids, np.array(row["labels"], dtype=np.int64), np.frombuffer(row["data"], dtype=row["kind"]).reshape(len(ids), row["width"])


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tiles; what lies beyond the narrower one's width meets zeros."""
    k = min(a.shape[1], c.shape[1])
    return strassen(a[:, :k].astype(np.int64), np.ascontiguousarray(c[:, :k].T, dtype=np.int64))


def merged(heap: list[np.ndarray], new: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The ``most`` best of two heaps for each key; columns: keys, then score and id."""
    cols = [np.concatenate([x, y]) for x, y in zip(heap, new, strict=True)] if heap else new
    *keys, score, ident = cols
    order = np.lexsort((ident, ~score, *keys))
    cols = [x[order] for x in cols]
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for k in cols[: len(keys)]:
        change[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(change)
    keep = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < most
    return [x[keep] for x in cols]


def _columns(names: tuple[str, ...], heap: list[np.ndarray]) -> pa.Table:
    return pa.table({n: pa.array(heap[i] if heap else [], pa.int64()) for i, n in enumerate(names)})


def _positives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    """Of one meeting: each anchor's best rows of its label."""
    heap: list[np.ndarray] = []
    for a in anchors.to_pylist():
        a_ids, a_labels, x = _matrix(a)
        for c in candidates.to_pylist():
            c_ids, c_labels, y = _matrix(c)
            for label in np.intersect1d(a_labels, c_labels):
                i, j = np.flatnonzero(a_labels == label), np.flatnonzero(c_labels == label)
                s = scores(x[i], y[j])
                s[a_ids[i][:, None] == c_ids[j]] = _NONE
                top = np.argsort(~s, axis=1, kind="stable")[:, :POSITIVES]
                best = np.take_along_axis(s, top, axis=1)
                real = best != _NONE
                heap = merged(heap, [np.broadcast_to(a_ids[i][:, None], top.shape)[real], best[real], c_ids[j][top][real]], POSITIVES)
    return _columns(("anchor_id", "score", "vec_id"), heap)


def _negatives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    """Of one meeting: the best rows in the window of each anchor and positive."""
    heap: list[np.ndarray] = []
    for a in anchors.to_pylist():
        a_ids, a_labels, x = _matrix(a)
        n_pos = np.array(a["n_pos"], dtype=np.int64)
        owner = np.repeat(np.arange(len(a_ids)), n_pos)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_pos) - n_pos, n_pos)
        pos_id, pos = np.array(a["pos_id"], dtype=np.int64), np.array(a["pos_score"], dtype=np.int64)
        low, high = pos // 2 + pos % 2, pos + -pos // 20  # 50 p <= 100 s <= 95 p, without products that overflow
        for c in candidates.to_pylist():
            c_ids, c_labels, y = _matrix(c)
            if len(set(c["labels"]) | set(a["labels"])) == 1:
                continue
            s = scores(x, y)
            s[a_labels[:, None] == c_labels] = _NONE
            order = np.argsort(~s, axis=1, kind="stable")
            s = np.take_along_axis(s, order, axis=1)
            for k in range(int(n_pos.max(initial=0))):
                these = np.flatnonzero((nth == k) & (pos >= 0))
                rows = owner[these]
                at = (s[rows] > high[these][:, None]).sum(axis=1)[:, None] + np.arange(NEGATIVES)
                inside = at < s.shape[1]
                at = np.minimum(at, s.shape[1] - 1)
                found = s[rows[:, None], at]
                inside &= (found >= low[these][:, None]) & (found != _NONE)
                spread = lambda v: np.broadcast_to(v[these][:, None], at.shape)[inside]  # noqa: B023, E731
                heap = merged(heap, [np.broadcast_to(a_ids[rows][:, None], at.shape)[inside], spread(pos_id), spread(pos), found[inside], c_ids[order[rows[:, None], at]][inside]], NEGATIVES)
    return _columns(("anchor_id", "positive_id", "positive_score", "negative_score", "negative_id"), heap)


def _ranked(df: DataFrame, keys: list[str], score: str, ident: str, most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def mine(df: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = df.sparkSession
    rows, n = counted(taking_part(df), "vectors")
    few = max(1, -(-n // (4 * TILE)))
    by_label = rows.repartitionByRange(few, "label", "vec_id").coalesce(few).sortWithinPartitions("label", "vec_id")
    candidates, n_tiles = counted(by_label.mapInArrow(_candidate_tiles, _TILE_SCHEMA), "candidate-tiles")
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    groups = max(1, -(-n // (ANCHOR_EVERY * ANCHOR_TILE)))
    parts = max(1, -(-n_tiles // MEETING), -(-partitions(spark, 2) // groups))
    of = lambda name: F.pmod(F.xxhash64(name), F.lit(groups)).alias("at")
    dealt = candidates.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.pmod(F.xxhash64("tile"), F.lit(parts)).cast("int"))

    def meet(these: DataFrame, f, schema: str) -> DataFrame:
        """Every tile of anchors with every tile of candidates, in blocks."""
        tiles = these.groupBy("at").applyInArrow(_anchor_tiles, _TILE_SCHEMA).withColumnRenamed("tile", "at").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = [F.col("at").cast("int").alias("at"), "part"]
        left, right = (x.select(*keys, *[c for c in x.columns if c not in ("at", "part", "tile")]) for x in (tiles, dealt))
        return left.groupBy("at", "part").cogroup(right.groupBy("at", "part")).applyInArrow(f, schema)

    own = meet(anchors.select("vec_id", "label", "v", of("vec_id")), _positives, "anchor_id long, score long, vec_id long")
    best = _ranked(own, ["anchor_id"], "score", "vec_id", POSITIVES)
    # at most POSITIVES entries for each anchor
    lists = stored(best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("positives")), "positives")
    known = anchors.join(lists, "vec_id").select("vec_id", "label", "v", "positives", of("vec_id"))
    other = meet(known, _negatives, "anchor_id long, positive_id long, positive_score long, negative_score long, negative_id long")
    got = _ranked(other, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
    found = stored(got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    drop(rows, candidates, lists)
    return found


ORACLE = f"""
WITH d AS (SELECT vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END::BIGINT AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND coalesce(list_sum(list_transform(embedding, lambda x: ({SCALE} * x::DOUBLE) * ({SCALE} * x::DOUBLE))), 0) < 4611686018427387904.0),
r AS (SELECT vec_id, min({{'label': label, 'v': v}}) AS row FROM d GROUP BY vec_id),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.row.label = c.row.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.row.v), len(c.row.v)) + 1), lambda i: a.row.v[i] * c.row.v[i])), 0) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score::HUGEINT <= 100 * score::HUGEINT AND 100 * score::HUGEINT <= 95 * positive_score::HUGEINT
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= {NEGATIVES}
"""
