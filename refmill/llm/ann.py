"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search.

The graph starts from cells: each vector joins the cells of its nearest pivots and takes its best neighbours
there. NN-descent then improves it round by round: links count both ways, so the ``MEET`` best of a node's list and
the nodes that have it among theirs meet at it and are compared, neighbours of neighbours; each keeps its
``NEIGHBOURS`` best, and what lists it is offered to it too. Rounds go on until few lists change. A query starts from
its own list and expands the best nodes of its pool that it hasn't expanded, along their lists and ``BACK`` links into
them, all at once in each round, until the ``POOL`` best are all expanded. All steps are Spark joins and groupings by hashed parts, so a task holds a bounded share
of nodes; the meeting at a hub is dealt out in turns, by another hash in each round, so that all members can meet.

Building and search compare the vectors themselves in double precision, so near copies are told apart however many and
close they are; vectors travel as 32-bit floats if that loses nothing, else as doubles. Vectors of different norms get one more component that brings them to the largest
norm, so that a node's nearest neighbours are those by inner product. It is kept apart: a row of large norm takes no
precision from the others, even where its square overflows (graph and search see such rows scaled down; results are
scored on the originals). Equal vectors are one node that knows as many of its smallest ids as a result can hold.

Index and searches cover every row; only pivots are a sample, bounded by ``MOST_PIVOTS``.

Edge cases: null, zero and non-finite vectors, those of another length than most, and null ids take no part, as
query or candidate; repeated rows with one vec_id are one vector; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stored
from .vectors import batches_of, common_length, matrix, usable

TOP = 20
NEIGHBOURS, MEET = 40, 20
#: Rounds at most, and the share of list entries that a round must change for another one.
ROUNDS, LEAST_CHANGE = 6, 0.01
#: Links into a node that a search may follow backwards.
BACK = 24
#: Best nodes that a search keeps expanding, and how many rounds it takes at most.
POOL, HOPS = 160, 12
#: Vectors of a starting cell, cells of a vector, and pivots at most (they go to every task).
CELL, CELLS_EACH, MOST_PIVOTS = 256, 4, 4_096
#: Nodes that every search may also start from, of the largest norms and by a hash in equal parts; how many it takes.
SEEDS, SEEDS_EACH = 1_024, 20
#: Nodes of a part; nodes of about one turn of a meeting.
PART, MEETING = 1_000, 256


def _part(column: str, parts: int):
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int").alias("part")


#: Norms beyond 2**LARGEST would overflow when squared: such vectors are halved until they are within, for the graph only.
LARGEST = 500


def within_range(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a matrix, brought within 2**LARGEST by powers of two, and the norms as they were."""
    top = np.abs(x).max(axis=1, initial=0.0)
    unit = np.sqrt(((x / np.where(top > 0, top, 1.0)[:, None]) ** 2).sum(axis=1))
    size = np.log2(np.maximum(top, np.finfo(float).tiny)) + np.log2(np.maximum(unit, 1.0))
    with np.errstate(over="ignore"):
        return np.ldexp(x, np.minimum(0, np.floor(LARGEST - size)).astype(int)[:, None]), top * unit


def _coded(dim: int, most: float, kind: type):
    """vec -> its bytes, the component that fills its norm up to ``most``, and its norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, norm = within_range(matrix(b["vec"], dim))
            fill = np.sqrt(np.maximum(0.0, most * most - (x * x).sum(axis=1)))
            yield pa.record_batch([b["node"], pa.array([c.tobytes() for c in x.astype(kind)], pa.binary()), pa.array(fill), pa.array(norm)], names=["node", "code", "fill", "norm"])

    return run


def _floats(code: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    data = b"".join(code.to_pylist())
    return np.frombuffer(data, dtype=np.float64 if len(data) == len(code) * dim * 8 else np.float32).reshape(-1, dim).astype(np.float64)


def _nearness(x: np.ndarray, fx: np.ndarray, y: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """Minus half the squared distances of filled vectors, which orders them as their inner products do.

    Its error depends on the two norms only, that of inner products of filled vectors on the table's largest norm.
    """
    return x @ y.T - ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)) / 2 - (fx[:, None] - fy) ** 2 / 2


def _celled(pivots: np.ndarray, fills: np.ndarray, each: int, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 4_000):
            if b.num_rows:
                near = -_nearness(_floats(b["code"], dim), b["fill"].to_numpy(), pivots, fills)
                k = min(each, len(pivots))
                cells = np.argpartition(near, k - 1, axis=1)[:, :k]
                take = b.take(pa.array(np.repeat(np.arange(b.num_rows), k)))
                yield pa.record_batch([pa.array(cells.ravel().astype(np.int32)), *(take[c] for c in ("node", "code", "fill"))], names=["cell", "node", "code", "fill"])

    return run


def _edges(v: np.ndarray, w: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"v": pa.array(v, pa.int64()), "w": pa.array(w, pa.int64()), "s": pa.array(s, pa.float64())})


_EDGES = "v long, w long, s double"


def _within_cell(keep: int, dim: int):
    def run(t: pa.Table) -> pa.Table:
        ids, x, fill = t["node"].to_numpy(), _floats(t["code"], dim), t["fill"].to_numpy()
        out = [(ids[:0], ids[:0], np.zeros(0))]
        k = min(keep, len(ids) - 1)
        for a in range(0, len(ids) if k else 0, 512):
            s = _nearness(x[a : a + 512], fill[a : a + 512], x, fill)
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out.append((np.repeat(ids[a : a + 512], k), ids[best].ravel(), np.take_along_axis(s, best, axis=1).ravel()))
        return _edges(*(np.concatenate(c) for c in zip(*out, strict=True)))

    return run


def best_of(v: np.ndarray, w: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best different w of each v, best first; equal scores go by w."""
    order = np.lexsort((-s, w, v))
    v, w, s = v[order], w[order], s[order]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.zeros(0, dtype=bool)
    v, w, s = v[new], w[new], s[new]
    order = np.lexsort((w, -s, v))
    v, w, s = v[order], w[order], s[order]
    first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=bool)
    rank = np.arange(len(v)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return v[rank < keep], w[rank < keep], s[rank < keep]


def _lists(keep: int):
    """Of a part's edges: each node's list, best first, with its last score if the list is full and its new entries."""

    def run(t: pa.Table) -> pa.Table:
        v, w, s, known = (t[c].to_numpy() for c in ("v", "w", "s", "known"))
        # Known entries come first among equal ones, whatever the last bits of their scores.
        order = np.lexsort((~known, w, v))
        v, w, s, known = v[order], w[order], s[order], known[order]
        one = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.zeros(0, dtype=bool)
        v, w, s, known = v[one], w[one], s[one], known[one]
        order = np.lexsort((w, -s, v))
        v, w, s, known = v[order], w[order], s[order], known[order]
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(v)) - np.repeat(head, np.diff(np.append(head, len(v))))
        k = rank < keep
        v, w, s, known = v[k], w[k], s[k], known[k]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.append(first, len(v)).astype(np.int32))
        size = np.diff(np.append(first, len(v)))
        last = np.where(size == keep, s[first + size - 1] if len(v) else s[:0], -np.inf)
        new = np.add.reduceat((~known).astype(np.int64), first) if len(v) else first
        return pa.table({"node": pa.array(v[first], pa.int64()), "near": pa.ListArray.from_arrays(offsets, pa.array(w, pa.int64())), "scores": pa.ListArray.from_arrays(offsets, pa.array(s, pa.float64())), "last": pa.array(last), "new": pa.array(new, pa.int64())})

    return run


_LISTS = "node long, near array<long>, scores array<double>, last double, new long"


def _meeting(dim: int):
    """Of a part: nodes that meet in a turn are compared; what betters a node's list is returned."""

    def run(t: pa.Table) -> pa.Table:
        at, turn, who, last, fill = (t[c].to_numpy() for c in ("at", "turn", "node", "last", "fill"))
        x = _floats(t["code"], dim)
        order = np.lexsort((who, turn, at))
        at, turn, who, last, fill, x = at[order], turn[order], who[order], last[order], fill[order], x[order]
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (turn[1:] != turn[:-1])])) if len(at) else []
        out = [(who[:0], who[:0], np.zeros(0))]
        for a, b in zip(starts, [*starts[1:], len(at)], strict=False):
            if b - a < 2:
                continue
            s = _nearness(x[a:b], fill[a:b], x[a:b], fill[a:b])
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero(s > last[a:b, None])
            out.append((who[a + i], who[a + j], s[i, j]))
        v, w, s = (np.concatenate(c) for c in zip(*out, strict=True))
        return _edges(*best_of(v, w, s, NEIGHBOURS))

    return run


def _scored(dim: int):
    """Proposed nodes with their vectors and the queries': inner products that could enter a pool."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 10_000):
            if b.num_rows:
                s = (_floats(b["code"], dim) * _floats(b["code_w"], dim)).sum(axis=1)
                keep = pa.array(s > b["last"].to_numpy())
                yield pa.record_batch([c.filter(keep) for c in (b["query"], b["w"], pa.array(s))], names=["v", "w", "s"])

    return run


def _seeded(ids: np.ndarray, seeds: np.ndarray, dim: int):
    """Each query's best seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 2_000):
            if not b.num_rows:
                continue
            s = _floats(b["code"], dim) @ seeds.T
            k = min(SEEDS_EACH, len(ids))
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            v, w = np.repeat(b["query"].to_numpy(), k), ids[best].ravel()
            other = v != w
            yield pa.record_batch([pa.array(v[other]), pa.array(w[other]), pa.array(np.take_along_axis(s, best, axis=1).ravel()[other])], names=["v", "w", "s"])

    return run


def _pools(keep: int):
    """Of a part's queries: the best nodes of old pools and new finds, and whether they were expanded."""

    def run(t: pa.Table) -> pa.Table:
        v, w, s, done = (t[c].to_numpy() for c in ("v", "w", "s", "done"))
        order = np.lexsort((~done, w, v))  # what was expanded comes first
        v, w, s, done = v[order], w[order], s[order], done[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.zeros(0, dtype=bool)
        v, w, s, done = v[new], w[new], s[new], done[new]
        order = np.lexsort((w, -s, v))
        v, w, s, done = v[order], w[order], s[order], done[order]
        first = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=bool)
        head = np.flatnonzero(first)
        rank = np.arange(len(v)) - head[np.cumsum(first) - 1]
        k = rank < keep
        size = np.diff(np.append(head, len(v)))
        last = np.where(size >= keep, s[np.minimum(head + keep - 1, len(v) - 1)] if len(v) else s[:0], -np.inf)
        return pa.table({"v": pa.array(v[k], pa.int64()), "w": pa.array(w[k], pa.int64()), "s": pa.array(s[k], pa.float64()), "done": pa.array(done[k]), "last": pa.array(last[np.cumsum(first) - 1][k])})

    return run


def _exact(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = (matrix(b["x"], dim) * matrix(b["y"], dim)).sum(axis=1) if b.num_rows else np.zeros(0)
            yield pa.record_batch([b["v"], b["w"], pa.array(score, pa.float64())], names=["v", "w", "score"])

    return run


def build(nodes: DataFrame, total: int, dim: int) -> DataFrame:
    """The graph of (node, code, fill): lists of each node's neighbours, best first."""
    parts = max(1, -(-total // PART))
    n_pivots = min(MOST_PIVOTS, max(1, total // CELL))
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(n_pivots).toPandas()  # bounded by MOST_PIVOTS
    pivots = _floats(pa.array(sample["code"], pa.binary()), dim)
    celled = nodes.mapInArrow(_celled(pivots, sample["fill"].to_numpy(), CELLS_EACH, dim), "cell int, node long, code binary, fill double")
    # A cell may be hot: it is dealt out in turns of about CELL * CELLS_EACH, each node by a hash of its id.
    sizes = F.broadcast(celled.groupBy("cell").count())  # at most MOST_PIVOTS rows
    turns = celled.join(sizes, "cell").withColumn("turn", F.pmod(F.xxhash64("node", "cell"), F.ceil(F.col("count") / (CELL * CELLS_EACH))))
    edges = turns.groupBy("cell", "turn").applyInArrow(_within_cell(NEIGHBOURS // 2, dim), _EDGES)
    listed = lambda e: e.groupBy(_part("v", parts)).applyInArrow(_lists(NEIGHBOURS), _LISTS)
    lists = stored(listed(edges.withColumn("known", F.lit(False))), "lists")
    for k in range(ROUNDS):
        best = lists.select("node", F.explode(F.slice("near", 1, MEET)).alias("at"))
        links = best.unionByName(best.select(F.col("at").alias("node"), F.col("node").alias("at"))).distinct()
        links = stored(links, "links")
        hubs = links.groupBy("at").count().filter(F.col("count") > MEETING)
        turn = F.coalesce(F.pmod(F.xxhash64("node", F.lit(k)), F.ceil(F.col("count") / MEETING)).cast("int"), F.lit(0))
        sent = links.join(hubs, "at", "left").select("at", turn.alias("turn"), "node")
        sent = sent.join(lists.select("node", "last").join(nodes, "node"), "node").select("at", "turn", "node", "last", "code", "fill")
        part = F.pmod(F.xxhash64("at", "turn"), F.lit(parts)).cast("int").alias("part")
        found = sent.groupBy(part).applyInArrow(_meeting(dim), _EDGES).withColumn("known", F.lit(False))
        own = lists.select(F.col("node").alias("v"), F.explode(F.arrays_zip("near", "scores")).alias("e")).select("v", F.col("e.near").alias("w"), F.col("e.scores").alias("s"), F.lit(True).alias("known"))
        offered = own.select(F.col("w").alias("v"), F.col("v").alias("w"), "s", F.lit(False).alias("known"))
        before, lists = lists, stored(listed(found.unionByName(own).unionByName(offered)), "lists")
        drop(before, links)
        new, n = lists.agg(F.sum("new"), F.sum(F.size("near"))).first()
        if (new or 0) < LEAST_CHANGE * (n or 0):
            break
    return lists


def both_ways(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, near): each node's list, and ``BACK`` nodes that list it, those of large norm first.

    In a dense group lists name the group alone; what lies around it is found by the links that lead into it.
    """
    own = lists.select("node", F.explode("near").alias("w"))
    back = lists.join(nodes.select("node", "norm"), "node").select(F.explode("near").alias("at"), "node", "norm")
    nth = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("norm"), F.xxhash64("node"), "node"))
    back = back.withColumn("nth", nth).filter(F.col("nth") <= BACK).select(F.col("at").alias("node"), F.col("node").alias("w"))
    return stored(own.unionByName(back).groupBy("node").agg(F.collect_set("w").alias("near")), "links-both-ways")


def search(nodes: DataFrame, lists: DataFrame, queries: DataFrame, total: int, dim: int) -> DataFrame:
    """(v, w): for each node of ``queries`` the best nodes that greedy search finds, itself left out."""
    parts = max(1, -(-total // PART))
    near = both_ways(lists, nodes)
    asking = stored(queries.join(nodes, "node").select(F.col("node").alias("query"), "code"), "asking")

    def expanded(ask: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """v, w, s, done: the neighbours of (query, node, last) that could enter a pool and aren't ``known``."""
        pairs = ask.join(near, "node").select("query", F.explode("near").alias("w"), "last", F.lit(False).alias("old"))
        if known is not None:
            pairs = pairs.unionByName(known.select(F.col("v").alias("query"), "w", F.lit(float("-inf")).alias("last"), F.lit(True).alias("old")))
        # One shuffle by query, whose pairs its pool bounds, serves to drop what is known and to fetch its vector.
        pairs = pairs.repartition("query").groupBy("query", "w").agg(F.max("last").alias("last"), F.max("old").alias("old")).filter("not old and w <> query").drop("old")
        theirs = nodes.select(F.col("node").alias("w"), F.col("code").alias("code_w"))
        found = pairs.join(asking, "query").join(theirs, "w").select("query", "w", "last", "code", "code_w").mapInArrow(_scored(dim), _EDGES)
        return found.withColumn("done", F.lit(False))

    fresh = expanded(asking.select("query", F.col("query").alias("node"), F.lit(float("-inf")).alias("last")))
    # Bounded by SEEDS. They reach what a query's own surroundings don't: other clusters, and vectors of large norm.
    some = nodes.orderBy(F.desc("norm"), "node").limit(SEEDS // 2).unionByName(nodes.orderBy(F.xxhash64("node"), "node").limit(SEEDS // 2)).toPandas().drop_duplicates("node")
    seeds = _floats(pa.array(some["code"], pa.binary()), dim)
    from_seeds = asking.mapInArrow(_seeded(some["node"].to_numpy(), seeds, dim), _EDGES).withColumn("done", F.lit(False))
    pool_type = "v long, w long, s double, done boolean, last double"
    pool = stored(fresh.unionByName(from_seeds).groupBy(_part("v", parts)).applyInArrow(_pools(POOL), pool_type), "pool")
    for _ in range(HOPS):
        ask = pool.filter("not done").select(F.col("v").alias("query"), F.col("w").alias("node"), "last")
        if not pool.filter("not done").limit(1).count():
            break
        both = pool.select("v", "w", "s", F.lit(True).alias("done")).unionByName(expanded(ask, pool))
        before, pool = pool, stored(both.groupBy(_part("v", parts)).applyInArrow(_pools(POOL), pool_type), "pool")
        drop(before)
    return pool.select("v", "w")


def nearest(df: DataFrame, every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id ``every`` divides."""
    spark = df.sparkSession
    every_row = stored(usable(df).withColumn("key", F.xxhash64("vec")), "vectors")
    dim = common_length(every_row)
    good = every_row.filter(F.size("vec") == dim)
    # The smallest ids of a node suffice: row_number's limit is applied before rows are shuffled.
    nth = F.row_number().over(Window.partitionBy("key", "vec").orderBy("vec_id"))
    some = good.withColumn("nth", nth).filter(F.col("nth") <= top + 1)
    grouped = stored(some.groupBy("key", "vec").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    wide = F.exists("vec", lambda x: x.cast("float").cast("double") != x)
    top_of = F.array_max(F.transform("vec", F.abs))
    norm = top_of * F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + (x / top_of) * (x / top_of)))
    total, most, wide = grouped.agg(F.count("*"), F.max(F.least(norm, F.lit(2.0**LARGEST))), F.max(wide)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    nodes = stored(grouped.select("node", "vec").mapInArrow(_coded(dim, most, np.float64 if wide else np.float32), "node long, code binary, fill double, norm double"), "codes")
    asked = good.filter(F.col("vec_id") % every == 0).join(grouped.select("key", "vec", "node"), ["key", "vec"]).select(F.col("vec_id").alias("query_id"), "node")
    asked = stored(asked, "queries")
    queries = asked.select("node").distinct()
    lists = build(nodes, total, dim)
    found = search(nodes, lists, queries, total, dim).unionByName(queries.select(F.col("node").alias("v"), F.col("node").alias("w")))
    x = grouped.select(F.col("node").alias("v"), F.col("vec").alias("x"))
    y = grouped.select(F.col("node").alias("w"), F.col("vec").alias("y"))
    scored = found.join(y, "w").join(x, "v").select("v", "w", "x", "y").mapInArrow(_exact(dim), "v long, w long, score double")
    best = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("score"), "w"))
    scored = scored.withColumn("nth", best).filter(F.col("nth") <= top + 1)  # each node brings a candidate at least
    each = scored.join(grouped.select(F.col("node").alias("w"), "ids"), "w").join(asked.withColumnRenamed("node", "v"), "v")
    each = each.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    result = stored(each.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "nearest")
    drop(every_row, grouped, nodes, asked, lists)
    return result


def report(df: DataFrame) -> DataFrame:
    return nearest(df)
