"""Near-duplicate documents by MinHash, with sequential Bayesian verification.

One pass over the texts gives each a digest of its shingle set, a signature and its bands; equal sets meet by the
digest, aggregated before they are shuffled, and each set goes on as one node. Bands propose candidates. A candidate
pair's signatures are compared batch by batch, and the pair is dropped as soon as the posterior probability of its
similarity reaching the threshold is under ``MISS``; survivors are verified on their whole shingle sets. Signatures
keep eight bits of each minimum: unequal minima then agree once in 256 times, which can only spare a pair. Whole sets are sent
once a part, in which up to ``HUB_PAIRS`` pairs of a node meet.

In a band's bucket every member is first compared with two others, its hubs. Only members of buckets that hold several
components after that are compared with all others, in blocks of ``BLOCK`` by ``BLOCK`` and only across components, and
not within a bucket's largest one; a block returns the links that join components, never its pairs. So a group of
thousands of copies costs its size, and all links that could join components are looked at.

Edge cases: a null, empty or blank text has no shingle and links with nothing; a text of fewer words than a shingle
is one shingle; a null doc_id links with nothing; empty tables give empty results; other columns are not read.
Rows are documents of their own, also where they repeat a doc_id: with another text such a row has its own links, and
with the same text it shares its twin's component and ``kept``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import counted, drop, stored
from .graph import components
from .shingles import mixed, shingle_sets, slices

WIDTH = 5
THRESHOLD = (80, 100)
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
#: Posterior probability of reaching the threshold under which a pair is dropped.
MISS = 1e-6
#: Members of a bucket in one block; sets that are compared at once with another; signatures compared at once.
BLOCK, TOGETHER, AT_ONCE = 512, 64, 1 << 14
#: Members of blocks in one part, with signatures and with sets: a task takes a part at a time.
PART_ROWS, PART_SETS = 20_000, 2_000
#: Pairs of one node that meet its set in one part, and bytes of the sets in a part (about: hubs' chunks are not cut).
HUB_PAIRS, PART_BYTES = 512, 32 << 20
#: Ids that may be broadcast: 8 bytes each, 16 MB at most. Beyond, the texts are shuffled to the ids.
BROADCAST_IDS = 2_000_000

_RNG = np.random.default_rng(1)
_A = _RNG.integers(1, 1 << 63, size=HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(1, 1 << 63, size=HASHES, dtype=np.uint64)


def least_matches(threshold: float, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> np.ndarray:
    """Matches among the first n hashes below which a pair is dropped, for n = batch, 2 * batch, ...

    With a uniform prior, the posterior of the similarity after m matches in n is Beta(m + 1, n - m + 1), and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def plausible(left: np.ndarray, right: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows outlive every batch."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for k, m in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    out = np.zeros(len(left), dtype=bool)
    out[alive] = True
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """uint32[sets, HASHES] of non-empty sets: the upper half of each minimum."""
    flat = np.concatenate(sets)
    start = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(flat * _A[k] + _B[k], start) >> np.uint64(32)
    return out


def common(a: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """How many members of ``a`` each of ``many`` holds; all are sorted and distinct and none is empty."""
    flat = np.concatenate(many)
    hit = a[np.minimum(a.searchsorted(flat), len(a) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0] + [len(x) for x in many[:-1]]), dtype=np.int64)


def similar(a: np.ndarray, many: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Exactly, which of ``many`` reach the threshold with ``a``; those whose size rules it out are not compared."""
    num, den = threshold
    size = np.array([len(x) for x in many])
    able = num * np.maximum(size, len(a)) <= den * np.minimum(size, len(a))
    out = np.zeros(len(many), dtype=bool)
    at = np.flatnonzero(able)
    if len(at):
        both = common(a, [many[i] for i in at])
        out[at] = den * both >= num * (len(a) + size[at] - both)
    return out


_SIGNED = "doc_id long, text_hash long, n_shingles long, d0 long, d1 long, sig binary, bands array<long>"


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            for s in slices(texts):
                sets = shingle_sets(texts[s], width)
                size = np.array([len(x) for x in sets], dtype=np.int64)
                some = np.flatnonzero(size)
                digest = np.zeros((len(sets), 2), dtype=np.uint64)
                sig: list[bytes | None] = [None] * len(sets)
                bands = np.zeros((0, BANDS), dtype=np.int64)
                if len(some):
                    full = [sets[i] for i in some]
                    with np.errstate(over="ignore"):
                        flat = np.concatenate(full)
                        start = np.cumsum([0] + [len(x) for x in full[:-1]])
                        digest[some, 0] = np.add.reduceat(mixed(flat + np.uint64(1)), start)
                        digest[some, 1] = np.add.reduceat(mixed(flat * _A[0]), start)
                    wide = signature(full)
                    bands = banded(wide)
                    for i, row in zip(some, wide.astype(np.uint8), strict=True):
                        sig[i] = row.tobytes()
                each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)), pa.array(bands.ravel()))
                ids = [batch[c].slice(s.start, s.stop - s.start) for c in ("doc_id", "text_hash")]
                yield pa.record_batch([*ids, pa.array(size), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), pa.array(sig, pa.binary()), each], names=["doc_id", "text_hash", "n_shingles", "d0", "d1", "sig", "bands"])

    return run


def banded(sig: np.ndarray) -> np.ndarray:
    """int64[sets, BANDS]: the bucket of each band of uint32 signatures."""
    rows = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for k in range(ROWS):
            h = mixed(h * _A[1] + rows[:, :, k])
    return h.view(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].cast(pa.binary()).to_pylist()
            for s in slices(texts):
                yield pa.record_batch([batch["node"].slice(s.start, s.stop - s.start), pa.array([x.tobytes() for x in shingle_sets(texts[s], width)], pa.binary())], names=["node", "shingles"])

    return run


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint64)


_PAIR = ["a", "b", "doc_a", "hash_a", "doc_b", "hash_b"]


def _pruned(least: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = plausible(_matrix(batch["sig_a"]), _matrix(batch["sig_b"]), least)
                yield batch.select(_PAIR).filter(pa.array(keep))

    return run


def _verified(threshold: tuple[int, int]):
    """Of a part's rows, sets (node, shingles) and pairs (node, other): the pairs that are similar."""

    def run(part: pa.Table) -> pa.Table:
        full = part.filter(pc.is_null(part["other"]))
        at = {node: i for i, node in enumerate(full["node"].to_pylist())}
        of = lambda node: _set(full["shingles"][at[node]].as_py())
        pairs = part.select(["node", "other"]).filter(pc.is_valid(part["other"])).sort_by("node")
        hub, other = (pairs[c].to_pylist() for c in ("node", "other"))
        keep = np.zeros(len(hub), dtype=bool)
        for node, same in itertools.groupby(range(len(hub)), key=hub.__getitem__):
            same = list(same)
            for i in range(0, len(same), TOGETHER):
                some = same[i : i + TOGETHER]
                keep[some] = similar(of(node), [of(other[k]) for k in some], threshold)
        return pairs.filter(pa.array(keep)).rename_columns(["a", "b"])

    return run


_MEMBER = ["bucket", "i", "j", "side", "node", "component"]
_MEMBERS = "bucket long, i int, j int, side int, node long, component long"


def _parted(t: pa.Table) -> Iterator[pa.Table]:
    """The blocks of a part."""
    bucket, i, j = (t[c].to_numpy() for c in ("bucket", "i", "j"))
    order = np.lexsort((j, i, bucket))
    bucket, i, j = bucket[order], i[order], j[order]
    new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(order) else []
    for a, b in zip(new, [*new[1:], len(order)], strict=False):
        yield t.take(pa.array(order[a:b]))


def _plausible_pairs(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, ids: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one block: pairs of different components, one of either side, that outlive every batch."""
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    out = [(left[:0], left[:0])]
    step = max(1, AT_ONCE // max(1, len(right)))
    for k in range(0, len(left), step):
        i, j = (x.ravel() for x in np.broadcast_arrays(left[k : k + step, None], right[None, :]))
        new = (comp[i] != comp[j]) & ((ids[i] < ids[j]) | (side[j] == 1))
        i, j = i[new], j[new]
        keep = plausible(sig[i], sig[j], least)
        out.append((i[keep], j[keep]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _doubtful(least: np.ndarray):
    """Of a part's blocks: the members with a plausible partner of another component."""

    def run(part: pa.Table) -> pa.Table:
        out = [part.select(_MEMBER).slice(0, 0)]
        for t in _parted(part):
            comp, side, ids = (t[c].to_numpy() for c in ("component", "side", "node"))
            found = np.zeros(len(comp), dtype=bool)
            for x in _plausible_pairs(_matrix(t["sig"]), comp, side, ids, least):
                found[x] = True
            out.append(t.select(_MEMBER).filter(pa.array(found)))
        return pa.concat_tables(out)

    return run


def _joining(threshold: tuple[int, int], least: np.ndarray):
    """Of a part's blocks: pairs of components that links join, each of which joins two that weren't in its block."""

    def run(part: pa.Table) -> pa.Table:
        links = []
        for t in _parted(part):
            ids, comp, side = (t[c].to_numpy() for c in ("node", "component", "side"))
            sig = _matrix(t["sig"])
            names, comp = np.unique(comp, return_inverse=True)
            root = list(range(len(names)))

            def find(c: int, root: list[int] = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            left, right = _plausible_pairs(sig, comp, side, ids, least)
            order = np.lexsort((right, -(sig[left] == sig[right]).sum(axis=1), left))
            left, right = left[order], right[order]
            sets = {i: _set(t["shingles"][int(i)].as_py()) for i in np.union1d(left, right)}
            for i, same in itertools.groupby(range(len(left)), key=left.__getitem__):
                others = right[list(same)]
                for k in range(0, len(others), TOGETHER):
                    some = [j for j in others[k : k + TOGETHER] if find(comp[j]) != find(comp[i])]
                    for j in np.array(some)[similar(sets[i], [sets[j] for j in some], threshold)] if some else ():
                        a, b = find(comp[i]), find(comp[j])
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            links.append((int(names[a]), int(names[b])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def few(df: DataFrame, rows: int) -> DataFrame:
    """To be broadcast if its checked number of rows allows it; else it is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_IDS else df


def _shingled(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of ``ids`` (node, doc_id, text_hash), each from one of its equal rows in ``docs``."""
    ids, n = counted(ids, "candidates")
    texts = docs.join(few(ids, n), ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(_sets(width), "node long, shingles binary")


def _dealt(pairs: DataFrame, n: int, parts: int) -> DataFrame:
    """(part, node, other) of ``n`` pairs: those of one node in one part, so its set is sent once; a hub's in several.

    A node of more than ``HUB_PAIRS`` pairs is a hub, of which there are 2 * n / ``HUB_PAIRS`` at most.
    """
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count().filter(F.col("count") > HUB_PAIRS)
    hubs = few(degrees.select("node", F.ceil(F.col("count") / HUB_PAIRS).alias("chunks")), 2 * n // HUB_PAIRS)
    for x in "ab":
        pairs = pairs.join(hubs.select(F.col("node").alias(x), F.col("chunks").alias(f"chunks_{x}")), x, "left")
    turned = F.col("chunks_a").isNull() & F.col("chunks_b").isNotNull()
    pairs = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("other"), F.coalesce("chunks_a", "chunks_b", F.lit(1)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("other"), "chunks")
    return pairs.select(F.pmod(F.xxhash64("node", chunk), F.lit(parts)).alias("part"), "node", "other")


def _links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, width: int, threshold: tuple[int, int]) -> tuple[DataFrame, int]:
    """Those of ``pairs`` (a, b) that are similar, and their number: pruned on signatures, then verified on whole sets."""
    least = least_matches(threshold[0] / threshold[1])
    a = reps.select(F.col("node").alias("a"), F.col("doc_id").alias("doc_a"), F.col("text_hash").alias("hash_a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("node").alias("b"), F.col("doc_id").alias("doc_b"), F.col("text_hash").alias("hash_b"), F.col("sig").alias("sig_b"))
    pruned = pairs.join(b, "b").join(a, "a").select(*_PAIR, "sig_a", "sig_b").mapInArrow(_pruned(least), ", ".join(f"{c} long" for c in _PAIR))
    pruned, n = counted(pruned, "survivors")
    ends = [pruned.select(F.col(x).alias("node"), F.col(f"doc_{x}").alias("doc_id"), F.col(f"hash_{x}").alias("text_hash")) for x in "ab"]
    seen = Observation()
    size = (F.sum(F.length("shingles")).alias("bytes"), F.count("*").alias("n"))
    sets = stored(_shingled(docs, ends[0].unionByName(ends[1]).distinct(), width).observe(seen, *size), "sets", 2 * n)
    each = (seen.get.get("bytes") or 0) / max(1, seen.get.get("n") or 0)
    dealt = _dealt(pruned.select("a", "b"), n, max(1, -(-int(each * 2 * n) // PART_BYTES)))
    needed = dealt.select("part", F.explode(F.array("node", "other")).alias("node")).distinct()
    rows = needed.join(sets, "node").withColumn("other", F.lit(None).cast("long")).unionByName(dealt.withColumn("shingles", F.lit(None).cast("binary")))
    links = rows.groupBy("part").applyInArrow(_verified(threshold), "a long, b long")
    out = counted(links, "links")
    drop(pruned, sets)
    return out


def _open_buckets(members: DataFrame) -> DataFrame:
    """bucket, main (its largest component), of_main and of_rest (chunks in it and outside), rows (when dealt out)."""
    counts = members.groupBy("bucket", "component").count()
    per = counts.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("top"), F.sum("count").alias("n")).filter("top.count < n")
    main, rest = F.col("top.count"), F.col("n") - F.col("top.count")
    of_main, of_rest = (F.ceil(x / BLOCK).cast("int") for x in (main, rest))
    return per.select("bucket", F.col("top.component").alias("main"), of_main.alias("of_main"), of_rest.alias("of_rest"), (main * of_rest + rest * (of_rest + of_main)).alias("rows"))


def _blocks(members: DataFrame, per: DataFrame) -> DataFrame:
    """(bucket, i, j, side, node, component): members outside a bucket's largest component meet all its members."""
    cut = members.join(per, "bucket").withColumn("is_main", F.col("component") == F.col("main"))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("of_main")).otherwise(F.col("of_rest"))).cast("int"))
    # A chunk of the rest meets those of the main component, numbered from -1 down, itself and each other one of the rest.
    mains = F.transform(F.sequence(F.lit(1), F.col("of_main")), lambda x: -x)
    rests = F.sequence(F.lit(0), F.col("of_rest") - 1)
    cut = cut.withColumn("own", F.when(F.col("is_main"), -1 - F.col("chunk")).otherwise(F.col("chunk")))
    cut = cut.withColumn("with", F.explode(F.when(F.col("is_main"), rests).otherwise(F.concat(rests, mains))))
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") > F.col("with"), 0).otherwise(1)
    return cut.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"), "node", "component")


def _part(rows: int, size: int) -> Column:
    return F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(max(1, -(-rows // size))))


def _joined_up(docs: DataFrame, reps: DataFrame, held: DataFrame, comps: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """Components once the members of buckets that hold several of them are compared across components."""
    least = least_matches(threshold[0] / threshold[1])
    members = held.join(comps.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    members, n = counted(members, "bucket-components")
    per, n = counted(_open_buckets(members), "open-buckets", n)
    if not n:
        return comps
    rows = per.agg(F.sum("rows")).first()[0]
    block = _blocks(members, per).join(reps.select("node", "sig"), "node").groupBy(_part(rows, PART_ROWS))
    doubtful, n = counted(block.applyInArrow(_doubtful(least), _MEMBERS), "doubtful")
    drop(members, per)
    if not n:
        return comps
    some = doubtful.select("node").distinct()
    some = stored(reps.select("node", "doc_id", "text_hash", "sig").join(some, "node"), "doubtful-nodes", n)
    sets = _shingled(docs, some.select("node", "doc_id", "text_hash"), width)
    full = stored(sets.join(some.select("node", "sig"), "node"), "doubtful-sets", n)
    more, n = counted(doubtful.join(full, "node").groupBy(_part(n, PART_SETS)).applyInArrow(_joining(threshold, least), "a long, b long"), "more-links")
    drop(doubtful, some, full)
    if not n:
        return comps
    higher = components(more, n).select(F.col("id").alias("component"), F.col("component").alias("higher"))
    alone = higher.join(comps.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("higher").alias("component"))
    return comps.join(higher, "component", "left").select("id", F.coalesce("higher", "component").alias("component")).unionByName(alone)


def grouped(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, n_shingles and least for every row of ``docs`` (doc_id, text).

    ``least`` is the (doc_id, text_hash) that comes first among the row's near-duplicates, itself included; null for
    a row that links with nothing because it has no shingle or no id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    signed, total = counted(docs.mapInArrow(_signed(width), _SIGNED), "signatures")
    able = signed.filter("n_shingles > 0 and doc_id is not null")
    # Rows of one digest hold one set; they are aggregated before they are shuffled. Nodes are numbered once, as the table is written.
    reps = able.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    reps, total = counted(reps.select(F.monotonically_increasing_id().alias("node"), "d0", "d1", "least.doc_id", "least.text_hash", "sig", "bands"), "representatives", 4 * total)
    bands = reps.select("node", F.explode("bands").alias("bucket"))
    # The smallest and the largest node of a bucket are its hubs.
    per = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("other"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("n > 1")
    per, n = counted(per, "buckets", total * BANDS)
    # Buckets of the same members, often one for each band, count once.
    large = per.filter("n > 2").groupBy("hub", "other", "n", "members").agg(F.min("bucket").alias("bucket"))
    held = stored(bands.join(large.select("bucket", "hub", "other", "n"), "bucket").select("bucket", "hub", "other", "n", "node"), "members", total * BANDS)
    hubs = held.select("node", F.explode(F.array("hub", "other")).alias("hub")).filter("node <> hub")
    pairs = per.filter("n = 2").select(F.col("hub").alias("a"), F.col("other").alias("b")).unionByName(hubs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))).distinct()
    links, n = _links(docs, reps, pairs, width, threshold)
    comps = stored(components(links, n), "components", 2 * n)
    drop(links)
    # In a bucket of three each member has met both others; larger ones that still hold several components go in blocks.
    comps = _joined_up(docs, reps, held.filter("n > 3").select("bucket", "node"), comps, width, threshold)
    named = reps.select("node", "d0", "d1", F.struct("doc_id", "text_hash").alias("own")).join(comps.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("d0", "d1", "own", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("own").alias("least"))
    named = stored(named.join(least, "component").select("d0", "d1", "least"), "named", total)
    drop(per, held)
    some = F.col("n_shingles") > 0
    out = signed.select("doc_id", "text_hash", "n_shingles", F.when(some & F.col("doc_id").isNotNull(), F.col("d0")).alias("d0"), "d1")
    return out.join(named, ["d0", "d1"], "left").select("doc_id", "text_hash", "n_shingles", "least")


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    component = F.coalesce("least.doc_id", "doc_id")
    return grouped(docs, width, threshold).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """With the contract's shingles of four words."""
    return near_duplicates(docs, width=4)


#: DuckDB SQL for :func:`report`: all pairs that share a shingle, and what they reach.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), u AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id, s.doc_id <= coalesce(c.low, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) c ON c.a = s.doc_id
"""
