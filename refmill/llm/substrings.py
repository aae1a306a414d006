"""Repeated passages, as a suffix array would find them, by bucket-pointer refinement.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier (smaller doc_id, or earlier in the same
document). Sorting every suffix would move many times the text, so only some suffixes are sorted:

1. Initial buckets. Each window of ``LENGTH`` bytes is stood for by the smallest of its q-grams' hashes, so equal
   windows have equal representatives at equal offsets; about one position in forty is one. Those positions are
   put in buckets by their q-gram. A bucket of one is sorted: its windows are unique.
2. First refinement, in the same shuffle. A bucket is refined by the identifier of the whole stretch that its
   windows cover. All but the first of equal stretches go as a whole.
3. Where different stretches share a q-gram, their windows are refined to the end: sorted by the bucket of their
   first q-gram, then by buckets of q-grams at later offsets, the refined buckets of 2q bytes serving both halves
   of the window. Windows that end in one bucket are equal, and all but the first go.

A q-gram that is frequent within one batch of rows is known to be no bucket of one: its stretches skip step 2, save
for a few witnesses, so no task gathers a common line of all documents. In step 3 the windows of a q-gram with
more than ``HOT`` stretches are aggregated by their own identifiers instead of meeting in one task.

Stretches are equal if two 64-bit hashes agree, windows if their bytes do (two hashes for those of a frequent q-gram);
matches never cross documents. Records go to parts whose number grows with the bytes of the texts.

Edge cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing; of equal rows with one doc_id neither is
earlier; rows that repeat a doc_id with another text are documents of their own, in the order of their texts' hashes;
a row with a null doc_id loses nothing and makes others lose nothing; very long texts are worked on whole, an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, drop, partitions, stored
from .shingles import _RANDOM, mixed, slices, span_hashes

_OTHER = np.random.default_rng(20_26).integers(1, 1 << 63, size=(256,), dtype=np.uint64)

LENGTH = 100
Q = 25
WINDOW = LENGTH - Q + 1
#: Different stretches of one q-gram in a batch that are sent to its bucket.
WITNESSES = 64
#: Stretches of one q-gram that may be refined in one task.
HOT = 100_000
#: Bytes of text whose records make a part, if that gives more parts than four for each shuffle partition.
PART_BYTES = 256 << 20
#: Bytes of stretches whose windows are refined in one part, about: a window takes 40 bytes while that lasts.
STRETCH_BYTES = 8 << 20
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width], by doubling."""
    n = 1
    while n * 2 <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def representatives(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(at, low, high, q-gram hash, two stretch hashes): windows starting at low..high have the q-gram at ``at`` as least.

    ``raw`` holds texts end to end, ``ends`` says where each ends. Of equal q-grams in a window the first counts.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    values = _RANDOM[raw]
    at = np.arange(len(raw) - Q + 1)
    h = span_hashes(values, at, at + Q)
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    cross = np.zeros(len(raw) + 1, dtype=np.int64)  # q-grams and windows over a border stand for nothing
    np.add.at(cross, np.maximum(starts, ends - Q + 1), 1)
    np.add.at(cross, ends, -1)
    h[np.cumsum(cross)[: len(h)] > 0] = _LAST
    m = _slide(h, WINDOW, np.minimum)
    cross[:] = 0
    np.add.at(cross, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(cross, ends, -1)
    good = np.cumsum(cross)[: len(m)] == 0
    if not good.any():
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    # Runs of windows with one least value.
    change = np.concatenate([[True], (m[1:] != m[:-1]) | (good[1:] != good[:-1])])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:] - 1, [len(m) - 1]])
    real = good[first]
    first, last = first[real], last[real]
    value = m[first]
    # Where those values stand: positions that are least in some window.
    padded = np.concatenate([np.zeros(WINDOW - 1, dtype=np.uint64), np.where(good, m, np.uint64(0)), np.zeros(WINDOW - 1, dtype=np.uint64)])
    spots = np.flatnonzero(_slide(padded, WINDOW, np.maximum) == h)
    ranks, inverse = np.unique(h[spots], return_inverse=True)
    wide = np.int64(len(raw) + LENGTH)
    keys = inverse.astype(np.int64) * wide + spots
    order = np.argsort(keys, kind="stable")
    keys, spots = keys[order], spots[order]
    rank = np.searchsorted(ranks, value).astype(np.int64)
    out = []
    while len(first):  # more than once only where a q-gram repeats within a window
        k = np.searchsorted(keys, rank * wide + first)
        spot = spots[k]
        high = np.minimum(last, spot)
        out.append((spot, first, high))
        more = high < last
        first, last, rank = high[more] + 1, last[more], rank[more]
    at, low, high = (np.concatenate(c) for c in zip(*out, strict=True))
    with np.errstate(over="ignore"):
        stretch = mixed(span_hashes(values, low, high + LENGTH) + (at - low).astype(np.uint64))
    return at, low, high, h[at], stretch, span_hashes(_OTHER[raw], low, high + LENGTH)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])


_FIELDS = ("gram", "stretch", "other", "doc", "nth", "low", "lead", "more", "flag")
#: A record's ``nth`` tells texts of one doc_id apart, its ``lead`` are the bytes of its stretch before the q-gram, its
#: ``more`` the windows beyond the first; its ``flag`` is 0 plain, 1 refined already, 2 gone, 3 beyond the witnesses.
_TYPES = (np.uint64, np.uint64, np.uint64, np.int64, np.int32, np.int32, np.uint8, np.uint8, np.uint8)


def _pack(columns: list[np.ndarray]) -> bytes:
    batch = pa.record_batch([pa.array(c) for c in columns], names=list(_FIELDS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> list[np.ndarray]:
    t = pa.ipc.open_stream(blob).read_all()
    return [t[c].to_numpy() for c in _FIELDS]


def _later(gram: np.ndarray, stretch: np.ndarray, other: np.ndarray, doc: np.ndarray, nth: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, head, gone): sorted by bucket and stretch, the heads of stretches, and what comes strictly after its head.

    Where stretches agree in one hash alone, later ones may count as heads; those are refined on.
    """
    order = np.lexsort((low, nth, doc, stretch, gram))
    g, s, o, d, t, p = gram[order], stretch[order], other[order], doc[order], nth[order], low[order]
    head = np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (o[1:] != o[:-1])])
    top = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, head, (d != d[top]) | (t != t[top]) | (p != p[top])


def _buckets(parts: int):
    """Records of each batch, by bucket, in one binary row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()], batch["doc_id"].to_numpy(zero_copy_only=False)
            numbers = batch["nth"].to_numpy(zero_copy_only=False)
            found = []
            for s in slices(texts):
                raw, ends = _joined(texts[s])
                at, low, high, gram, stretch, other = representatives(raw, ends)
                owner = np.searchsorted(ends, at, side="right")
                begin = np.concatenate([[0], ends[:-1]])[owner] if len(owner) else at
                found.append((gram, stretch, other, ids[s][owner], numbers[s][owner], (low - begin).astype(np.int32), (at - low).astype(np.uint8), (high - low).astype(np.uint8)))
            if not found:
                continue
            gram, stretch, other, doc, text_no, low, lead, more = (np.concatenate(c) for c in zip(*found, strict=True))
            if not len(gram):
                continue
            order, head, gone = _later(gram, stretch, other, doc, text_no, low)
            gram, stretch, other, doc, text_no, low, lead, more = (c[order] for c in (gram, stretch, other, doc, text_no, low, lead, more))
            flag = np.where(gone, 2, 0).astype(np.uint8)
            # Different stretches of one q-gram, counted in this batch.
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            nth = np.cumsum(head)
            nth = nth - nth[np.flatnonzero(new)][np.cumsum(new) - 1]
            bucket = np.cumsum(new) - 1
            many = (np.bincount(bucket, weights=head) > WITNESSES)[bucket] & ~gone
            flag[many] = 1
            part = (gram % np.uint64(parts)).astype(np.int64)
            # Beyond the witnesses, and for what is gone, the bucket is of no use: spread by document.
            spread = gone | (many & (nth >= WITNESSES))
            part[spread] = doc[spread] % parts
            gram = np.where(gone, np.uint64(0), gram)
            stretch, other = (np.where(gone, np.uint64(0), c) for c in (stretch, other))
            flag[many & (nth >= WITNESSES)] = 3
            by_part = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[by_part])) + 1
            rows = np.split(by_part, cuts)
            yield pa.record_batch([pa.array(part[[r[0] for r in rows]].astype(np.int32)), pa.array([_pack([c[r] for c in (gram, stretch, other, doc, text_no, low, lead, more, flag)]) for r in rows], pa.binary())], names=["part", "records"])

    return run


def _first_refinement(t: pa.Table) -> pa.Table:
    """Of one part: stretches that are gone (open false), and those to refine on (open true)."""
    gram, stretch, other, doc, nth, low, lead, more, flag = (np.concatenate(c) for c in zip(*(_unpack(b) for b in t["records"].to_pylist()), strict=True))
    sure = flag >= 2
    out = [(doc[sure], nth[sure], low[sure], lead[sure], more[sure], flag[sure] == 3)]
    rest = ~sure
    gram, stretch, other, doc, nth, low, lead, more, flag = (c[rest] for c in (gram, stretch, other, doc, nth, low, lead, more, flag))
    if len(gram):
        order, head, gone = _later(gram, stretch, other, doc, nth, low)
        gram, doc, nth, low, lead, more, flag = (c[order] for c in (gram, doc, nth, low, lead, more, flag))
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        bucket = np.cumsum(new) - 1
        # A witness stands for stretches that were sent elsewhere.
        several = ((np.bincount(bucket, weights=head) > 1) | (np.bincount(bucket, weights=flag == 1) > 0))[bucket]
        # Of a frequent q-gram, every batch's witnesses go on: other batches may have equal windows.
        on = ((head & several) | (flag == 1)) & ~gone
        for keep, state in ((gone, False), (on, True)):
            out.append((doc[keep], nth[keep], low[keep], lead[keep], more[keep], np.full(int(keep.sum()), state)))
    doc, nth, low, lead, more, state = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "nth": pa.array(nth, pa.int32()), "low": pa.array(low, pa.int32()), "lead": pa.array(lead.astype(np.int32)), "more": pa.array(more.astype(np.int32)), "open": pa.array(state)})


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches' bytes, with their q-gram's identifier."""
    for batch in batches:
        texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
        spans = batch["spans"].to_pylist()
        doc, nth, low, lead, cut = [], [], [], [], []
        for d, n, t, each in zip(batch["doc_id"].to_pylist(), batch["nth"].to_pylist(), texts, spans, strict=True):
            for s in each:
                doc.append(d)
                nth.append(n)
                low.append(s["low"])
                lead.append(s["lead"])
                cut.append(t[s["low"] : s["low"] + s["more"] + LENGTH])
        for s in slices(cut):
            raw, ends = _joined(cut[s])
            at = ends - [len(c) for c in cut[s]] + lead[s]
            gram = span_hashes(_RANDOM[raw], at, at + Q) if len(at) else np.zeros(0, dtype=np.uint64)
            yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(doc[s], pa.int64()), pa.array(nth[s], pa.int32()), pa.array(low[s], pa.int32()), pa.array(cut[s], pa.binary())], names=["gram", "doc_id", "nth", "low", "bytes"])


def _windows(cut: list[bytes], doc: np.ndarray, nth: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """(raw, start in raw, row, doc, nth, start in its document) of every window of the stretches."""
    raw, ends = _joined(cut)
    size = np.array([len(c) for c in cut], dtype=np.int64)
    n = size - LENGTH + 1
    row = np.repeat(np.arange(len(cut)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return raw, (ends - size)[row] + k, row, doc[row], nth[row], low[row].astype(np.int64) + k


def refine(raw: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of windows: (those left in buckets of several, their final buckets)."""

    def shared(bucket: np.ndarray) -> np.ndarray:
        return np.bincount(bucket)[bucket] > 1

    values = _RANDOM[raw]
    alive = np.arange(len(start))
    points = np.unique(np.concatenate([start + k for k in range(0, LENGTH, Q)]))
    _, pointer = np.unique(span_hashes(values, points, points + Q), return_inverse=True)  # bucket of each q-gram
    of = lambda at, table: table[np.searchsorted(points, at)]
    alive = alive[shared(of(start[alive], pointer))]
    # The pairs of q-gram buckets at a window's start and middle make the buckets of 2q bytes, for both at once.
    halves = np.unique(np.concatenate([start[alive], start[alive] + 2 * Q]))
    _, double = np.unique(of(halves, pointer).astype(np.int64) * len(points) + of(halves + Q, pointer), return_inverse=True)
    half = lambda at: double[np.searchsorted(halves, at)]
    alive = alive[shared(half(start[alive]))] if len(alive) else alive
    if not len(alive):
        return alive, alive
    _, bucket = np.unique(half(start[alive]).astype(np.int64) * (len(halves) + 1) + half(start[alive] + 2 * Q), return_inverse=True)
    keep = shared(bucket)
    return alive[keep], bucket[keep]


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Whether the windows at ``a`` and ``b`` hold the same bytes."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    view = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    return np.concatenate([(view[a[i : i + step]] == view[b[i : i + step]]).all(axis=1) for i in range(0, len(a), step)])


def _gone(raw: np.ndarray, start: np.ndarray, row: np.ndarray, doc: np.ndarray, nth: np.ndarray, at: np.ndarray) -> pa.Table:
    """Intervals of windows that aren't the first of their bucket."""
    alive, bucket = refine(raw, start)
    order = np.lexsort((at[alive], nth[alive], doc[alive], bucket))
    alive, bucket = alive[order], bucket[order]
    head = np.concatenate([[True], bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, dtype=bool)
    top = alive[head][np.cumsum(head) - 1]
    late = (doc[alive] != doc[top]) | (nth[alive] != nth[top]) | (at[alive] != at[top])
    alive, top = alive[late], top[late]
    late = np.sort(alive[_same(raw, start[alive], start[top])])
    new = np.concatenate([[True], (late[1:] != late[:-1] + 1) | (row[late[1:]] != row[late[:-1]])]) if len(late) else np.zeros(0, dtype=bool)
    first = late[new]
    last = late[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(late) - 1]])] if len(late) else late
    return pa.table({"doc_id": pa.array(doc[first], pa.int64()), "nth": pa.array(nth[first], pa.int32()), "start": pa.array(at[first].astype(np.int32)), "end": pa.array((at[last] + LENGTH).astype(np.int32))})


def _last_refinement(t: pa.Table) -> pa.Table:
    return _gone(*_windows(t["bytes"].to_pylist(), t["doc_id"].to_numpy(), t["nth"].to_numpy(), t["low"].to_numpy()))


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a frequent q-gram's stretches with its identifier."""
    for batch in batches:
        if batch.num_rows:
            raw, start, _, doc, nth, at = _windows(batch["bytes"].to_pylist(), batch["doc_id"].to_numpy(), batch["nth"].to_numpy(), batch["low"].to_numpy())
            ids = [pa.array(span_hashes(table[raw], start, start + LENGTH).view(np.int64)) for table in (_RANDOM, _OTHER)]
            yield pa.record_batch([*ids, pa.array(doc), pa.array(nth), pa.array(at.astype(np.int32))], names=["window", "other", "doc_id", "nth", "start"])


#: Rows of a table of (doc_id, text hash, number) that may be broadcast: 24 bytes each.
BROADCAST_ROWS = 100_000


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, nth, <others>): texts that share a doc_id get numbers by their hash, equal rows the same one.

    Nearly always 0: only ids with several texts are joined, broadcast if they are few.
    """
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    each = hashed.filter("doc_id is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("_hash")).alias("all")).filter(F.size("all") > 1)
    numbers, n = counted(each.select("doc_id", F.posexplode("all").alias("nth", "_hash")), "texts-of-one-id")
    if not n:
        return docs.withColumn("nth", F.lit(0))
    numbers = F.broadcast(numbers) if n <= BROADCAST_ROWS else numbers
    return hashed.join(numbers, ["doc_id", "_hash"], "left").drop("_hash").withColumn("nth", F.coalesce("nth", F.lit(0)))


_WHO = ("doc_id", "nth")


def repeated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, nth, start, end (bytes): stretches of :func:`told_apart` texts that earlier ones repeat; they may overlap."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select("doc_id", "nth", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark, 4), -(-size // PART_BYTES))
    records = docs.filter(F.octet_length("text") >= LENGTH).mapInArrow(_buckets(parts), "part int, records binary")
    first = stored(records.groupBy("part").applyInArrow(_first_refinement, "doc_id long, nth int, low int, lead int, more int, open boolean"), "first-refinement")
    done = first.filter("not open").select(*_WHO, F.col("low").alias("start"), (F.col("low") + F.col("more") + LENGTH).alias("end"))
    spans = first.filter("open").select(*_WHO, "low", "lead", "more").distinct().groupBy(*_WHO).agg(F.collect_list(F.struct("low", "lead", "more")).alias("spans"))
    rows = stored(docs.join(spans, list(_WHO)).mapInArrow(_cut_out, "gram long, doc_id long, nth int, low int, bytes binary"), "stretches")
    per = rows.groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.octet_length("bytes")).alias("size"))
    totals = per.agg(F.sum("size")).first()[0] or 0
    parts = max(parts, -(-totals // STRETCH_BYTES))  # windows of a part are held at once
    frequent = per.filter(F.col("n") > hot).select("gram")
    # few: each holds more than ``hot`` stretches
    plain = rows.join(frequent, "gram", "left_anti").withColumn("part", F.pmod(F.col("gram"), F.lit(parts)))
    refined = plain.groupBy("part").applyInArrow(_last_refinement, "doc_id long, nth int, start int, end int")
    windows = rows.join(frequent, "gram", "left_semi").select("bytes", *_WHO, "low").mapInArrow(_identified, "window long, other long, doc_id long, nth int, start int")
    place = F.struct(*_WHO, "start")
    heads = windows.groupBy("window", "other").agg(F.min(place).alias("head"))
    late = windows.join(heads, ["window", "other"]).filter(place > F.col("head")).select(*_WHO, "start", (F.col("start") + LENGTH).alias("end"))
    out = done.unionByName(stored(refined.unionByName(late), "refined"))
    drop(rows)
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["gone"].to_pylist(), strict=True):
            t = t or b""
            digest, at, removed, runs = hashlib.sha256(), 0, 0, 0
            last = -1
            for s in sorted((s["start"], s["end"]) for s in spans or ()):
                if s[1] <= last:
                    continue
                if s[0] > last:
                    runs += 1
                    digest.update(t[at : s[0]])
                    removed += s[1] - s[0]
                else:
                    removed += s[1] - last
                at = last = s[1]
            digest.update(t[at:])
            rows.append((len(t), removed, runs, digest.hexdigest()))
        n, removed, runs, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    gone = stored(repeated(docs, hot).groupBy(*_WHO).agg(F.collect_list(F.struct("start", "end")).alias("gone")), "gone")
    rows = docs.select(*_WHO, "text").join(gone, list(_WHO), "left")
    return rows.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with their repeated bytes taken out; what is cut within a character is dropped."""
    for batch in batches:
        out = []
        for t, spans in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["gone"].to_pylist(), strict=True):
            keep = np.ones(len(t or b""), dtype=bool)
            for s in spans or ():
                keep[s["start"] : s["end"]] = False
            out.append(None if t is None else np.frombuffer(t, dtype=np.uint8)[keep].tobytes().decode("utf-8", "ignore"))
        yield pa.record_batch([batch["row"], pa.array(out, pa.string())], names=["row", "text"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut from ``text``; null texts stay null, other columns of any name stay."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)))
    told = told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row")))
    gone = repeated(told).groupBy(*_WHO).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    rows = told.join(gone, list(_WHO), "left")
    cut = rows.select("row", "text", "gone").mapInArrow(_without, f"row {rows.schema['row'].dataType.simpleString()}, text string")
    return cut.select(*(F.col("text") if c == "text" else F.col(f"row.c{rest.index(c)}").alias(c) for c in docs.columns))
