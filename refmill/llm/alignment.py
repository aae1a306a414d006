"""Alignment of two tokenizers' tokens by inverted bitmaps of pairs.

Each text is encoded by both tokenizers. Byte offsets where tokens of both end cut it into groups; an occurrence of a
token of A and one of B are linked if their bytes overlap, so between two neighbouring ends of either there is one link.

Containers of at most 65,536 documents hold the inverted lists: for each pair of ids a bitmap of the documents that
link it, and further planes for how often (plane k has the documents whose number of links has bit k). A plane keeps
a pair's documents as a sorted list, or as bits where those are smaller. Planes of slices are OR-merged to a container's.
Containers hold different documents, so what their bitmaps count adds up: documents by the OR of the planes, links by
each plane's count times 2**k. The sums return to the containers, whose lists hand them to the documents.

Only counts of pairs are shuffled, bitmaps stay where they are; a pair has a row for each container, however many
documents hold it. Texts without end are encoded in segments cut at blanks between letters, where neither tokenizer joins
anything, and linked block by block.

The byte-level vocabulary is read from its file and merged by rank; all code points give the ids that its own
library gives. Edge cases: a null or empty text, and one whose tokens' bytes aren't a blank and the text, has no tokens:
zeros and an empty string; equal rows and rows that repeat an id are documents of their own, a null id stays null; of
equal counts all are best; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stored

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Pre-tokenization of the byte-level vocabulary, fixed by it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text linked at a time, of a container's texts, and characters of a segment.
SLICE, CONTAINER, SEGMENT = 2 << 20, 16 << 20, 1 << 20
_DOC_BITS = 16
_CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
_SCHEMA = "container long, docs binary, n_docs int, planes array<struct<pairs: binary, counts: binary, listed: binary, bits: binary>>"
_PLANE = pa.struct([(x, pa.binary()) for x in ("pairs", "counts", "listed", "bits")])
_ARROW = pa.schema([("container", pa.int64()), ("docs", pa.binary()), ("n_docs", pa.int32()), ("planes", pa.list_(_PLANE))])
_DOCS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers(NamedTuple):
    a: object  # encodes by rank
    exact: object  # the library of A's file
    b: object
    a_bytes: pa.Array  # of each id
    b_bytes: pa.Array
    a_size: np.ndarray
    b_size: np.ndarray
    written: pa.Array  # ids of A with "," and "|", then of B with "," and ";"


@lru_cache(maxsize=2)
def tokenizers(a_file: str = A_FILE, b_file: str = B_FILE) -> Tokenizers:
    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    read, of = json.loads(open(a_file, encoding="utf-8").read()), byte_alphabet()
    special = {x["content"] for x in read.get("added_tokens", ()) if x["special"]}
    ranks = {bytes(of[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special}
    a_bytes = [b""] * (1 + max(ranks.values()))
    for t, i in ranks.items():
        a_bytes[i] = t
    exact = Tokenizer.from_file(a_file)
    exact.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=b_file)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    written = [f"{i}{s}" for i in range(len(a_bytes)) for s in ",|"] + [f"{i}{s}" for i in range(len(b_bytes)) for s in ",;"]
    size = lambda x: np.array([len(t) for t in x], dtype=np.int64)
    a = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizers(a, exact, sp, pa.array(a_bytes, pa.binary()), pa.array(b_bytes, pa.binary()), size(a_bytes), size(b_bytes), pa.array([x.encode() for x in written], pa.binary()))


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text cut at some blanks, which are left out."""
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def _ids_a(t: Tokenizers, part: str) -> np.ndarray:
    try:
        return np.array(t.a.encode_ordinary(" " + part), dtype=np.int64)
    except (ValueError, RuntimeError):  # the expression's limit
        return np.array(t.exact.encode(" " + part, add_special_tokens=False).ids, dtype=np.int64)


def encoded(t: Tokenizers, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of each text by A and by B."""
    parts = [segments(x) for x in texts]
    a = [np.concatenate([_ids_a(t, p) for p in each]) for each in parts]
    flat = iter(t.b.encode([p for each in parts for p in each], num_threads=1))
    b = [np.concatenate([np.array(next(flat), dtype=np.int64) for _ in each]) for each in parts]
    return a, b


def _bytes_of(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries end to end, and where each starts, and the last ends."""
    got = table.take(pa.array(ids))
    offsets = np.asarray(pa.Array.from_buffers(pa.int32(), len(got) + 1, [None, got.buffers()[1]], offset=got.offset))
    return np.frombuffer(got.buffers()[2] or b"", dtype=np.uint8), offsets


def _lossless(table: pa.Array, ids: list[np.ndarray], want: list[bytes]) -> np.ndarray:
    """Of each text, whether the tokens' bytes are ``want``."""
    raw, offsets = _bytes_of(table, np.concatenate(ids))
    ends = np.cumsum([len(x) for x in ids])
    data = memoryview(raw)
    return np.array([data[offsets[e - len(x)] : offsets[e]] == w for e, x, w in zip(ends.tolist(), ids, want, strict=True)], dtype=bool)


class Slice(NamedTuple):
    counts: np.ndarray  # n_a, n_b, n_groups, n_links of each text
    digests: list[str]
    codes: np.ndarray  # pair << 16 | document, sorted
    times: np.ndarray  # links of each


def linked(t: Tokenizers, texts: list[str], first: int = 0, block: int = SLICE) -> Slice:
    """Groups and links of texts, the first of which is document ``first`` of its container."""
    counts, digests = np.zeros((len(texts), 4), dtype=np.int64), [""] * len(texts)
    none = np.zeros(0, dtype=np.int64)
    full = [i for i, x in enumerate(texts) if x]
    if not full:
        return Slice(counts, digests, none, none)
    want = [b" " + texts[i].encode() for i in full]
    a, b = encoded(t, [texts[i] for i in full])
    good = _lossless(t.a_bytes, a, want) & _lossless(t.b_bytes, b, want)
    a, b, doc = ([x for x, ok in zip(y, good, strict=True) if ok] for y in (a, b, full))
    if not doc:
        return Slice(counts, digests, none, none)
    doc = np.array(doc)
    counts[doc, 0], counts[doc, 1] = [len(x) for x in a], [len(x) for x in b]
    a_doc = np.repeat(doc, counts[doc, 0])
    a, b = np.concatenate(a), np.concatenate(b)
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    total = int(a_end[-1])
    doc_end = np.cumsum([len(w) for w, ok in zip(want, good, strict=True) if ok])
    ends = np.zeros(total + 1, dtype=np.uint8)
    ends[a_end] = 1
    ends[b_end] |= 2
    common = np.flatnonzero(ends == 3)
    cuts = np.unique(np.append(common[np.searchsorted(common, np.arange(block, total, block))], total))
    hashes = {}
    codes, times = [], []
    low = a0 = b0 = 0
    for high in cuts.tolist():
        at = np.flatnonzero(ends[low + 1 : high + 1])
        kind = ends[low + 1 : high + 1][at]
        is_a, is_b, both = kind & 1 == 1, kind & 2 == 2, kind == 3
        n_a, n_b = np.cumsum(is_a), np.cumsum(is_b)
        x, y = a[a0 : a0 + n_a[-1]], b[b0 : b0 + n_b[-1]]
        owner = a_doc[a0 : a0 + n_a[-1]][n_a - is_a]  # of each link
        code = np.sort((x[n_a - is_a] * len(t.b_size) + y[n_b - is_b] << _DOC_BITS) | (owner + first))
        start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        codes.append(code[start])
        times.append(np.diff(np.append(start, len(code))))
        counts[:, 3] += np.bincount(owner, minlength=len(texts))
        counts[:, 2] += np.bincount(owner[both], minlength=len(texts))
        # Each group's ids of A, then those of B.
        group = np.cumsum(both) - both
        through_a, through_b = n_a[both], np.concatenate([[0], n_b[both]])
        order = np.empty(len(x) + len(y), dtype=np.int64)
        order[np.arange(len(x)) + through_b[group[is_a]]] = x * 2 + both[is_a]
        order[np.arange(len(y)) + through_a[group[is_b]]] = 2 * len(t.a_size) + y * 2 + both[is_b]
        raw, offsets = _bytes_of(t.written, order)
        data = memoryview(raw)
        inside = np.searchsorted(doc_end, low, side="right")
        begin = 0
        for k in range(inside, len(doc)):
            over = doc_end[k] <= high
            i = int(np.searchsorted(at, min(doc_end[k], high) - low - 1))
            stop = int(offsets[n_a[i] + n_b[i]])
            hashes.setdefault(k, hashlib.sha256()).update(data[begin : stop - int(over)])
            begin = stop
            if over:
                digests[doc[k]] = hashes.pop(k).hexdigest()
            if doc_end[k] >= high:
                break
        low, a0, b0 = high, a0 + int(n_a[-1]), b0 + int(n_b[-1])
    if len(codes) == 1:
        return Slice(counts, digests, codes[0], times[0])
    code, place = np.unique(np.concatenate(codes), return_inverse=True)
    summed = np.zeros(len(code), dtype=np.int64)
    np.add.at(summed, place, np.concatenate(times))
    return Slice(counts, digests, code, summed)


def planes_of(codes: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Plane k: the codes whose number of links has bit k."""
    return [codes[times >> k & 1 == 1] for k in range(int(times.max(initial=0)).bit_length())]


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """OR of the planes of slices with different documents."""
    out = []
    for k in range(max(map(len, parts), default=0)):
        plane = np.concatenate([p[k] for p in parts if len(p) > k])
        plane.sort()
        out.append(plane)
    return out


def compressed(plane: np.ndarray, n_docs: int) -> dict[str, bytes]:
    """Pairs, documents of each (0: as bits), listed documents, bits of the frequent pairs."""
    pair, doc = plane >> _DOC_BITS, (plane & (1 << _DOC_BITS) - 1).astype(np.uint16)
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, dtype=np.int64)
    n = np.diff(np.append(start, len(pair)))
    dense = n * 16 > n_docs
    where = np.repeat(dense, n)
    bits = np.zeros((int(dense.sum()), n_docs), dtype=np.uint8)
    bits[np.repeat(np.cumsum(dense) - 1, n)[where], doc[where]] = 1
    return {"pairs": pair[start].tobytes(), "counts": np.where(dense, 0, n).astype(np.uint16).tobytes(), "listed": doc[~where].tobytes(), "bits": np.packbits(bits, axis=1).tobytes()}


class Plane(NamedTuple):
    pairs: np.ndarray
    popcount: np.ndarray  # documents of each pair
    pair_of: np.ndarray  # place in ``pairs`` and document of each entry
    doc: np.ndarray


def restored(packed: dict[str, bytes], n_docs: int) -> Plane:
    pairs, n = np.frombuffer(packed["pairs"], dtype=np.int64), np.frombuffer(packed["counts"], dtype=np.uint16).astype(np.int64)
    dense = n == 0
    bits = np.frombuffer(packed["bits"], dtype=np.uint8).reshape(int(dense.sum()), -1) if dense.any() else np.zeros((0, 1), dtype=np.uint8)
    popcount = n.copy()
    popcount[dense] = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    row, doc = np.nonzero(np.unpackbits(bits, axis=1, count=n_docs))
    listed = np.frombuffer(packed["listed"], dtype=np.uint16)
    pair_of = np.concatenate([np.repeat(np.arange(len(pairs)), n), np.flatnonzero(dense)[row]])
    return Plane(pairs, popcount, pair_of, np.concatenate([listed.astype(np.int64), doc]))


def counted_pairs(planes: list[Plane]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, documents, links) of a container."""
    pairs, place = np.unique(np.concatenate([p.pairs for p in planes]), return_inverse=True)
    links, seen = np.zeros(len(pairs), dtype=np.int64), np.bincount(place, minlength=len(pairs))
    docs, at, shared = np.zeros(len(pairs), dtype=np.int64), 0, []
    for k, p in enumerate(planes):
        here = place[at : at + len(p.pairs)]
        at += len(p.pairs)
        links[here] += p.popcount << k
        alone = seen[here] == 1
        docs[here[alone]] = p.popcount[alone]
        several = ~alone[p.pair_of]
        shared.append(here[p.pair_of[several]] << _DOC_BITS | p.doc[several])
    return pairs, docs + np.bincount(np.unique(np.concatenate(shared)) >> _DOC_BITS, minlength=len(pairs)), links


def _ipc(t: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as writer:
        writer.write_batch(t)
    return sink.getvalue().to_pybytes()


def _containers(a_file: str, b_file: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        t = tokenizers(a_file, b_file)
        ids: list[pa.Array] = []
        counts: list[np.ndarray] = []
        digests: list[str] = []
        parts: list[list[np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            n = np.concatenate(counts)
            docs = pa.record_batch([pa.concat_arrays(ids), *(pa.array(n[:, i]) for i in range(4)), pa.array(digests, pa.string())], names=list(_DOCS))
            packed = [compressed(p, len(n)) for p in merged(parts)]
            out = pa.record_batch([[number], [_ipc(docs)], [len(n)], [packed]], schema=_ARROW)
            for x in (ids, counts, digests, parts):
                x.clear()
            number, held = number + 1, 0
            return out

        for batch in batches:
            sizes = batch["bytes"].to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = (1 << _DOC_BITS) - len(digests)
                stop = at + max(1, min(room, int(np.searchsorted(np.cumsum(sizes[at:]), min(SLICE, size), side="right"))))
                got = linked(t, [x or "" for x in batch["text"].slice(at, stop - at).to_pylist()], len(digests))
                ids.append(batch["doc_id"].slice(at, stop - at))
                counts.append(got.counts)
                digests.extend(got.digests)
                parts.append(planes_of(got.codes, got.times))
                held += int(sizes[at:stop].sum())
                at = stop
                if held >= size or len(digests) == 1 << _DOC_BITS:
                    yield flush()
        if digests:
            yield flush()

    return run


def containers(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, size: int = CONTAINER) -> DataFrame:
    """The inverted bitmaps of all documents, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return stored(rows.mapInArrow(_containers(a_file, b_file, size), _SCHEMA), "pair-bitmaps")


def _popcounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            if row["planes"]:
                pairs, docs, links = counted_pairs([restored(p, row["n_docs"]) for p in row["planes"]])
                yield pa.record_batch([pa.array(np.full(len(pairs), row["container"])), pa.array(pairs), pa.array(docs), pa.array(links)], names=["container", "pair", "n_docs", "n_links"])


def popcounts(bitmaps: DataFrame) -> DataFrame:
    """(container, pair, n_docs, n_links), written to the shared folder."""
    return stored(bitmaps.select("container", "n_docs", "planes").mapInArrow(_popcounts, "container long, pair long, n_docs long, n_links long"), "pair-counts")


def pair_table(per_container: DataFrame, b_size: int) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best) corpus-wide; best: no pair of its id of B has more links."""
    pairs = per_container.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    b = (F.col("pair") % b_size).cast("int").alias("b")
    pairs = pairs.select("pair", F.floor(F.col("pair") / b_size).cast("int").alias("a"), b, "n_docs", "n_links")
    return pairs.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))  # at most a row for each id of A


def _returned(pairs: pa.Table, bitmaps: pa.Table) -> pa.Table:
    """The documents of a container with the scores that its pairs return."""
    row = bitmaps.to_pylist()[0]
    docs = pa.ipc.open_stream(row["docs"]).read_all()
    n = row["n_docs"]
    key = pairs["pair"].to_numpy()
    order = np.argsort(key)
    key, count, best = key[order], pairs["n_links"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    total, n_best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def spread(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact sums: halves stay below 2**53."""
        low, high = (np.bincount(doc, weights=v, minlength=n).astype(np.int64) for v in (value & 0xFFFFFF, value >> 24))
        return low + (high << 24)

    for k, packed in enumerate(row["planes"]):
        p = restored(packed, n)
        at = np.searchsorted(key, p.pairs)[p.pair_of]
        total += spread(p.doc, count[at]) << k
        n_best += spread(p.doc, best[at]) << k
    cols = {c: docs[c] for c in _DOCS[:-1]} | {"n_best": pa.array(n_best), "count_sum": pa.array(total), "groups_sha256": docs["groups_sha256"]}
    return pa.table(cols)


def report(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, size: int = CONTAINER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    bitmaps = containers(docs, a_file, b_file, size)
    per = popcounts(bitmaps)
    table = pair_table(per, len(tokenizers(a_file, b_file).b_size)).select("pair", "n_links", "best")
    back = per.select("container", "pair").join(table, "pair").groupBy("container").cogroup(bitmaps.groupBy("container"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = stored(back.applyInArrow(_returned, schema), "aligned")
    drop(bitmaps, per)
    return out


def dictionary(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """a, b, a_bytes, b_bytes, n_docs, n_links, best: every pair of ids that is linked somewhere."""
    t = tokenizers(a_file, b_file)
    spark = docs.sparkSession
    found = pair_table(popcounts(containers(docs, a_file, b_file)), len(t.b_size)).drop("pair")
    for side, table in (("a", t.a_bytes), ("b", t.b_bytes)):  # as many rows as the vocabulary has
        found = found.join(spark.createDataFrame([(i, x) for i, x in enumerate(table.to_pylist())], f"{side} int, {side}_bytes binary"), side)
    return found
