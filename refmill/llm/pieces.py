"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text holds every piece of the vocabulary that occurs in it; a character without a piece is an
edge of its UTF-8 bytes. No piece has a blank after another character, and none has a line break, so the lattice
falls into independent parts there: a part is a run of blanks with the word after it, or a line break. Forward
filtering gives each node the weight of all paths to it, once for every distinct part of a slice of texts;
backward sampling then draws a path for each occurrence. Draws are a function of the row's key, the part's place
and the step alone, so a row is always segmented alike, whatever the partitioning.

A piece's probability is Zipf's for its rank in the vocabulary, to the power ``ALPHA``. A blank is put before the
text, as the vocabulary expects; decoding takes it away again.

Edge cases: a null or empty text has no piece and decodes to the empty text; the sign that stands for a blank in the
vocabulary is written as bytes where it occurs in a text; repeated rows get equal pieces; a null key seeds like 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
#: Characters of text that are worked on at a time.
SLICE = 800_000
_PARTS = re.compile(r"\n| +[^ \n]*|[^ \n]+")
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


class Vocabulary(NamedTuple):
    text: list[bytes]  # of each id, blanks as blanks
    hashes: list[np.ndarray]  # by length: sorted hashes of the beginnings of that length, whole pieces included
    starts: list[np.ndarray]  # by length: where the hashes of each top part start
    ids: list[np.ndarray]  # in the order of the hashes; -1 for what only begins a piece
    score: np.ndarray  # of each id
    byte_ids: np.ndarray
    byte_score: float


@lru_cache(maxsize=4)
def vocabulary(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.vocab_size()
    text, byte_ids = [b""] * n, np.zeros(256, dtype=np.int32)
    plain: dict[int, str] = {}
    for i in range(n):
        if sp.is_byte(i):
            code = int(sp.id_to_piece(i)[1:-1], 16)
            text[i], byte_ids[code] = bytes([code]), i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain[i] = sp.id_to_piece(i).replace("▁", " ")
            text[i] = plain[i].encode()
    if any(re.search(r"[^ ] |\n", p) for p in plain.values()):
        raise ValueError("a piece has a blank after another character or a line break: parts would not be independent")
    score = np.full(n, -np.inf)
    ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
    score[ranked] = -alpha * np.log(np.arange(len(ranked)) + 2.7)
    hashes, starts, ids = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int32)]
    for length in range(1, max(map(len, plain.values())) + 1):
        own = {p: i for i, p in plain.items() if len(p) == length}
        own = {p[:length]: -1 for p in plain.values() if len(p) > length} | own
        h = _span_hashes(_codes("".join(own)), np.arange(len(own)) * length, length)
        order = np.argsort(h)
        hashes.append(h[order])
        tops = np.arange(8 << len(own).bit_length(), dtype=np.uint64) << _U(64 - 3 - len(own).bit_length())
        starts.append(np.searchsorted(h[order], tops).astype(np.int32))
        ids.append(np.fromiter(own.values(), dtype=np.int32)[order])
    return Vocabulary(text, hashes, starts, ids, score, byte_ids, -alpha * np.log(len(ranked) + 2.7))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64: decorrelates 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _span_hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        c = _mixed(codes.astype(np.uint64) + _BASE)
        h = np.zeros(len(starts), dtype=np.uint64)
        for k in range(length):
            h = h * _BASE + c[starts + k]
    return h


def _found(h: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where each of ``h`` stands among sorted hashes, -1 for nowhere: by its top bits, then one after another."""
    at = starts[(h >> _U(64 - (len(starts).bit_length() - 1))).astype(np.int64)]
    out = np.full(len(h), -1, dtype=np.int64)
    going = np.arange(len(h))
    while len(going):
        here = at[going]
        inside = here < len(hashes)
        going, here = going[inside], here[inside]
        seen = hashes[here]
        equal = seen == h[going]
        out[going[equal]] = here[equal]
        going = going[seen < h[going]]
        at[going] += 1
    return out


class Lattice(NamedTuple):
    """Of distinct parts, laid end to end. Node ``base[u] + j`` is after j characters of part u."""

    base: np.ndarray
    length: np.ndarray
    cumulative: np.ndarray  # node + the cumulated probability of the edges into it
    last: np.ndarray  # of each node: its last edge
    span: np.ndarray  # of each edge: its characters
    piece: np.ndarray  # of each edge: its id, or -1 - code point for bytes


def lattice(parts: list[str], v: Vocabulary) -> Lattice:
    """Forward filtering of all ``parts`` at once, level by level: a level is the nodes after j characters."""
    length = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    codes = _codes("".join(parts))
    end = np.cumsum(length)
    base = end - length + np.arange(len(parts))
    at = np.arange(len(codes)) + np.repeat(np.arange(len(parts)), length)  # node before each character
    left = np.repeat(end, length) - np.arange(len(codes))  # characters of the part from here on
    edges: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # node, characters, piece, log weight
    single = np.zeros(len(codes), dtype=bool)
    with np.errstate(over="ignore"):
        c = _mixed(codes.astype(np.uint64) + _BASE)
        fits, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, len(v.hashes)):  # only what begins a piece goes on
            going = left[fits] >= n
            fits = fits[going]
            if not len(fits):
                break
            h = h[going] * _BASE + c[fits + n - 1]
            found = _found(h, v.hashes[n], v.starts[n])
            hit = found >= 0
            fits, h, got = fits[hit], h[hit], v.ids[n][found[hit]]
            whole = got >= 0
            edges.append((at[fits[whole]] + n, n, got[whole], v.score[got[whole]]))
            if n == 1:
                single[fits[whole]] = True
    bare = np.flatnonzero(~single)  # no piece of its own: bytes
    code = codes[bare].astype(np.int64)
    edges.append((at[bare] + 1, 1, (-1 - code).astype(np.int32), v.byte_score * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))))
    node = np.concatenate([e[0] for e in edges])
    order = np.argsort(node, kind="stable")  # of sorted runs
    node = node[order]
    span = np.concatenate([np.full(len(e[0]), e[1], dtype=np.int64) for e in edges])[order]
    piece = np.concatenate([e[2] for e in edges])[order]
    score = np.concatenate([e[3] for e in edges])[order]
    # Edges by level, and within it by node.
    level = (node - np.repeat(base, length + 1)[node]).astype(np.int32)
    level = level.astype(np.int16) if len(level) and level.max() < 32_000 else level
    by_level = np.argsort(level, kind="stable")
    sizes = np.bincount(level)
    l_node, l_from, l_score = node[by_level], (node - span)[by_level], score[by_level]
    first = np.concatenate([[True], l_node[1:] != l_node[:-1]]) if len(l_node) else np.zeros(0, dtype=bool)
    alpha = np.zeros(len(codes) + len(parts))
    a = 0
    for size in sizes[1:]:
        b = a + size
        paths = alpha[l_from[a:b]] + l_score[a:b]
        heads = np.flatnonzero(first[a:b])
        top = np.maximum.reduceat(paths, heads)
        total = np.add.reduceat(np.exp(paths - np.repeat(top, np.diff(heads, append=size))), heads)
        alpha[l_node[a:b][heads]] = top + np.log(total)
        a = b
    p = np.exp(alpha[node - span] + score - alpha[node])
    upto = np.cumsum(p)
    first = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=bool)
    cumulative = node + np.minimum(upto - (upto - p)[first][np.cumsum(first) - 1], 1.0)
    last = np.zeros(len(alpha), dtype=np.int64)
    last[node] = np.arange(len(node))
    return Lattice(base, length, cumulative, last, span, piece)


def sample(lat: Lattice, part: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling: (pieces, pieces of each occurrence) of occurrences of ``part`` with their own seeds."""
    who, node, base = np.arange(len(part)), lat.base[part] + lat.length[part], lat.base[part]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.zeros(len(part), dtype=np.int64)
    while len(who):
        with np.errstate(over="ignore"):
            r = (_mixed(seed[who] + _U(len(steps) + 1) * _BASE) >> _U(11)).astype(np.float64) / float(1 << 53)
        e = np.minimum(np.searchsorted(lat.cumulative, node + r, side="right"), lat.last[node])
        steps.append((who, lat.piece[e]))
        count[who] += 1
        node = node - lat.span[e]
        more = node > base[who]
        who, node = who[more], node[more]
    end = np.cumsum(count)
    out = np.empty(int(end[-1]) if len(end) else 0, dtype=np.int32)
    for k, (who, piece) in enumerate(steps):  # drawn from the last piece to the first
        out[end[who] - 1 - k] = piece
    return out, count


def encode(texts: list[str | None], keys: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each text)."""
    each = [_PARTS.findall(f" {t}") if t else [] for t in texts]
    per_text = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    total = int(per_text.sum())
    if not total:
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    part, distinct = pd.factorize(np.array([p for ps in each for p in ps], dtype=object))
    place = np.arange(total) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    with np.errstate(over="ignore"):
        seed = _mixed(_mixed(np.repeat(keys.astype(np.uint64), per_text)) + (place.astype(np.uint64) + _U(1)) * _BASE)
    pieces, count = sample(lattice(list(distinct), v), part, seed)
    owner = np.repeat(np.repeat(np.arange(len(texts)), per_text), count)
    bare = pieces < 0
    if bare.any():  # a character as the ids of its bytes
        raw = [chr(-1 - c).encode() for c in pieces[bare]]
        times = np.ones(len(pieces), dtype=np.int64)
        times[bare] = [len(b) for b in raw]
        first = (np.cumsum(times) - times)[bare]
        owner, pieces = np.repeat(owner, times), np.repeat(pieces, times)
        width = times[bare]
        spots = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        pieces[spots] = v.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    return pieces, np.bincount(owner, minlength=len(texts))


def decode(ids: list[int] | np.ndarray, v: Vocabulary) -> str:
    """The text whose pieces these are."""
    return b"".join([v.text[i] for i in ids])[1:].decode()


def _slices(texts: list[str | None]) -> Iterator[slice]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _encoder(model: str, alpha: float, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, alpha)
        for batch in batches:
            texts, keys = batch["text"].to_pylist(), batch["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            for s in _slices(texts):
                ids, count = encode(texts[s], keys[s], v)
                offsets = np.concatenate([[0], np.cumsum(count)])
                lossless = [decode(ids[a:b].tolist(), v) == (t or "") for a, b, t in zip(offsets, offsets[1:], texts[s], strict=False)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                rows = batch.slice(s.start, s.stop - s.start)
                yield pa.record_batch([rows[f"kept{i}"] for i in range(len(keep))] + [pa.array(count, pa.int64()), lists, pa.array(lossless, pa.bool_())], names=[*keep, "n_tokens", "token_ids", "lossless"])

    return run


def tokenize(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, model: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """``keep`` columns (all, by default) with n_tokens, token_ids and lossless: whether decoding gives the text again.

    Kept columns of these three names are replaced; any other name may be kept.
    """
    keep = tuple(docs.columns) if keep is None else keep
    keep = tuple(c for c in keep if c not in ("n_tokens", "token_ids", "lossless"))
    seeded = docs.select(*(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(keep)), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("0"))).alias("key"))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long, token_ids array<int>, lossless boolean"
    return seeded.mapInArrow(_encoder(model, alpha, list(keep)), schema)


def detokenize(df: DataFrame, ids: str = "token_ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the texts of its pieces in ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            texts = pa.array([decode(x or [], v) for x in batch[ids].to_pylist()], pa.string())
            keep = [c for c in batch.schema.names if c != out]
            yield pa.record_batch([batch[c] for c in keep] + [texts], names=[*keep, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out) + f", `{out}` string"
    return df.mapInArrow(run, schema)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, token_ids, lossless."""
    return tokenize(docs, keep=("doc_id",))
