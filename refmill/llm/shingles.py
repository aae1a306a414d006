"""Word shingles of texts as 64-bit numbers, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at a time.
SLICE = 1_000_000

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20_24).integers(1, 1 << 63, size=(256,), dtype=np.uint64)
_PLACE = np.random.default_rng(20_25).integers(1, 1 << 63, size=(64,), dtype=np.uint64) | _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(1 << bits, _ODD, dtype=np.uint64)
        down = np.full(1 << bits, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of values[start:end] for each pair: differences of a running sum of value times power, brought to the same power."""
    bits = max(20, int(len(values) + 1).bit_length())
    up, down = _powers(bits)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
        return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def slices(texts: list[bytes | None], size: int = SLICE) -> Iterator[slice]:
    """Runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= size:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; A-Z are lower-cased, words part at ASCII blanks.

    A text of fewer words than ``width`` has its whole sequence as one shingle, one without words has none.
    """
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", dtype=np.uint8)
    size = np.fromiter((len(t or b"") for t in texts), dtype=np.int64, count=len(texts)) + 1
    blank = _BLANK[raw]
    before = np.concatenate([[True], blank[:-1]])
    start = np.flatnonzero(~blank & before)
    end = np.flatnonzero(blank & ~before)
    owner = np.searchsorted(np.cumsum(size), start, side="right")
    words = span_hashes(_RANDOM[_LOWER[raw]], start, end)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            whole += words[k : k + len(whole)] * _PLACE[k]
    whole = mixed(whole)
    out = []
    for f, n in zip(first.tolist(), count.tolist(), strict=True):
        if n >= width:
            out.append(np.unique(whole[f : f + n - width + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(mixed((words[f : f + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + _U(n)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
