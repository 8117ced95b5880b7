"""Vectorized word and shingle hashes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            a = np.full(n, base, dtype=_U)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, row bounds into them) of a string array; A-Z count as a-z, null as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    n = len(raw)
    if not n:
        return np.empty(0, dtype=_U), np.zeros(len(bounds), dtype=np.int64)
    inside = ~_BLANK[raw]
    first = np.zeros(n + 1, dtype=bool)  # where a row begins, a word can't go on
    first[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), np.searchsorted(start, bounds)


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``n``-word shingles.

    A row with fewer words has one shingle, its whole sequence; one without words has none.
    """
    hashes, bounds = word_hashes(texts)
    if len(hashes) >= n:
        grams = np.zeros(len(hashes) - n + 1, dtype=_U)
        for k in range(n):
            grams = mix(grams + hashes[k : len(hashes) - n + 1 + k])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            own = np.full(1, b - a, dtype=_U)
            for h in hashes[a:b]:
                own = mix(own + h)
            yield own
        else:
            yield np.empty(0, dtype=_U)
