"""Words and word shingles of Arrow text columns, as arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Words are hashed to 64 bits by a polynomial over their bytes, a whole
slice of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SHINGLE = 5

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers for the places of a shingle, and one for its length.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
_LENGTH = _U(0x1D8E4E27C47D124F)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"], _powers["down"]


@dataclass
class Slice:
    """Documents ``first`` to ``first + len(counts) - 1`` of a batch, and their words in order."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def slices(texts: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """Slices of about a megabyte, or one longer document; null has no words."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        yield _slice(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j


def _slice(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Slice:
    data = _LOWER[data] if lower else data
    word = ~_SPACES[data]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _LENGTH)
    return Slice(first, data, starts, ends, counts, hashes)


def shingle_sets(part: Slice) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its five-word shingles.

    With one to four words the whole sequence is the one shingle; without words: empty.
    """
    h, at = part.hashes, part.offsets
    n = len(h) - SHINGLE + 1
    rolled = np.zeros(max(n, 0), _U)
    for k in range(SHINGLE if n > 0 else 0):
        rolled += h[k : k + n] * _PLACES[k]
    rolled = mixed(rolled)
    found = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(rolled[a : b - SHINGLE + 1])
            found.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            found.append(mixed(np.sum(h[a:b] * _PLACES[: b - a], dtype=_U, keepdims=True) + _U(b - a) * _LENGTH))
        else:
            found.append(h[a:a])
    return found
