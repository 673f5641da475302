"""Vectorised word views over Arrow batches of UTF-8 text.

Words are runs of bytes other than ASCII white space, as the contracts define
them. A word's 64-bit hash is a polynomial over random byte values, taken from
prefix sums, so it is the same in every task and on every executor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes of text worked on at a time; one longer text is a slice of its own


def _state() -> dict:
    """Tables that live as long as the Python worker."""
    held = sys.__dict__.setdefault("_tidemark_words", {})
    if not held:
        rng = np.random.Generator(np.random.PCG64(20_240_229))
        values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        folded = values.copy()
        folded[65:91] = values[97:123]
        space = np.zeros(256, bool)
        space[[32, *range(9, 14)]] = True
        base = 0x9E3779B97F4A7C15
        held |= {"values": values, "folded": folded, "space": space, "base": base, "inverse": pow(base, -1, 2**64), "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
    return held


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _state()
    if len(held["up"]) < n:
        m = max(n, SLICE + 1)
        for name, base in (("up", held["base"]), ("down", held["inverse"])):
            out = np.full(m, base, np.uint64)
            out[0] = 1
            held[name] = np.cumprod(out, dtype=np.uint64)
    return held["up"][:n], held["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts: byte bounds, document bounds and, on demand, hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool):
        self.data, self.bounds, self.fold = data, bounds, fold
        solid = ~_state()["space"][data]
        starts, ends = solid.copy(), solid.copy()
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        starts[1:] &= ~solid[:-1]
        starts[inner] = solid[inner]
        ends[:-1] &= ~solid[1:]
        ends[inner - 1] = solid[inner - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        #: words of document d: self.first[d] .. self.first[d + 1]
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def docs(self) -> int:
        return len(self.bounds) - 1

    def hashes(self) -> np.ndarray:
        held, n = _state(), len(self.data)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(held["folded" if self.fold else "values"][self.data] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def word(self, k: int) -> bytes:
        w = self.data[self.starts[k] : self.ends[k]].tobytes()
        return w.lower() if self.fold else w

    def some(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        if self.fold:
            raw = raw.lower()
        return [raw[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a position of each distinct value, the place of each position's value among those)."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = (np.sort((h & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
    sorted_h = h[order]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = sorted_h[1:] != sorted_h[:-1]
    top = sorted_h >> bits
    if (new[1:] & (top[1:] == top[:-1])).any():  # values that agree but in the bits left out: sort in full
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        new[1:] = sorted_h[1:] != sorted_h[:-1]
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def slices(column, fold: bool = False, limit: int = SLICE) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) over a binary Arrow column; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo, rows = 0, len(column)
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], fold)
        lo = hi


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)
