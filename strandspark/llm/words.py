"""Word and shingle hashes of Arrow text columns with numpy: whole batches at a time, no Python work per word."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables["up"]) < n:
        size = max(n, _BLOCK + 4096)
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the splitmix64 finalizer)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: White space of the contracts: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For matching prose: every ASCII character but letters and digits parts words.
PARTS = np.ones(256, bool)
PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20


def spans(raw: np.ndarray, offsets: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; a word never crosses a row."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~parts[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (ascending, not overlapping), after folding single bytes."""
    out = np.empty(len(start), U)
    k = 0
    while k < len(start):
        a = int(start[k])
        stop = max(k + 1, int(np.searchsorted(end, a + _BLOCK, "right")))
        b = int(end[stop - 1])
        up, down = _table(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum((fold[raw[a:b]].astype(U) + U(1)) * up[: b - a], out=sums[1:])
        s, e = start[k:stop] - a, end[k:stop] - a
        out[k:stop] = mix((sums[e] - sums[s]) * down[s])
        k = stop
    return out


def per_row(offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Index of the first word of each row, with the end appended."""
    return np.searchsorted(start, offsets)


_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each position on; the last size - 1 positions reach past the end and count only with rows' bounds."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.zeros(n, U)
    for k in range(size):
        total += words[k : k + n] * U(_ODD[k])
    return mix(total)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending within it: (hashes, offsets). With fewer words, the whole sequence is one shingle."""
    rows = len(first) - 1
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    all_windows = windows(words, size)
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(full)[:-1])), full) + np.arange(int(full.sum()))
    value, row = all_windows[at], np.repeat(np.arange(rows), full)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([_whole(words[first[r] : first[r + 1]]) for r in short], U)
        value, row = np.concatenate((value, extra)), np.concatenate((row, short))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(rows + 1))


def _whole(words: np.ndarray) -> int:
    total = len(words)
    for w, c in zip(words.tolist(), _ODD, strict=False):
        total = (total + w * c) & (1 << 64) - 1
    return int(mix(np.array([total ^ 0x5851F42D4C957F2D], U))[0])
