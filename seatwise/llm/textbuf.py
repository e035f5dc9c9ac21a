"""Vectorised kernels over the UTF-8 bytes of a column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Cache(dict):
    """Arrays of this process; pickled empty, as functions travel with the module's globals."""

    def __reduce__(self) -> tuple:
        return _Cache, ()


_POWERS = _Cache()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of whole texts with about ``most`` bytes each; a longer text is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _BASE_INVERSE
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * SLICE_BYTES:
            _POWERS[kind] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``c`` with ``(c[j] - c[i]) * inverse_powers[i]`` the polynomial hash of ``data[i:j]``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans; equal for equal bytes wherever they lie."""
    raw = (prefix[end] - prefix[start]) * _powers("down", len(prefix))[start]
    return splitmix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NOT_ALNUM[_a:_b] = False


def lower_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the capitals of Latin-1, byte for byte in UTF-8."""
    out = LOWER[data]
    if len(out) > 1:
        second = out[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[capital] += 32
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run without break bytes; runs never cross rows."""
    inside = ~breaks[data]
    if not inside.any():
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = edge[edge > 0] - 1
    last[edge] |= inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def gram_hashes(words: np.ndarray, rows: np.ndarray, k: int, n_rows: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles, their rows and their first words, in order.

    With ``short``, a row of fewer than k words has its whole sequence as one shingle.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mult = np.uint64(0xFF51AFD7ED558CCD)
    acc, at = words.copy(), np.arange(n)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    count = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(count) - count
    for j in range(1, k + 1):
        if j < k and short:
            only = begin[count == j]
            parts.append((splitmix(acc[only] ^ np.uint64(j * 0x9E3779B1)), only))
        if j == k:
            m = n - k + 1
            good = np.flatnonzero(rows[:m] == rows[k - 1 :]) if m > 0 else np.zeros(0, np.int64)
            parts.append((splitmix(acc[good] ^ np.uint64(k * 0x9E3779B1)), good))
            break
        nxt = np.zeros(n, np.uint64)
        nxt[: n - j] = words[j:]
        acc = splitmix(acc * mult + nxt)
    hashes, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(at, kind="stable")
    at = at[order]
    return hashes[order], rows[at], at


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: the first row, sorted distinct shingle hashes, and bounds of each row in them.

    Words are the runs between space and control characters, A-Z in lower case.
    """
    data, offsets = buffers(column)
    for a, b in row_slices(offsets):
        part, off = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        start, end, row = word_spans(part, off, SPACES)
        words = span_hash(prefix_hash(part), start, end) if len(start) else np.zeros(0, np.uint64)
        grams, rows, _ = gram_hashes(words, row, k, b - a)
        bounds = np.searchsorted(rows, np.arange(b - a + 1))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            grams[i:j].sort()
        keep = np.ones(len(grams), bool)
        if len(grams):
            keep[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        total = np.concatenate([[0], np.cumsum(keep)])
        yield a, grams[keep], total[bounds]
