"""Words and rolling hashes of many documents at once, on the bytes that Arrow delivers.

Everything here runs inside tasks.  A batch is looked at in slices of about one megabyte, so
memory follows the slice (or one longer document), not the batch.
"""

from __future__ import annotations

import numpy as np

SLICE_BYTES = 1 << 20
#: The six ASCII characters that separate words (space and tab to carriage return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the SplitMix64 finish)."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def byte_table(seed: int, fold_case: bool) -> np.ndarray:
    """A random 64-bit value per byte; with fold_case A to Z have the values of a to z."""
    table = mix(np.arange(1, 257, dtype=np.uint64), seed)
    if fold_case:
        table[65:91] = table[97:123]
    return table


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    n, wide = len(column), str(column.type).startswith("large")
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column, limit: int = SLICE_BYTES):
    """(first row, bytes, offsets from 0) of consecutive rows with about ``limit`` bytes."""
    data, offsets = utf8(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """Words of a slice: byte ranges, 64-bit hashes, and the word range of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seed: int = 0, fold_case: bool = False):
        gap = _SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        inside = ~gap
        begin, end = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= gap[:-1] | first[1:-1]
            end[:-1] &= gap[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        forward, back = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_table(seed, fold_case)[data] * forward[:-1], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64), seed)

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every run of k words of one document: first word, hash, and window range per document."""
        n = len(self.hashes)
        counts = np.maximum(np.diff(self.bounds) - k + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        at = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], counts)
        forward, back = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * forward[:n], out=sums[1:])
        return at, mix((sums[at + k] - sums[at]) * back[at], seed + k), bounds

    def whole(self, document: int) -> int:
        """Hash of all words of a document in order."""
        part = self.hashes[self.bounds[document]:self.bounds[document + 1]]
        return int(mix((part * powers(len(part) + 1)[0][:len(part)]).sum(keepdims=True), 1000 + len(part))[0])
