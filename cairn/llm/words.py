"""Words of Arrow text columns, hashed with numpy over whole buffers.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return in the UTF-8 text, that is `[^\\x20\\x09-\\x0D]+`. A word's hash is the polynomial
sum of one random 64-bit number per byte, so equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C55
_UNBASE = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_FOLDED = _TABLE.copy()
_FOLDED[65:91] = _TABLE[97:123]


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = _series(_BASE, size), _series(_UNBASE, size)
        return self.up, self.down


def _series(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U(pow(base, have, 1 << 64))
        have += more
    return out


powers = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes; a longer row is alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _hashed(data: np.ndarray, edges: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = ~SPACE[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner] = full[inner]
    last[inner - 1] = full[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_FOLDED if fold else _TABLE)[data] * up[: len(data)], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start])


def words(data: np.ndarray, at: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows between the offsets `at`: each word's start and end in data, its hash, and for
    each row the number of its first word (one more at the end). fold lower-cases A-Z.
    A row longer than a slice is hashed in pieces cut at white space."""
    lo, hi = int(at[0]), int(at[-1])
    if hi - lo <= 2 * SLICE or len(at) > 2:
        start, end, hashes = _hashed(data[lo:hi], at - lo, fold)
        return start + lo, end + lo, hashes, np.searchsorted(start + lo, at)
    none = np.zeros(0, np.int64)
    starts, ends, all_hashes = [none], [none], [none.astype(U)]
    while lo < hi:
        cut = min(hi, lo + SLICE)
        while cut < hi and not SPACE[data[cut]]:
            stop = min(hi, cut + 4096)
            gap = np.flatnonzero(SPACE[data[cut:stop]])
            cut = cut + int(gap[0]) if len(gap) else stop
        start, end, hashes = _hashed(data[lo:cut], none, fold)
        starts.append(start + lo), ends.append(end + lo), all_hashes.append(hashes)
        lo = cut
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(all_hashes), np.searchsorted(start, at)


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers, for `between`."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def between(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the sequences from start up to end, wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U))
