"""Vectorised access to the texts of an Arrow batch: bytes, words and word hashes as numpy arrays.

Every helper works on whole texts.  A batch is walked in blocks of a few megabytes so that the
arrays of a block stay small; a single longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_pow = _inv = np.ones(1, np.uint64)

#: Separators of the word contracts: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix finaliser on unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            a = np.full(size, _STEP, np.uint64)
            b = np.full(size, pow(_STEP, -1, 2**64), np.uint64)
            a[0] = b[0] = 1
            _pow, _inv = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
    return _pow, _inv


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    big = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def blocks(col: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive runs of rows of about ``size`` bytes."""
    data, offs = column_bytes(col)
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row's border."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offs[:-1][offs[:-1] < len(inside)]
    before[edge] = False
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes have equal hashes wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    pw, inv = _powers(len(data) + 1)
    table = _BYTE if fold is None else _BYTE[fold]
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(table[data] * pw[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _MULT)


def words(data: np.ndarray, offs: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and for each row the index of its first word (n + 1)."""
    s, e = runs(~separator[data], offs)
    return s, e, np.searchsorted(s, offs)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one text's word hashes; a shorter text is one window."""
    n = len(h)
    with np.errstate(over="ignore"):
        if n == 0:
            return h
        width = min(k, n)
        acc = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            acc = (acc ^ h[j : n - width + 1 + j]) * _MULT + np.uint64(j + 1)
            acc ^= acc >> np.uint64(29)
        return mix(acc + np.uint64(width))
