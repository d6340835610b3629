"""Array-at-a-time word tools over Arrow string columns.

All helpers work on the UTF-8 bytes of a batch. Separators of every word class used here are
ASCII, so bytes decide word borders exactly; a null text counts as an empty one. Batches are
cut into pieces of about a megabyte (a longer text is a piece of its own), which bounds memory.
"""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_U = np.uint64
#: Odd base of the rolling polynomial and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_GRAM_FACTOR = mix(np.arange(1, 65, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * PIECE), base, _U)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def _class(excluded: list[tuple[int, int]]) -> np.ndarray:
    member = np.ones(256, bool)
    for low, high in excluded:
        member[low : high + 1] = False
    return member


#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = _class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after A-Z became a-z.
LETTER_DIGIT = _class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: A-Z to a-z, everything else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(column, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows that hold about ``size`` bytes."""
    data, off = utf8(column)
    low, n = 0, len(off) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(off, off[low] + size, "right")) - 1)
        high = min(high, n)
        yield low, high, data[off[low] : off[high]], off[low : high + 1] - off[low]
        low = high


def words(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (n+1 long)."""
    inside = member[data]
    begin, last = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = off[:-1] < off[1:]
        at, to = off[:-1][filled], off[1:][filled] - 1
        begin[at], last[to] = inside[at], inside[to]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    n = len(data)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE_VALUE[data] * _power(_BASE, n, "up"), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, n + 1, "down")[start] + (end - start).astype(_U))


def gram_hash(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (by word hash), one for each place where k fit."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = word[:n] * _GRAM_FACTOR[0]
    for j in range(1, k):
        out += word[j : j + n] * _GRAM_FACTOR[j]
    return mix(out)


def long_array(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


def one_blas_thread() -> None:
    """Matrix products of this process on the task's own core; other threads of theirs would only wait for each other."""
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__) + ".libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
