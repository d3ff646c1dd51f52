"""Vectorised word, shingle and window hashing over Arrow string columns.

Texts are read straight from the Arrow value buffer, so no Python string is
made.  Words are maximal runs of non-separator bytes; both alphabets used here
(white-space words, alphanumeric words) are defined on single bytes, and bytes
of multi-byte UTF-8 characters are never separators, so byte runs are exactly
the character runs.  ASCII A-Z is folded to a-z; nothing else is.

A word's id is a 64-bit polynomial hash, finished with a bit mixer.  It is the
same on every machine and for every batch layout.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93 | 1

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: White-space words: separators are space and \t \n \v \f \r.
SPACE_SEP = np.zeros(256, dtype=bool)
SPACE_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Alphanumeric words: separators are all ASCII but 0-9 and (folded) a-z.
ALNUM_SEP = np.zeros(256, dtype=bool)
ALNUM_SEP[0x00:0x30] = True
ALNUM_SEP[0x3A:0x61] = True
ALNUM_SEP[0x7B:0x80] = True

_pow = np.ones(1, dtype=_U)
_inv = np.ones(1, dtype=_U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse (grown on demand)."""
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, 1 << 16)
        made = []
        for factor in (_BASE, _BASE_INV):
            steps = np.full(size, factor, dtype=_U)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=_U))
        _pow, _inv = made
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def release() -> None:
    """Give freed memory back to the system.  Workers live on after a partition,
    and what their allocators hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc system
        pass


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; one longer text is a range alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial over ``data``, and the inverse powers."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    with np.errstate(over="ignore"):
        np.cumsum((FOLD[data].astype(_U) + _U(1)) * power[: len(data)], dtype=_U, out=total[1:])
    return total, inverse


def _runs(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a text's edge."""
    n = len(data)
    inside = ~sep[FOLD[data]]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of some texts and each text's range among them: ``bounds`` has
    one entry more than there are texts."""
    if len(data) == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    first, last = _runs(data, offsets, sep)
    total, inverse = _totals(data)
    with np.errstate(over="ignore"):
        ids = mix((total[last] - total[first]) * inverse[first])
    return ids, np.searchsorted(first, offsets)


def subwords(data: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(text of each word, [(ids, words)]): ids of whole words, then of word
    beginnings of each byte length, for the words that are longer than it."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, [(np.zeros(0, _U), none) for _ in (0, *lengths)]
    first, last = _runs(data, offsets, sep)
    total, inverse = _totals(data)
    out = []
    for k in (0, *lengths):
        at = np.arange(len(first)) if k == 0 else np.flatnonzero(last - first > k)
        a = first[at]
        b = last if k == 0 else a + k
        with np.errstate(over="ignore"):
            out.append((mix((total[b] - total[a]) * inverse[a] + _U(k) * _U(_STEP)), at))
    return np.searchsorted(offsets, first, side="right") - 1, out


def grams(ids: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of each run of ``width`` ids (len - width + 1)."""
    m = len(ids) - width + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.full(m, width, dtype=_U)
        for j in range(width):
            out *= _U(_STEP)
            out += ids[j : j + m]
    return mix(out)


def shingle_sets(ids: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Per text: its sorted distinct ``width``-word shingles; a shorter text's
    whole word sequence is its one shingle; a text without words has none."""
    whole = grams(ids, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
        elif b > a:
            yield grams(ids[a:b], b - a)
        else:
            yield np.zeros(0, _U)
