"""Vectorised words over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower
case.  They are found and hashed with array operations over windows of the
UTF-8 data, so no Python object is made for a word and the memory in use does
not depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
WINDOW_BYTES = 1_000_000

_U = np.uint64
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, WINDOW_BYTES // 4)
        for key, base in (("up", _RADIX), ("down", _RADIX_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[key] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; a longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a run of documents.

    ``doc`` is the document's position, ``start`` and ``end`` are byte places in
    ``data``, ``hash`` identifies the word in lower case.
    """

    __slots__ = ("data", "doc", "end", "hash", "offsets", "prefix", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), punctuation: np.ndarray | None = None) -> None:
        """``prefixes``: also hash the first so many bytes of each word (0 where the
        word is not longer).  ``punctuation``: bytes that count as space too."""
        self.data, self.offsets = data, offsets
        space = _SPACE if punctuation is None else _SPACE | punctuation
        starts, ends, hashes = [], [], []
        heads: list[list[np.ndarray]] = [[] for _ in prefixes]
        for low, high in _windows(data, offsets, space):
            s, e, h, p = _words(data, offsets, low, high, space, prefixes)
            starts.append(s)
            ends.append(e)
            hashes.append(h)
            for held, x in zip(heads, p, strict=True):
                held.append(x)
        empty = np.zeros(0, np.int64)
        self.start = np.concatenate(starts or [empty])
        self.end = np.concatenate(ends or [empty])
        self.hash = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.prefix = [np.concatenate(x or [np.zeros(0, np.uint64)]) for x in heads]
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1

    def bounds(self) -> np.ndarray:
        """Word i of document d lies in [bounds[d], bounds[d + 1])."""
        return np.searchsorted(self.start, self.offsets)


def _windows(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that no word crosses."""
    n, low = len(data), 0
    while low < n:
        high = min(low + WINDOW_BYTES, n)
        step = 4096
        while high < n:
            back = np.flatnonzero(space[data[max(low, high - step) : high]])
            if len(back):
                high = max(low, high - step) + int(back[-1]) + 1
                break
            cut = int(offsets[np.searchsorted(offsets, high, side="right") - 1])
            if cut > max(low, high - step):
                high = cut
                break
            if high - step > low:
                step *= 4
                continue
            high = min(high + WINDOW_BYTES, n)  # a word longer than the window
        yield low, high
        low = high


def _words(data, offsets, low, high, space, prefixes):
    part = data[low:high]
    inside = np.zeros(len(part) + 2, dtype=bool)
    np.logical_not(space[part], out=inside[1:-1])
    edge = np.zeros(len(part) + 1, dtype=bool)
    first, last = np.searchsorted(offsets, (low, high))
    edge[offsets[first:last] - low] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    up, down = _powers(len(part) + 1)
    total = np.zeros(len(part) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[LOWER[part]] * up[: len(part)], out=total[1:])
    value = mix((total[end] - total[start]) * down[start])
    heads = []
    for size in prefixes:
        stop = np.minimum(start + size, len(part))
        head = mix((total[stop] - total[start]) * down[start] + _U(size))
        head[end - start <= size] = 0
        heads.append(head)
    return start + low, end + low, value, heads


_PLACE = [_U(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each document: (values, bounds).

    Values of document d are sorted in values[bounds[d]:bounds[d + 1]].  A
    document with fewer than ``width`` words has its whole sequence as one
    shingle; one without words has none.
    """
    if width > len(_PLACE):
        raise ValueError(f"width is at most {len(_PLACE)}")
    h, at = words.hash, words.bounds()
    n = max(0, len(h) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        rolled += h[i : i + n] * _PLACE[i]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(at) - 1, dtype=np.int64)
    for d in range(len(at) - 1):
        low, high = int(at[d]), int(at[d + 1])
        if high - low >= width:
            own = np.unique(rolled[low : high - width + 1])
        elif high > low:
            whole = (h[low:high] * np.array(_PLACE[: high - low])).sum(keepdims=True)
            own = mix((whole + np.array([high - low], dtype=np.uint64)) * _U(0x2545F4914F6CDD1D))
        else:
            continue
        out.append(own)
        sizes[d] = len(own)
    values = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return values, np.concatenate([[0], np.cumsum(sizes)])
