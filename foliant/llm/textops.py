"""Vectorised hashing of words and shingles over Arrow string columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text. All functions work on
whole texts, a bounded number of bytes at a time (a single longer text is a
chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
SHINGLE_WORDS = 5

U64 = np.uint64


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 20)) * U64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
        return z ^ (z >> U64(31))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(29))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and the bytes of other characters, for words without punctuation.
_NO_WORD = np.zeros(256, bool)
_NO_WORD[:128] = [not chr(c).isalnum() for c in range(128)]
_BYTES = _splitmix(256, 1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_COMBINE = _splitmix(16, 2) | U64(1)
_R = int(_splitmix(1, 3)[0]) | 1
_RINV = pow(_R, -1, 1 << 64)


class Powers:
    """Powers of the hash base and of its inverse, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, CHUNK_BYTES + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(m, r, U64)])) for r in (_R, _RINV))
        return self.up, self.down


POWERS = Powers()


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with at most limit bytes, or of one row."""
    data, offsets = string_buffers(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row (n + 1) the number of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    first, last = np.empty_like(inside), np.empty_like(inside)
    first[0], first[1:] = True, ~inside[:-1]
    last[-1], last[:-1] = True, ~inside[1:]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = True
    last[cuts[cuts > 0] - 1] = True
    starts, ends = np.flatnonzero(first & inside), np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of a sequence of 64-bit codes."""
    up, down = POWERS.get(len(codes) + 1)
    total = np.empty(len(codes) + 1, U64)
    total[0] = 0
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, and for each row (n + 1) the number of its first word; plain: without ASCII punctuation."""
    starts, ends, rows = word_spans(data, offsets, _NO_WORD if plain else _SPACE)
    return span_hashes(_LOWER[data], starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles row by row, and for each row (n + 1) the number of its first shingle.

    A row with fewer words than the width has its whole sequence as the one
    shingle; a row without words has none.
    """
    n = np.diff(rows)
    full = np.zeros(max(0, len(words) - width + 1), U64)
    for k in range(width):
        full += words[k : k + len(full)] * _COMBINE[k]
    counts = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    heads = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(heads[-1], U64)
    keep = np.ones(len(words), bool)  # positions that begin a full shingle inside their row
    for k in range(1, width):
        ends = rows[1:] - k
        keep[ends[(ends >= rows[:-1])]] = False
    short = (n > 0) & (n < width)
    target = np.ones(heads[-1], bool)
    target[heads[:-1][short]] = False
    at = np.flatnonzero(keep)
    out[target] = full[at]
    for r in np.flatnonzero(short):
        own = words[rows[r] : rows[r + 1]]
        out[heads[r]] = np.sum(own * _COMBINE[: len(own)]) ^ _COMBINE[len(own) + 8]
    return mix(out), heads
