"""Vectorised text primitives over the UTF-8 buffers of Arrow batches.

A batch is cut into chunks of whole texts; one chunk is one byte array with a zero after each
text, so that no word, line or window crosses from one text into the next. Words are hashed from
prefix sums of a polynomial modulo 2^64: any substring's hash costs three operations.
Memory: about 60 bytes for each byte of a chunk, so the longest text decides. Spark cuts Arrow batches at
64 MB of its own accord (spark.sql.execution.arrow.maxBytesPerBatch).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_power = np.ones(1, U)
_inverse = np.ones(1, U)

_SPACE = b" \t\n\x0b\x0c\r"


def _word_table() -> np.ndarray:
    """Bytes of words `[^\\x20\\x09-\\x0D]+` as byte + 1; white space as 0."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[list(_SPACE)] = 0
    return t


def _folded_table() -> np.ndarray:
    """Letters (A-Z lower-cased), digits and all bytes past ASCII as byte + 1; the rest as 0."""
    t = np.arange(256, dtype=np.uint16) + 1
    for b in range(128):
        c = chr(b)
        t[b] = ord(c.lower()) + 1 if c.isalnum() else 0
    return t


SPACED, FOLDED = _word_table(), _folded_table()
PLAIN = np.arange(256, dtype=np.uint16) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        n = max(n, CHUNK + (CHUNK >> 2))
        one = np.ones(n, U)
        one[1:] = _BASE
        _power = np.cumprod(one)
        one[1:] = pow(_BASE, -1, 1 << 64)
        _inverse = np.cumprod(one)
    return _power, _inverse


class Chunk:
    """Texts joined by zeros. `start[i]` is where text i begins in `codes`; `size[i]` its bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        self.n, self.size = n, np.diff(offsets)
        self.start = offsets[:-1] - offsets[0] + np.arange(n)
        self.data = np.zeros(int(offsets[-1] - offsets[0]) + n, np.uint8)
        self.inside = np.ones(len(self.data), bool)
        self.inside[self.start + self.size] = False
        self.data[self.inside] = data[offsets[0] : offsets[-1]]

    def codes(self, table: np.ndarray) -> np.ndarray:
        out = table[self.data]
        out[~self.inside] = 0
        return out

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, "right") - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte, by text."""
        c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return c[self.start + self.size] - c[self.start]


class Hashes:
    """Hashes of any span of a code array; zeros inside a span count as gaps, not as text."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.power, self.inverse = powers(len(codes) + 1)
        self.prefix = np.zeros(len(codes) + 1, U)
        np.cumsum(codes.astype(U) * self.power[: len(codes)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of codes that are not 0."""
    edge = np.diff(np.concatenate(([0], (codes != 0).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, Chunk]]:
    """(first row, row after the last, chunk) of a string column; null counts as empty."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    if not len(column):
        return
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, Chunk(raw, offsets[i : j + 1])
        i = j


def windows(word: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words of one text, and the index of each window's first word.

    A text of fewer words, but not none, is one window.
    """
    n = len(word)
    if not n:
        return word, np.zeros(0, np.int64)
    counts = np.bincount(text)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    short = np.flatnonzero((counts > 0) & (counts < width))
    out, at = [], []
    if n >= width:
        ok = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
        h = np.zeros(len(ok), U)
        for k in range(width):
            h = h * U(0xD6E8FEB86659FD93) + word[ok + k]
        out.append(mix(h))
        at.append(ok)
    if len(short):
        h = np.zeros(len(short), U)
        for k in range(width - 1):
            more = counts[short] > k
            h[more] = h[more] * U(0xD6E8FEB86659FD93) + word[first[short[more]] + k]
        out.append(mix(h ^ U(0x5851F42D4C957F2D)))
        at.append(first[short])
    h, i = np.concatenate(out), np.concatenate(at)
    if len(short):
        order = np.argsort(i, kind="stable")
        h, i = h[order], i[order]
    return h, i


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def keep_memory() -> None:
    """Let this worker keep freed memory for its next arrays (up to 128 MB) instead of giving it back, which costs more than the work on them."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
    except (AttributeError, OSError):  # not glibc
        pass


def give_back() -> None:
    """Return freed memory to the system: after the sample has taught, the driver goes on without it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
