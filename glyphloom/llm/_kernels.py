"""Byte-level text kernels shared by the operators: words, hashes, n-grams.

Everything works on whole Arrow batches: the UTF-8 buffer of a string column is
viewed as one ``uint8`` array, so no text is decoded and no Python object is
made for a word.  Chunks bound the temporary arrays (about 25 bytes for each
byte of text in the chunk) whatever the batch holds; a single text is never cut,
so a text of 100 MB needs some 3 GB for a moment, and one worker's memory must
be chosen by the longest text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_MASK = (1 << 64) - 1
# Words up to so many bytes are hashed together, by blocks of eight bytes; longer ones each by xxh3.
LONG = 64
_BLOCK_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
# Keys of the two word hashes: a seed, and one for each block of a word.
_KEYS = np.random.default_rng(20260101).integers(0, 1 << 64, (2, 1 + LONG // 8), dtype=np.uint64)
# Odd multipliers, one for each place in an n-gram.
_PLACES = np.random.default_rng(20260102).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts.

    ``start``/``end`` are byte offsets into ``data``; ``doc`` is the index of the
    text; ``first`` has, for each text, the index of its first word, and one more
    entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        n, docs = len(data), len(offsets) - 1
        if n == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.first = np.zeros(docs + 1, dtype=np.int64)
            self.doc = np.zeros(0, dtype=np.int64)
            return
        space = _SPACE[data]
        before = np.empty(n, dtype=bool)
        before[0] = True
        before[1:] = space[:-1]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before[edge] = True
        after = np.empty(n, dtype=bool)
        after[-1] = True
        after[:-1] = space[1:]
        after[edge - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``which`` picks one of two independent ones.

        Each block of eight bytes is keyed by its place and mixed into what came
        before, so no pattern of letters cancels out as it does in a polynomial
        modulo a power of two.
        """
        key = _KEYS[which]
        size = self.end - self.start
        with np.errstate(over="ignore"):
            out = mix(size.astype(np.uint64) + key[0])
            if not len(size):
                return out
            padded = np.zeros(len(self.data) + 8, dtype=np.uint8)
            padded[: len(self.data)] = self.data
            blocks = np.ndarray(len(self.data) + 1, dtype="<u8", buffer=padded, strides=(1,))
            at = None
            for k in range(LONG // 8):
                start, left = (self.start, size) if at is None else (self.start[at] + 8 * k, size[at] - 8 * k)
                x = blocks[start] & _BLOCK_MASKS[np.minimum(left, 8)]
                if at is None:
                    out = mix((out ^ mix(x + key[1])) * np.uint64(0x9FB21C651E98DF25))
                    at = np.flatnonzero((size > 8) & (size <= LONG))
                else:
                    out[at] = mix((out[at] ^ mix(x + key[1 + k])) * np.uint64(0x9FB21C651E98DF25))
                    at = at[left > 8]
                if not len(at):
                    break
            for i in np.flatnonzero(size > LONG).tolist():
                out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), int(key[0]))
        return out

    def strings(self, index: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[index].tolist(), self.end[index].tolist(), strict=True)]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each word on; the last n-1 entries are missing."""
    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = h[:count] * _PLACES[0]
        for i in range(1, n):
            out += h[i : i + count] * _PLACES[i]
        return mix(out)


def grams_at(h: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The same hash of the n words from each of the places ``at`` on."""
    if 3 * len(at) > len(h):
        return grams(h, n)[at]
    with np.errstate(over="ignore"):
        out = h[at] * _PLACES[0]
        for i in range(1, n):
            out += h[at + i] * _PLACES[i]
        return mix(out)


def as_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in pieces of about ``most`` bytes, whole texts each."""
    data, offsets = as_text(column)
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, rows)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@functools.lru_cache(maxsize=1)
def _trim() -> Callable | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives the memory it freed back to the machine at its end: workers outlive their tasks."""

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := _trim():
            trim(0)

    return tidied


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list column from concatenated values and each list's size."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
