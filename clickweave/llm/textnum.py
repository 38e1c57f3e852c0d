"""Numpy views of texts inside tasks: byte slices of Arrow columns, word hashes and character n-gram hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_M = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_C1, _C2, _C3 = _M(0xBF58476D1CE4E5B9), _M(0x94D049BB133111EB), _M(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit numbers over all others."""
    x = (x ^ (x >> _M(30))) * _C1
    x = (x ^ (x >> _M(27))) * _C2
    return x ^ (x >> _M(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], done, step = 1, 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _M(step)
        done, step = done + more, (step * step) & ((1 << 64) - 1)
    return out


class _Tables:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _C3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Kinds of bytes: 0 white space, 1 letters, digits, underscore and all of non-ASCII, 2 other signs.
WHITE = np.ones(256, np.uint8)
WHITE[[0x20, *range(0x09, 0x0E)]] = 0
SIGNS = WHITE.copy()
SIGNS[[b for b in range(0x21, 0x7F) if not (chr(b).isalnum() or b == ord("_"))]] = 2


def give_back() -> None:
    """Returns a worker's unused memory to the system: workers stay for later tasks, and the C library keeps what numpy has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that what a task makes of a batch stays small; memory is given back at the end."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    give_back()


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of at most max_bytes of text (or a single longer text).

    Yields first row, row after the last, the bytes, and the offsets of the rows in them. Null texts are empty.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, n + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WHITE, lower: bool = True, piece: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, in order, and the offsets of each row's words. A word is a run of bytes of one kind that isn't 0.

    Longer input is worked off in pieces that end between words, so that memory grows with the words and not with eight bytes for every byte.
    """
    if len(data) > 2 * piece:
        kind = kinds[data]
        hashes, starts, at = [], [], 0
        while at < len(data):
            to = min(len(data), at + piece)
            while to < len(data):  # up to the next white space
                white = np.flatnonzero(kind[to : to + piece] == 0)
                if len(white):
                    to += int(white[0])
                    break
                to = min(len(data), to + piece)
            inner = offsets[(offsets > at) & (offsets < to)] - at
            h, s = _word_hashes(data[at:to], np.concatenate([[0], inner]), kinds, lower)
            hashes.append(h)
            starts.append(s + at)
            at = to
        h, s = np.concatenate(hashes), np.concatenate(starts)
    else:
        h, s = _word_hashes(data, offsets[:-1], kinds, lower)
    return h, np.searchsorted(s, offsets)


def _word_hashes(data: np.ndarray, row_starts: np.ndarray, kinds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kind = kinds[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    change[row_starts[row_starts < n]] = True
    edges = np.flatnonzero(change)
    words = kind[edges[:-1]] > 0
    starts, ends = edges[:-1][words], edges[1:][words]
    up, down = _Tables.get(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[_LOWER[data] if lower else data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of `size` words; fewer words count as one run, no word gives none."""
    if not len(words):
        return words
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _C2 + words[k : len(words) - size + 1 + k] * _M((2 * k + 3) * 0x9E3779B97F4A7C15 & ((1 << 64) - 1) | 1)
    return mix(out)


def char_ngrams(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all runs of the given numbers of characters, size after size."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for size in sizes:
        n = len(chars) - size + 1
        if n > 0:
            h = np.full(n, size, np.uint64)
            for k in range(size):
                h *= _C1
                h += chars[k : k + n]
            h *= _C2
            h ^= h >> _M(29)
            h *= _C3
            out.append((h >> _M(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)
