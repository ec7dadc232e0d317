"""Byte-level text helpers that run inside Arrow tasks (numpy only, no Spark).

Texts arrive as Arrow string arrays; the functions work on one flat UTF-8 buffer
with row offsets, so a batch costs a few vectorised passes instead of a Python loop
per word. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A 64-bit hash
stands for a word, a shingle or a byte string; equal strings have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE = 1 << 20  # bytes hashed at a time: bounds memory for very long texts
CHUNK = 4 << 20  # bytes of text handled together

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_ODD = mix(np.arange(1, 65, dtype=U64)) | U64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size + 1, b, U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _POWERS.clear()
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


class PrefixHash:
    """Hashes of any substrings of ``buf`` from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        power, self.inverse = _powers(len(buf))
        self.sum = np.zeros(len(buf) + 1, U64)
        np.cumsum(_TABLE[buf] * power[: len(buf)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (n + 1) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offs[0]), int(offs[-1])
    buf = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return buf, offs - lo


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes;
    a longer text is a run of its own."""
    buf, offs = flat(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and per row the index of its first word (n + 1).
    ``blank`` tells which bytes separate words."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    solid = ~blank[buf]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offs[:-1][offs[:-1] < len(buf)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs, "left")


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``buf``; spans ascend and do not overlap."""
    out = np.empty(len(starts), U64)
    lo = 0
    while lo < len(starts):
        a = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, a + SLICE, "right")))
        h = PrefixHash(buf[a : int(ends[hi - 1])])
        out[lo:hi] = h(starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def word_hashes(buf: np.ndarray, offs: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and per row the index of its first word (n + 1)."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, blank)
    return hash_spans(low, starts, ends), first


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """Hash of a whole sequence of fewer than 64 word hashes (one value)."""
    return mix((h * _ODD[: len(h)]).sum(dtype=U64, keepdims=True) + np.full(1, len(h), U64) * _ODD[63:])


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles. A row of fewer words has its
    whole sequence as one shingle; a row without words has none."""
    n = len(h) - k + 1
    acc = np.zeros(max(0, n), U64)
    for j in range(k if n > 0 else 0):
        acc += h[j : n + j] * _ODD[j]
    acc = mix(acc)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        else:
            out.append(sequence_hash(h[a:b]) if b > a else np.zeros(0, U64))
    return out


def text_shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Shingle set of each text of an Arrow column, in row order."""
    for _, _, buf, offs in chunks(column):
        yield from shingle_sets(*word_hashes(buf, offs), k)
