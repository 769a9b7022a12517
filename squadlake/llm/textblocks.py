"""Vectorised work on whole Arrow string columns inside Python workers.

Texts are handled in chunks of whole documents (a quarter of a megabyte, or one
longer document), as one byte array with offsets; words and lines are spans of it.
A span's 64-bit hash is a polynomial over scrambled bytes, taken for all spans at
once from one running sum, and mixed with the span's length.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
GRAM = np.uint64(0xD6E8FEB86659FD93)
LENGTH = np.uint64(0xA0761D6478BD642F)


def hand_back_memory() -> None:
    """Free what a worker's earlier tasks left.  Functions shipped by value and the dict
    of their globals are cycles, which hold broadcast values until they are collected."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    """A fixed pseudo-random 64-bit value per byte; A-Z get those of a-z when case is folded."""
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    if fold_case:
        values[65:91] = values[97:123]
    return values


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after folding A-Z: every code point over 0x7F counts, so bytes decide.
ALNUM_BYTES = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# [^\x20\x09-\x0D]+
INK_BYTES = ~byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_NEWLINE = ~byte_class((0x0A, 0x0A))


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of chunks of whole texts; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class SpanHasher:
    """Hashes of spans of a byte (or code point) array."""

    def __init__(self, fold_case: bool = False):
        hand_back_memory()  # one of these is made at a task's start
        self.values = byte_values(fold_case)
        self.powers = np.ones(1, dtype=np.uint64)
        self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            with np.errstate(over="ignore"):
                for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                    table = np.full(n + CHUNK_BYTES, base, dtype=np.uint64)
                    table[0] = 1
                    setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def running(self, values: np.ndarray) -> np.ndarray:
        """S with S[j] - S[i] the polynomial of values[i:j], scaled by BASE ** i."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[:len(values)], out=total[1:])
        return total

    def raw_spans(self, running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (running[ends] - running[starts]) * self.inverses[starts]

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        raw = self.raw_spans(self.running(self.values[data]), starts, ends)
        return mix(raw + (ends - starts).astype(np.uint64) * LENGTH)


def spans_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``table`` inside each text: starts, ends, and the
    index of each text's first run (one more entry than texts)."""
    inside = table[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gram_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-grams of word hashes inside each text, and the index of each
    text's first gram."""
    counts = np.diff(firsts)
    grams = np.maximum(counts - k + 1, 0)
    gram_firsts = np.concatenate([[0], np.cumsum(grams)])
    n = max(len(words) - k + 1, 0)
    total = np.zeros(n, dtype=np.uint64)
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += words[j:j + n] * weight
            weight = weight * GRAM
        total = mix(total + np.uint64(k) * LENGTH)
    at = np.repeat(firsts[:-1] - gram_firsts[:-1], grams) + np.arange(gram_firsts[-1])
    return total[at], gram_firsts


def shingle_sets(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-grams, sorted, and the index of each text's first; a
    shorter text's whole sequence is its one gram, a text without words has none."""
    hashes, gram_firsts = gram_hashes(words, firsts, k)
    counts = np.diff(firsts)
    sets = []
    for a, b, first, n in zip(gram_firsts[:-1].tolist(), gram_firsts[1:].tolist(), firsts[:-1].tolist(), counts.tolist()):
        if 0 < n < k:
            sets.append(gram_hashes(words[first:first + n], np.array([0, n]), n)[0])
            continue
        own = hashes[a:b]
        own.sort()
        sets.append(own)
    owner = np.repeat(np.arange(len(counts)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else hashes
    fresh = np.ones(len(flat), dtype=bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    return flat[fresh], np.searchsorted(owner[fresh], np.arange(len(counts) + 1))


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
