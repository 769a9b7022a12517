"""Token ids in patched frame-of-reference files.

A file holds whole documents' ids in blocks of 128.  A block stores its minimum,
the differences packed at a width w, and the differences that need more bits in
an exception list of (place, value).  w is the bit width at one of a few
percentiles of the block's differences: the one with the smallest block.

Layout (little endian):
  magic ``PFOR0001``, n_docs u64, n_ids u64, n_blocks u64
  doc ids i64[n_docs], their validity u8[n_docs] padded to 8, lengths u64[n_docs]
  block starts u64[n_blocks + 1]   32-bit words from the payload's start
  payload: per block  minimum u32, header u32 (width | exceptions << 8),
           packed differences u32[4 * width], exceptions (place u32, value u32) each

Packing is by lanes: value i of a block sits in lane i % 4, at bit (i // 4) * width
of that lane's words, so whole groups of blocks are packed with array shifts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"PFOR0001"
BLOCK = 128
LANES = 4
STEPS = BLOCK // LANES
PERCENTILES = (50, 75, 90, 100)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) values of at most ``width`` bits as (blocks, 4 * width) words."""
    lanes = values.reshape(-1, STEPS, LANES).astype(np.uint64)
    words = np.zeros((len(values), width + 1, LANES), dtype=np.uint64)
    for step in range(STEPS):
        word, bit = divmod(step * width, 32)
        shifted = lanes[:, step] << np.uint64(bit)
        words[:, word] |= shifted & np.uint64(0xFFFFFFFF)
        words[:, word + 1] |= shifted >> np.uint64(32)
    return words[:, :width].astype(np.uint32).reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(len(words), width, LANES).astype(np.uint64)
    words = np.concatenate([words, np.zeros_like(words[:, :1])], axis=1)
    out = np.empty((len(words), STEPS, LANES), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for step in range(STEPS):
        word, bit = divmod(step * width, 32)
        both = words[:, word] | (words[:, word + 1] << np.uint64(32))
        out[:, step] = (both >> np.uint64(bit)) & mask
    return out.reshape(len(words), BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload words and block starts.  The last block is filled up with its minimum."""
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint32), np.zeros(1, np.uint64)
    rows = np.empty(n_blocks * BLOCK, dtype=np.uint32)
    rows[:len(ids)] = ids
    if len(ids) % BLOCK:
        rows[len(ids):] = rows[(n_blocks - 1) * BLOCK:len(ids)].min()
    rows = rows.reshape(n_blocks, BLOCK)
    low = rows.min(axis=1)
    rows = rows - low[:, None]
    need = _widths(rows)
    ranked = np.sort(need, axis=1)
    best, width, extra = np.full(n_blocks, np.iinfo(np.int64).max), np.zeros(n_blocks, np.int64), np.zeros(n_blocks, np.int64)
    for percentile in PERCENTILES:
        w = ranked[:, BLOCK * percentile // 100 - 1]
        over = (need > w[:, None]).sum(axis=1)
        words = LANES * w + 2 * over
        better = words < best
        best[better], width[better], extra[better] = words[better], w[better], over[better]
    starts = np.concatenate([[0], np.cumsum(2 + best)])
    out = np.zeros(int(starts[-1]), dtype=np.uint32)
    out[starts[:-1]] = low
    out[starts[:-1] + 1] = width | (extra << 8)
    patched = need > width[:, None]
    kept = np.where(patched, 0, rows)
    for w in np.unique(width[width > 0]):
        group = np.flatnonzero(width == w)
        out[starts[group, None] + 2 + np.arange(LANES * w)] = _pack(kept[group], int(w))
    block, place = np.nonzero(patched)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    at = starts[block] + 2 + LANES * width[block] + 2 * rank
    out[at], out[at + 1] = place, rows[block, place]
    return out, starts.astype(np.uint64)


def decode_blocks(payload: np.ndarray, starts: np.ndarray, first: int, end: int) -> np.ndarray:
    """The values of blocks ``first`` to ``end``: only their words are touched."""
    at = starts[first:end].astype(np.int64)
    head = payload[at + 1].astype(np.int64)
    width, extra = head & 0xFF, head >> 8
    out = np.zeros((end - first, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        group = np.flatnonzero(width == w)
        out[group] = _unpack(payload[at[group, None] + 2 + np.arange(LANES * w)], int(w))
    block = np.repeat(np.arange(end - first), extra)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(extra) - extra, extra)
    where = at[block] + 2 + LANES * width[block] + 2 * rank
    out[block, payload[where]] = payload[where + 1]
    return (out + payload[at][:, None]).reshape(-1)


def encode_file(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
    payload, starts = encode_blocks(ids)
    yield MAGIC + np.array([len(doc_ids), len(ids), len(starts) - 1], dtype="<u8").tobytes()
    yield doc_ids.astype("<i8").tobytes()
    yield valid.astype(np.uint8).tobytes() + bytes(-len(valid) % 8)
    yield lengths.astype("<u8").tobytes()
    yield starts.astype("<u8").tobytes()
    yield payload.astype("<u4").tobytes()


@dataclass(frozen=True)
class TokenFile:
    """A file's contents without decoding; ``ids`` decodes a range through the block index."""

    doc_ids: np.ndarray
    valid: np.ndarray
    lengths: np.ndarray
    n_ids: int
    starts: np.ndarray
    payload: np.ndarray

    @classmethod
    def parse(cls, raw: bytes) -> TokenFile:
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, n_ids, n_blocks = np.frombuffer(raw, "<u8", 3, 8).tolist()
        at = 32
        doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        valid = np.frombuffer(raw, np.uint8, n_docs, at)
        at += n_docs + -n_docs % 8
        lengths = np.frombuffer(raw, "<u8", n_docs, at).astype(np.int64)
        at += 8 * n_docs
        starts = np.frombuffer(raw, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        return cls(doc_ids, valid.astype(bool), lengths, n_ids, starts, np.frombuffer(raw, "<u4", -1, at))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return decode_blocks(self.payload, self.starts, first, -(-end // BLOCK))[start - first * BLOCK:end - first * BLOCK]
