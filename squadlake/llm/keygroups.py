"""Keys that several things share, found in one pass over sorted rows, or over blocks of
keys: (bucket, keys, names, flags), the last three as arrays of one length in binary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKET_BITS = 12  # a bucket's keys are sorted in one worker: some 5 MB for 2 billion keys in all
BLOCK_KEYS = 1 << 20  # keys that a task gathers before it deals them into blocks
OUT_ROWS = 1 << 16
BLOCK_SCHEMA = "bucket int, keys binary, names binary, flags binary"


class KeyBlocks:
    """Gathers keys with their names and flags in a task and deals them into blocks.  Of a
    key's equal names that follow each other one is kept, so copies weigh little."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, names: np.ndarray, flag: int) -> None:
        self.parts.append((keys.view(np.uint64), names.view(np.int64), np.full(len(keys), flag, dtype=np.uint8)))
        self.size += len(keys)

    def blocks(self, least: int = 1) -> Iterator[dict[str, pa.Array]]:
        """The columns of the blocks, where at least so many keys have been gathered."""
        if self.size < least:
            return
        key, name, flag = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(key, kind="stable")
        key, name, flag = key[order], name[order], flag[order]
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, flag = key[fresh], name[fresh], flag[fresh]
        bucket = (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        edges = np.append(first, len(key))
        yield {"bucket": pa.array(bucket[first])} | {n: _binary(c, edges) for n, c in (("keys", key), ("names", name), ("flags", flag))}


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _values(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of blocks, and where each block begins (one more than blocks)."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, dtype=dtype, count=(offsets[-1] - offsets[0]) // size, offset=offsets[0]), (offsets - offsets[0]) // size


def _shared(key: np.ndarray, name: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.append(sorted_key[1:] == sorted_key[:-1], False)
    order = order[same | np.append(False, same[:-1])]
    key, name, flag = key[order], name[order], flag[order]
    order = np.lexsort((name, key))
    key, name, flag = key[order], name[order], flag[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, flag = key[fresh], name[fresh], flag[fresh]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
    size = np.diff(np.append(first, len(key)))
    many = np.repeat(size, size)
    return tuple(c[many > 1] for c in (key, name, flag.astype(np.int32), many.astype(np.int64)))


def shared_in_blocks(blocks: DataFrame) -> DataFrame:
    """(key, name, flag, n) where several names have the key, n in all; a name's flag under a
    key is any of those it came with.  A worker holds one bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out, rows = None, [], [], 0

        def batch_of(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["key", "name", "flag", "n"])

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            columns = [_values(batch.column(i), t) for i, t in ((1, np.int64), (2, np.int64), (3, np.uint8))]
            edges = np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[:len(buckets)]), len(buckets)).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                if held and buckets[a] != last:
                    out.append(_shared(*(np.concatenate(c) for c in zip(*held))))
                    held, rows = [], rows + len(out[-1][0])
                    if rows >= OUT_ROWS:
                        yield batch_of(out)
                        out, rows = [], 0
                last = buckets[a]
                held.append(tuple(values[at[a]:at[b]].copy() for values, at in columns))
        if held:
            out.append(_shared(*(np.concatenate(c) for c in zip(*held))))
        if out:
            yield batch_of(out)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, name long, flag int, n long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, name, leader) where several names have the key; the leader is the least.
    Rows stream by in order, so a key of any number of names takes no memory."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, bool] | None = None  # key, name, leader, passed on
        for batch in batches:
            key, name = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last:
                key, name = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], name])
            if not len(key):
                continue
            new_key = np.ones(len(key), dtype=bool)
            new_key[1:] = key[1:] != key[:-1]
            fresh = new_key.copy()
            fresh[1:] |= name[1:] != name[:-1]
            key, name, new_key = key[fresh], name[fresh], new_key[fresh]
            first = np.flatnonzero(new_key)
            size = np.diff(np.append(first, len(key)))
            leader = np.repeat(name[first], size)
            if last:
                leader[:size[0]] = last[2]
            many = np.repeat(size > 1, size)
            if last and last[3]:
                many[:size[0]] = True
            done = last is not None and last[3]
            last = (int(key[-1]), int(name[-1]), int(leader[-1]), bool(many[-1]))
            if done:
                many[0] = False
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (key, name, leader)], names=["key", "name", "leader"])

    return keys.repartition("key").sortWithinPartitions("key", "name").mapInArrow(run, "key long, name long, leader long")
