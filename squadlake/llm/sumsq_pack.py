"""Packing documents' token pieces into sequences by the sum-of-squares rule.

Bins are sequences of ``capacity`` tokens.  With N(g) the open bins that have g
tokens left, a piece goes where the sum of N(g) squared becomes smallest over all
gaps it fits; a new bin is opened only where it fits none.  Full bins do not count.

Only lengths are packed.  Pieces are dealt out at random to tasks of a few
hundred thousand, and each packs its own from the longest to the shortest.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.textblocks import column_of, text_chunks
from squadlake.llm.tokens import TOKEN_CHUNK_BYTES, worker_encoder

CAPACITY = 2048
TASK_PIECES = 250_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) as pieces of at most ``capacity`` ids, counted from 0; of a
    longer document the first piece takes the remainder.  Null and empty texts
    are the end id alone; repeated rows are pieces of their own."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, end_id)
        for batch in batches:
            doc_ids = column_of(batch, "doc_id").cast(pa.int64())
            for low, high, data, offsets in text_chunks(column_of(batch, "text"), TOKEN_CHUNK_BYTES):
                ids, bounds = encoder.encode(data, offsets)
                lengths = np.diff(bounds)
                counts = -(-lengths // capacity)
                owner = np.repeat(np.arange(len(lengths)), counts)
                piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                head = lengths - (counts - 1) * capacity
                size = np.where(piece == 0, head[owner], capacity)
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
                view = memoryview(ids.astype("<u4").tobytes())
                at = (bounds[owner] + start).tolist()
                sums = [zlib.crc32(view[4 * a:4 * (a + n)]) for a, n in zip(at, size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(low, high - low).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to ``capacity``), in the order given."""
    open_bins = np.zeros(capacity, dtype=np.int64)  # N(g)
    weight = np.full(capacity, np.inf)  # -2 N(g) where N(g) > 0: what leaving gap g changes, but for a constant
    gain = np.full(capacity, 2.0)  # 2 N(g) + 2: what gap g's next bin adds beside it; 1 for a bin that becomes full
    gain[0] = 1.0
    stacks: list[list[int]] = [[] for _ in range(capacity)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    count = 0
    for i, size in enumerate(lengths.tolist()):
        rest, gap = capacity - size, -1
        if rest:
            costs = weight[size:] + gain[:rest]
            k = int(costs.argmin())
            if costs[k] < np.inf:
                gap = size + k
        if gap < 0:
            chosen, gap = count, capacity
            count += 1
        else:
            chosen = stacks[gap].pop()
            open_bins[gap] -= 1
            weight[gap] = -2.0 * open_bins[gap] if open_bins[gap] else np.inf
            gain[gap] -= 2.0
        bins[i], offsets[i] = chosen, capacity - gap
        left = gap - size
        if left:
            stacks[left].append(chosen)
            open_bins[left] += 1
            weight[left] = -2.0 * open_bins[left]
            gain[left] += 2.0
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length and any more).

    ``n_pieces`` is their number; it sets the number of tasks.  Other columns stay
    as they are, but columns already named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    tasks = max(1, math.ceil(n_pieces / task_pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        lengths = table.column("length").to_numpy()
        order = np.argsort(-lengths, kind="stable")
        bins, offsets = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        bins[order], offsets[order] = place(lengths[order], capacity)
        base = TaskContext.get().partitionId() << 40
        table = table.drop_columns(["_order"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
        yield from table.to_batches(max_chunksize=20_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    # Rows of one doc_id, or equal ones throughout, are dealt out too: their place in their file counts.
    dealt = (pieces.withColumn("_order", F.xxhash64(*pieces.columns, F.monotonically_increasing_id())).repartition(tasks, "_order")
             .sortWithinPartitions("_order"))
    return dealt.mapInArrow(run, schema)
