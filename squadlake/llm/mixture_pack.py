"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  A window of ``window`` sequences
visits every queue once and takes its quantum, the queue's target share of the
window; what rounding leaves over or short is the queue's deficit, which the next
window carries on.  A queue that ends leaves its share to the others in proportion.

Since tokens may be cut anywhere, the deficits after any number of windows have a
closed form: with G(s, T) the tokens that queues up to s should have of the first T,
a whole number floor(G(s, T)) of them is served, so each queue is within one token of
its target after each window and each window is full.  A task therefore finds the
place of its documents from their positions in their queues alone: tokens are
encoded once, nothing but counts is shuffled, and deficits carry over from partition
to partition exactly.  Sequences cut the windows' tokens every ``capacity``; the last
tokens form sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import column_of, text_chunks
from squadlake.llm.tokens import TOKEN_CHUNK_BYTES, worker_encoder

CAPACITY, WINDOW = 1024, 64
LEAST_SHARE = 256  # sources with under 1/256 of the tokens (or of the target) share a queue
GROUPS = 1024
ENCODED = "doc_id long, source string, part long, start_in_part long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Documents' ids (two bytes each, or four where the vocabulary needs them; the
    column's length tells which), with their place among their task's tokens of the same source."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, end_id)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        before: dict[str | None, int] = {}
        for batch in batches:
            doc_ids, sources = column_of(batch, "doc_id").cast(pa.int64()), column_of(batch, "source").cast(pa.string())
            for low, high, data, offsets in text_chunks(column_of(batch, "text"), TOKEN_CHUNK_BYTES):
                ids, bounds = encoder.encode(data, offsets)
                own, n = sources.slice(low, high - low), high - low
                starts = []
                for name, size in zip(own.to_pylist(), np.diff(bounds).tolist()):
                    starts.append(before.get(name, 0))
                    before[name] = starts[-1] + size
                raw = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((bounds * width).astype(np.int64)), raw])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(low, n), own, pa.array(np.full(n, part, dtype=np.int64)), pa.array(starts, pa.int64()), pa.array(np.diff(bounds)),
                     column.cast(pa.binary())], names=["doc_id", "source", "part", "start_in_part", "n_tokens", "ids"])

    return docs.select("doc_id", "source", "text").mapInArrow(run, ENCODED)


class Mixture:
    """What each queue has been given after any number of tokens.

    ``sizes`` are the queues' tokens, ``weights`` their targets (positive, in any
    unit).  Between the ends of queues the shares are constant.
    """

    def __init__(self, sizes: list[int], weights: list[int], window: int):
        self.sizes, self.window, self.total = sizes, window, sum(sizes)
        self.starts, self.given, self.rates = [], [], []
        given, at = [Fraction(0)] * len(sizes), Fraction(0)
        while True:
            live = [s for s, size in enumerate(sizes) if given[s] < size]
            self.starts.append(at)
            self.given.append(_running(given))
            whole = sum(weights[s] for s in live)
            rate = [Fraction(weights[s], whole) if s in live else Fraction(0) for s in range(len(sizes))]
            self.rates.append(_running(rate))
            if not live:
                break
            step = min((sizes[s] - given[s]) / rate[s] for s in live)
            given = [g + step * r for g, r in zip(given, rate)]
            at += step
        self.ends = [self.upto(s, self.total) for s in range(len(sizes) + 1)]
        self.edges = lru_cache(maxsize=4096)(self._edges)

    def upto(self, s: int, tokens: int) -> int:
        """Tokens of the first ``s`` queues among the first ``tokens``."""
        phase = bisect_right(self.starts, tokens) - 1
        return (self.given[phase][s] + (tokens - self.starts[phase]) * self.rates[phase][s]).__floor__()

    def _edges(self, w: int) -> list[int]:
        return [self.upto(s, min(w * self.window, self.total)) for s in range(len(self.sizes) + 1)]

    def served(self, s: int, w: int) -> int:
        """Tokens of queue ``s`` in the first ``w`` windows."""
        edges = self.edges(w)
        return edges[s + 1] - edges[s]

    def window_of(self, s: int, position: int) -> int:
        """The window that holds a queue's token."""
        low, high = 0, -(-self.total // self.window)
        while high - low > 1:  # served() never falls with w
            middle = (low + high) // 2
            if self.served(s, middle) <= position:
                low = middle
            else:
                high = middle
        return low

    def spans(self, s: int, position: int, length: int) -> Iterator[tuple[int, int]]:
        """(place among all tokens, length) of a run of a queue's tokens, window by window."""
        w = self.window_of(s, position)
        while length:
            here, then = self.edges(w), self.edges(w + 1)
            first, last = here[s + 1] - here[s], then[s + 1] - then[s]
            taken = min(length, last - position)
            if taken > 0:
                yield w * self.window + (then[s] - here[s]) + position - first, taken
                position, length = position + taken, length - taken
            w += 1


def _running(values: list[Fraction]) -> list[Fraction]:
    out = [Fraction(0)]
    for v in values:
        out.append(out[-1] + v)
    return out


def sequence_bounds(total: int, capacity: int) -> list[int]:
    """First tokens of the sequences after the last full one, and the end: powers of two."""
    at, left = total - total % capacity, total % capacity
    bounds = [at]
    for bit in range(left.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    return bounds


def queues(totals: DataFrame, targets: dict[str, int] | None) -> tuple[list[str], list[int], list[int], DataFrame]:
    """Names of the sources with queues of their own, the queues' tokens and weights
    (the last queue is that of all others), and ``totals`` with each row's queue.

    Weights are ``targets`` where given, the others' being their tokens scaled to
    what the given leave of the largest unit; without targets, tokens.  At most 256
    sources have a share of 1/256, so this many rows reach the driver."""
    by_source = totals.groupBy("source").agg(F.sum("n_tokens").cast("decimal(38,0)").alias("n"))
    n_all = int(by_source.agg(F.sum("n")).first()[0] or 0)
    wanted = F.col("source").isin(list(targets)) if targets else F.col("n") * LEAST_SHARE >= n_all
    chosen = [(r.source, int(r.n)) for r in by_source.where(F.col("source").isNotNull() & wanted).orderBy("source").collect()]
    rest = n_all - sum(n for _, n in chosen)
    weights = {name: targets[name] if targets else n for name, n in chosen}
    rest_weight = max(rest * sum(weights.values()) // max(n_all - rest, 1), 1) if targets else rest
    whole = sum(weights.values()) + rest_weight
    # A queue's quantum has to be a token a window at least: small ones join the last queue.
    for name, n in sorted(chosen, key=lambda c: weights[c[0]]):
        if weights[name] * LEAST_SHARE < whole or (rest and rest_weight * LEAST_SHARE < whole):
            chosen.remove((name, n))
            rest, rest_weight = rest + n, rest_weight + weights.pop(name)
    names = [name for name, _ in chosen]
    index = F.coalesce(*[F.when(F.col("source") == name, i) for i, name in enumerate(names)], F.lit(len(names)))
    sizes, shares = [n for _, n in chosen], [weights[name] for name in names]
    if rest:
        sizes, shares = sizes + [rest], shares + [rest_weight]
    return names, sizes, shares, totals.withColumn("queue", index)


def bases(totals: DataFrame) -> DataFrame:
    """Each (part, source)'s first place in its queue: sums before it, over groups of
    parts and then inside its group."""
    grouped = totals.withColumn("_g", F.pmod(F.xxhash64("part", "source"), F.lit(GROUPS)))
    before = Window.partitionBy("queue").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    shifts = grouped.groupBy("queue", "_g").agg(F.sum("n_tokens").alias("_n")).select(
        "queue", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("queue", "_g").orderBy("part", "source").rowsBetween(Window.unboundedPreceding, -1)
    return (grouped.withColumn("_at", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(shifts, ["queue", "_g"])
            .select("part", F.col("source").alias("_source"), "queue", (F.col("_at") + F.col("_shift")).alias("base")))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, scratch: Scratch, capacity: int = CAPACITY, window: int = WINDOW,
         targets: dict[str, int] | None = None) -> DataFrame:
    """Pack (doc_id, source, text) into sequences of ``capacity`` ids; one row per piece, as in PIECES.

    ``targets`` are weights by source for the windows of ``window`` sequences; without them every
    window has the proportions of the whole.  Null texts are empty: the end id alone.  A null source
    is a source of the last queue; documents of one doc_id are packed each for itself.  No rows: no rows.
    """
    ids = scratch.keep(encoded(docs, tokenizer_path, end_id), "ids")
    totals = scratch.keep(ids.groupBy("part", "source").agg(F.sum("n_tokens").alias("n_tokens")), "totals")
    _, sizes, shares, placed = queues(totals, targets)
    mixture = (sizes, shares, capacity * window)
    starts = scratch.keep(bases(placed), "bases")
    joined = ids.join(starts, (ids.part == starts.part) & ids.source.eqNullSafe(starts["_source"])).select(
        "doc_id", "queue", (F.col("base") + F.col("start_in_part")).alias("position"), "n_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = Mixture(*mixture)
        tails = sequence_bounds(mix.total, capacity)
        whole, n_full = tails[0], tails[0] // capacity
        for batch in batches:
            out: list[tuple] = []
            held = [column_of(batch, c).to_pylist() for c in ("doc_id", "queue", "position", "n_tokens")]
            for row, (doc_id, queue, position, n) in enumerate(zip(*held)):
                raw = np.frombuffer(column_of(batch, "ids")[row].as_buffer(), dtype=np.uint8)
                view = memoryview(raw.view(f"<u{len(raw) // n}").astype("<u4").tobytes())
                start = 0
                for place, length in mix.spans(queue, position, n):
                    while length:
                        if place < whole:
                            sequence, first = place // capacity, place - place % capacity
                            end = first + capacity
                        else:
                            tail = bisect_right(tails, place) - 1
                            sequence, first, end = n_full + tail, tails[tail], tails[tail + 1]
                        size = min(length, end - place)
                        out.append((doc_id, start, size, zlib.crc32(view[4 * start:4 * (start + size)]), n, sequence, place - first))
                        start, place, length = start + size, place + size, length - size
                if len(out) > 50_000:
                    yield pieces_batch(out)
                    out = []
            if out:
                yield pieces_batch(out)

    return joined.mapInArrow(run, PIECES)


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
