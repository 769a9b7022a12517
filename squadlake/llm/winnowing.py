"""Benchmark decontamination by winnowed fingerprints.

A fingerprint is the smallest k-gram hash of w consecutive k-grams (the last one
on ties).  Two texts that share t = w + k - 1 words share the fingerprint of that
window, so with t the window to be found nothing is missed.  Items shorter than
the window are one window of their own length: each length that occurs is a
class with its own k and w, and documents are fingerprinted once per class.

Documents are scanned once.  Fingerprints that a Bloom filter of the items' ones
lets through leave the scan with the word hashes around them; they join the
items' fingerprints, and each hit is extended word by word to the run it is in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.bloom import bloom_of, may_hold
from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import ALNUM_BYTES, SpanHasher, column_of, gram_hashes, mix, spans_of, text_chunks

WINDOW = 13
GRAM = 5


def gram_and_span(length: int, gram: int = GRAM) -> tuple[int, int]:
    """k and w whose guarantee k + w - 1 is the window's ``length``."""
    k = min(gram, length)
    return k, length - k + 1


def fingerprints(words: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one class, and the words' indexes at which they start."""
    k, w = gram_and_span(length)
    grams, gram_firsts = gram_hashes(words, firsts, k)
    counts = np.diff(gram_firsts)
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j:j + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + j
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.unique(at[owner[:n] == owner[w - 1:]])
    return mix(grams[at] ^ np.uint64(length)), at + (firsts[:-1] - gram_firsts[:-1])[owner[at]]


def contexts(words: np.ndarray, firsts: np.ndarray, at: np.ndarray, length: int) -> tuple[pa.Array, np.ndarray]:
    """The word hashes around each fingerprint that any window over it can reach,
    and how many of them stand before it."""
    text = np.searchsorted(firsts, at, "right") - 1
    k, w = gram_and_span(length)
    low = np.maximum(at - (w - 1), firsts[text])
    high = np.minimum(at + length, firsts[text + 1])
    size = high - low
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = np.repeat(low - ends[:-1], size) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[flat].view(np.int64))), at - low


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def item_lengths(items: DataFrame, window: int = WINDOW) -> list[int]:
    """The windows' lengths that occur among the items: at most ``window`` values."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(column_of(batch, "text")):
                firsts = spans_of(data, offsets, ALNUM_BYTES)[2]
                yield _batch(["length"], np.unique(np.minimum(np.diff(firsts), window)))

    found = items.select("text").mapInArrow(measure, "length long").where("length > 0").distinct()
    return sorted(r[0] for r in found.collect())


def item_fingerprints(items: DataFrame, lengths: list[int], window: int = WINDOW) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher(fold_case=True)
        for batch in batches:
            names = column_of(batch, "item_id")
            for low, high, data, offsets in text_chunks(column_of(batch, "text")):
                starts, ends, firsts = spans_of(data, offsets, ALNUM_BYTES)
                words = hasher.spans(data, starts, ends)
                own = np.minimum(np.diff(firsts), window)
                for length in lengths:
                    prints, at = fingerprints(words, firsts, length)
                    text = np.searchsorted(firsts, at, "right") - 1
                    mine = own[text] == length
                    prints, at, text = prints[mine], at[mine], text[mine]
                    around, before = contexts(words, firsts, at, length)
                    yield _batch(["fp", "length", "item_id", "item_words", "item_before"], prints.view(np.int64), np.full(len(at), length),
                                 names.slice(low, high - low).take(pa.array(text)), around, before)

    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        run, "fp long, length long, item_id string, item_words array<long>, item_before long")


SCANNED = "row long, doc_id long, n_words long, fp long, at long, doc_words array<long>, doc_before long"


def scan_documents(docs: DataFrame, lengths: list[int], filter_words: np.ndarray) -> DataFrame:
    """One row per document (fp null), and one per fingerprint that an item may have.
    ``row`` numbers the documents' rows, so repeated or missing ids stay apart."""
    shipped = docs.sparkSession.sparkContext.broadcast(filter_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = SpanHasher(fold_case=True), shipped.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            doc_ids = column_of(batch, "doc_id").cast(pa.int64())
            for low, high, data, offsets in text_chunks(column_of(batch, "text")):
                starts, ends, firsts = spans_of(data, offsets, ALNUM_BYTES)
                words = hasher.spans(data, starts, ends)
                own, n = doc_ids.slice(low, high - low), high - low
                names = ["row", "doc_id", "n_words", "fp", "at", "doc_words", "doc_before"]
                none = pa.nulls(n, pa.int64())
                yield _batch(names, row + np.arange(n), own, np.diff(firsts), none, none, pa.nulls(n, pa.list_(pa.int64())), none)
                for length in lengths:
                    prints, at = fingerprints(words, firsts, length)
                    maybe = may_hold(bits, prints)
                    prints, at = prints[maybe], at[maybe]
                    if len(at):
                        text = np.searchsorted(firsts, at, "right") - 1
                        around, before = contexts(words, firsts, at, length)
                        yield _batch(names, row + text, own.take(pa.array(text)), pa.nulls(len(at), pa.int64()), prints.view(np.int64),
                                     at - firsts[text], around, before)
                row += n

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


def extended(hits: DataFrame) -> DataFrame:
    """Each hit's run of equal words around its fingerprint, where it holds a window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, item = column_of(batch, "doc_words").to_pylist(), column_of(batch, "item_words").to_pylist()
            doc_before, item_before = column_of(batch, "doc_before").to_pylist(), column_of(batch, "item_before").to_pylist()
            left, right = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
            for i, (a, b, p, q) in enumerate(zip(doc, item, doc_before, item_before)):
                n = 0
                while n < min(p, q) and a[p - 1 - n] == b[q - 1 - n]:
                    n += 1
                left[i] = n
                n, most = 0, min(len(a) - p, len(b) - q)
                while n < most and a[p + n] == b[q + n]:
                    n += 1
                right[i] = n
            at, length = column_of(batch, "at").to_numpy(), column_of(batch, "length").to_numpy()
            whole = pa.array(left + right >= length)
            yield _batch(["row", "item_id", "low", "high"], column_of(batch, "row"), column_of(batch, "item_id"), at - left, at + right).filter(whole)

    return hits.mapInArrow(run, "row long, item_id string, low long, high long")


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, and the
    sorted array ``items`` of the items with an occurring window.

    Null and empty texts have no words; items without words have no window, items
    without an id are found but not named.  Empty tables give no hits.
    """
    lengths = item_lengths(items, window)
    known = scratch.keep(item_fingerprints(items, lengths, window), "items")
    bits = bloom_of(known, "fp", known.count())
    scanned = scratch.keep(scan_documents(docs, lengths, bits), "documents")
    found = scanned.where("fp is not null").select("row", "fp", "at", "doc_words", "doc_before").join(known, "fp")
    runs = extended(found).dropDuplicates()
    union = F.expr("aggregate(array_sort(runs), struct(0L as n, 0L as upto), (a, x) -> struct("
                   "a.n + greatest(0L, x.high - greatest(x.low, a.upto)) as n, greatest(a.upto, x.high) as upto)).n")
    hit = runs.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("runs"), F.sort_array(F.collect_set("item_id")).alias("items"))
    hit = hit.select("row", union.alias("n_hit"), "items")
    return scanned.where("fp is null").select("row", "doc_id", "n_words").join(hit, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(n_hit, n_words):
    """A twentieth of the words or more lie inside windows of items."""
    return (n_hit > 0) & (20 * n_hit >= n_words)
