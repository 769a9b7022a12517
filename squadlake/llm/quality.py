"""Quality by regularised quadratic discriminant analysis of document statistics.

Each class is a Gaussian over transformed statistics of the text.  Its covariance
is shrunk towards a scaled identity and the pooled one; Cholesky factors are
computed once, and a document's score comes from the difference of the classes'
log densities (Mahalanobis distances) and priors.

Means and covariances come from sums over all labelled documents that take part
in training: nothing but those sums, whose number is that of the statistics
squared, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.textblocks import INK_BYTES, SpanHasher, byte_class, column_of, gram_hashes, spans_of, text_chunks

_CLASSES = {
    "upper": byte_class((0x41, 0x5A)), "lower": byte_class((0x61, 0x7A)), "digit": byte_class((0x30, 0x39)),
    "space": byte_class((0x20, 0x20)), "newline": byte_class((0x0A, 0x0A)), "high": byte_class((0x80, 0xFF)),
    "stop": byte_class((0x2E, 0x2E)), "comma": byte_class((0x2C, 0x2C)), "shout": byte_class((0x21, 0x21), (0x3F, 0x3F)),
    "sign": byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "other": byte_class((0x22, 0x22), (0x27, 0x29), (0x2D, 0x2D), (0x2F, 0x2F), (0x3A, 0x3B)),
}
# Upper case among two-byte Latin letters: 0xC3 followed by one of these.
_LATIN_UPPER = byte_class((0x80, 0x9E))
STATISTICS = ("words", "word_bytes", "word_spread", "line_words", "distinct", "pairs", "again", "capitals", *_CLASSES)
_FLOOR = 1e-3  # of a share before its logarithm


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    ranked = hashes.copy()
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        ranked[a:b].sort()
    fresh = np.ones(len(ranked))
    fresh[1:] = ranked[1:] != ranked[:-1]
    starts = firsts[:-1][np.diff(firsts) > 0]
    fresh[starts] = 1
    return _per_text(fresh, firsts)


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> np.ndarray:
    """(texts, statistics): logarithms of counts and shares; an empty text has the floor of each."""
    starts, ends, firsts = spans_of(data, offsets, INK_BYTES)
    words = hasher.spans(data, starts, ends)
    n_bytes, n_words = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(firsts), 1)
    sizes = (ends - starts).astype(np.float64)
    mean = _per_text(sizes, firsts) / n_words
    spread = np.sqrt(np.maximum(_per_text(sizes ** 2, firsts) / n_words - mean ** 2, 0))
    pairs, pair_firsts = gram_hashes(words, firsts, 2)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    table = {name: _per_text(members[data], offsets) for name, members in _CLASSES.items()}
    latin = np.zeros(len(data), dtype=bool)
    latin[1:] = (data[:-1] == 0xC3) & _LATIN_UPPER[data[1:]]
    capital = _per_text(latin, offsets) + table["upper"]
    shares = [_distinct(words, firsts) / n_words, _distinct(pairs, pair_firsts) / np.maximum(np.diff(pair_firsts), 1),
              _per_text(same, firsts) / n_words, capital / np.maximum(table["upper"] + table["lower"] + table["high"], 1)]
    shares += [table[name] / n_bytes for name in _CLASSES]
    counts = [n_words, mean, spread, n_words / (table["newline"] + 1)]
    return np.column_stack([np.log1p(c) for c in counts] + [np.log(s + _FLOOR) for s in shares])


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians with their Cholesky factors; index 1 is the wanted class."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float, pool: float) -> Discriminant:
        """From each class's count, sums and sums of products.  ``pool`` mixes in the
        pooled covariance, ``shrink`` then the identity scaled to the mean variance."""
        means = sums / np.maximum(counts, 1)[:, None]
        spread = squares - counts[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = spread.sum(axis=0) / max(counts.sum() - 2, 1)
        factors, constants = [], []
        for k in (0, 1):
            own = spread[k] / max(counts[k] - 1, 1)
            mixed = (1 - pool) * own + pool * pooled
            d = len(mixed)
            mixed = (1 - shrink) * mixed + shrink * max(np.trace(mixed) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(mixed)
            factors.append(np.linalg.inv(factor))
            constants.append(np.log((counts[k] + 1) / (counts.sum() + 2)) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(factors), np.array(constants))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        own = [self.constants[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return own[1] - own[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """A sigmoid of the log odds on a logarithmic scale, on which far values stay apart."""
        z = self.log_odds(x)
        return 1 / (1 + np.exp(-np.sign(z) * np.log1p(np.abs(z))))


SHRINK, POOL = 0.02, 0.05


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            ids = column_of(batch, "doc_id").cast(pa.int64())
            for low, high, data, offsets in text_chunks(column_of(batch, "text")):
                x = statistics(data, offsets, hasher)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return column_of(batch, "stats").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(STATISTICS))


def fit(stats: DataFrame, labels: DataFrame, shrink: float = SHRINK, pool: float = POOL) -> Discriminant:
    """Train on the documents that ``labels`` (doc_id, label: 0 or 1) names; other
    labels are left out, repeated ones count repeatedly.  Without any labels of a
    class all scores are alike."""
    d = len(STATISTICS)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + len(upper[0])))
        for batch in batches:
            x, label = _matrix(batch), column_of(batch, "label").to_numpy()
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        for k in (0, 1):
            columns = [np.full(total.shape[1], k, np.int32), np.arange(total.shape[1], dtype=np.int32), total[k]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "place", "total"])

    known = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    labelled = stats.join(known, "doc_id").select("label", "stats")
    sums = labelled.mapInArrow(run, "label int, place int, total double").groupBy("label", "place").agg(F.sum("total").alias("total")).toArrow()
    table = np.zeros((2, 1 + d + len(upper[0])))
    table[sums.column("label").to_numpy(), sums.column("place").to_numpy()] = sums.column("total").to_numpy()
    squares = np.zeros((2, d, d))
    for k in (0, 1):
        squares[k][upper] = table[k, 1 + d:]
        squares[k] = np.triu(squares[k]) + np.triu(squares[k], 1).T
    return Discriminant.fit(table[:, 0], table[:, 1:1 + d], squares, shrink, pool)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) from a table of statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def kept(docs: DataFrame, model: Discriminant, threshold: float) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            scores = [model.score(statistics(data, offsets, hasher)) for _, _, data, offsets in text_chunks(column_of(batch, "text"))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)
