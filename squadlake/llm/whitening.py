"""Whitening of embeddings by a weighted multiplicity covariance.

Equal vectors are grouped once; a group enters the fit with its number of rows or
with one as its weight.  Sums are exact integers; the covariance is a sum of
per-batch products of centred vectors, W'D D for weights W.  Each distinct vector
is whitened once, and its rows fetch the result by joining on the vector.

Only sums of d and d * d numbers reach the driver.  A vector that many rows share
is one row per task before the shuffle; the join back salts vectors that hold over
a thousandth of all rows, of which there can be no more than a thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import column_of

OFFSET = 1_000_000
LIMIT = 2.0 ** 52  # |x| from which doubles no longer hold each integer
HOT_SHARE, SALTS = 1000, 64
LEAST_VARIANCE = 1e-12  # of the trace: below this a direction has no variance but rounding


def quantised(df: DataFrame, vector: str, scale: int = 64) -> DataFrame:
    """``df`` with x, floor(scale * c) + 1000000 of each entry c, in place of ``vector``.

    Rows whose vector is null or holds a null or non-finite entry are dropped;
    empty vectors stay.  Entries beyond 2^52 count as 2^52.
    """
    def whole(c: Column) -> Column:
        return (F.floor(F.least(F.greatest(F.lit(float(scale)) * c.cast("double"), F.lit(-LIMIT)), F.lit(LIMIT))) + OFFSET).cast("long")

    broken = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (vector, "x")]
    return df.where(F.col(vector).isNotNull() & ~broken).select(*rest, F.transform(vector, whole).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a list column, for each length in it but 0."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        yield d, rows, values[offsets[rows][:, None] + np.arange(d)]


def sums(groups: DataFrame, column: str) -> dict[int, tuple[int, list]]:
    """Weight and weighted sums of each dimension, by length; exact for long columns."""
    entry = groups.select(F.size(column).alias("d"), F.posexplode(column).alias("k", "v"), "weight")
    exact = dict(groups.dtypes)[column] == "array<bigint>"
    value = F.col("v").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,0)") if exact else F.col("v") * F.col("weight")
    found: dict[int, tuple[int, list]] = {}
    for r in entry.groupBy("d", "k").agg(F.sum(value).alias("s"), F.sum("weight").alias("n")).orderBy("d", "k").collect():
        found.setdefault(r.d, (r.n, []))[1].append(int(r.s) if exact else r.s)
    return found


def covariances(groups: DataFrame, column: str, centre: dict[int, tuple[np.ndarray, np.ndarray]], weights: dict[int, int]) -> dict[int, np.ndarray]:
    """Weighted covariance of ``column`` by length.  ``centre`` holds (base, mean of
    what is left): entries minus both are multiplied, one product per batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            weight = column_of(batch, "weight").to_numpy()
            for d, rows, matrix in by_length(column_of(batch, column)):
                base, mean = centre[d]
                left = (matrix - base).astype(np.float64) - mean
                total[d] = total.get(d, 0.0) + (left * weight[rows, None]).T @ left
        for d, gram in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, dtype=np.int32)), pa.array(np.arange(d * d)), pa.array(gram.ravel())], names=["d", "cell", "v"])

    cells = groups.select(column, "weight").mapInArrow(run, "d int, cell long, v double").groupBy("d", "cell").agg(F.sum("v").alias("v")).toArrow()
    lengths, places, values = (cells.column(c).to_numpy() for c in ("d", "cell", "v"))
    found = {}
    for d in weights:
        gram = np.zeros(d * d)
        gram[places[lengths == d]] = values[lengths == d]
        found[d] = gram.reshape(d, d) / weights[d]
    return found


class Axes:
    """The principal axes of vectors of one length."""

    def __init__(self, weight: int, totals: list[int], covariance: np.ndarray, components: int):
        self.weight, self.totals, self.mean = weight, totals, mean_of(weight, totals)
        trace = float(np.trace(covariance))
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        kept = order[values[order] > max(trace, 0.0) * LEAST_VARIANCE]
        self.values, self.vectors = values[kept], vectors[:, kept]
        self.explained = self.values / trace if len(kept) else np.zeros(0)

    def whitened(self, matrix: np.ndarray) -> np.ndarray:
        base, mean = self.mean
        return (((matrix - base).astype(np.float64) - mean) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, matrix: np.ndarray) -> list:
        """Sum over dimensions of (n * x - S)^2, exactly."""
        n, base = self.weight, self.mean[0]
        left = matrix - base
        shift = [s - n * int(b) for s, b in zip(self.totals, base)]
        bound = n * int(np.abs(left).max(initial=0)) + max(map(abs, shift))
        if bound * bound * matrix.shape[1] < 1 << 62:
            return ((n * left - np.array(shift, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        return [sum((n * int(v) - s) ** 2 for v, s in zip(row, shift)) for row in left.tolist()]


def mean_of(weight: int, totals: list) -> tuple[np.ndarray, np.ndarray]:
    """The mean in two parts: whole numbers, and what is left in double precision."""
    if not all(isinstance(s, int) for s in totals):
        return np.zeros(len(totals)), np.array(totals) / weight
    base = [s // weight for s in totals]
    return np.array(base, dtype=np.int64), np.array([(s - b * weight) / weight for s, b in zip(totals, base)])


def whiten_groups(groups: DataFrame, axes: dict[int, Axes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, matrix in by_length(column_of(batch, "x")):
                of = axes[d]
                white = of.whitened(matrix)
                k = white.shape[1]
                deviation = pa.array([Decimal(v) for v in of.deviations(matrix)], pa.decimal128(38, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * k, pa.int32()), pa.array(white.ravel()))
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [column_of(taken, "x"), column_of(taken, "copies"), column_of(taken, "weight"), deviation, lists], names=["x", "copies", "weight", "deviation", "whitened"])

    return groups.mapInArrow(run, "x array<bigint>, copies bigint, weight bigint, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, scratch: Scratch, components: int = 16, by_copies: bool = False) -> DataFrame:
    """``vectors`` (x array<long> and any more columns) with the results of its row:
    n, deviation decimal(38,0), whitened and explained (arrays over components) and identity_error.

    The fit list is each distinct vector once, or as often as rows hold it
    (``by_copies``).  Vectors of different lengths are fitted apart.  Directions
    without variance are no components, so equal vectors throughout give empty
    arrays; so do empty vectors, which have no entries (n null).  Repeated rows
    stay.  Columns of ``vectors`` named as a result are replaced.
    """
    results = ("n", "deviation", "whitened", "explained", "identity_error")
    rows = vectors.drop(*results)
    grouped = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    groups = scratch.keep(grouped.withColumn("weight", F.col("copies") if by_copies else F.lit(1).cast("long")), "groups")
    totals = sums(groups, "x")
    weights = {d: n for d, (n, _) in totals.items()}
    spread = covariances(groups, "x", {d: mean_of(n, s) for d, (n, s) in totals.items()}, weights)
    axes = {d: Axes(n, s, spread[d], components) for d, (n, s) in totals.items()}
    done = scratch.keep(whiten_groups(groups, axes), "whitened")
    errors = identity_errors(done, axes)
    found = [(d, a.weight, a.explained.tolist(), errors.get(d, 0.0)) for d, a in axes.items()]
    facts = rows.sparkSession.createDataFrame(found, "_d int, n long, explained array<double>, identity_error double")
    n_rows = groups.agg(F.sum("copies")).first()[0] or 0
    hot = [r[0] for r in done.where(F.col("copies") * HOT_SHARE > n_rows).select(F.xxhash64("x")).distinct().collect()]
    salted = F.xxhash64("x").isin(hot) if hot else F.lit(False)
    salt = F.when(salted, F.monotonically_increasing_id() % SALTS).otherwise(0).cast("int")
    copies = F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("_salt")
    joined = rows.withColumn("_salt", salt).join(done.select("x", "deviation", "whitened", copies), ["x", "_salt"], "left").drop("_salt")
    return (joined.withColumn("_d", F.size("x")).join(facts, "_d", "left").drop("_d")
            .withColumn("whitened", F.coalesce("whitened", F.array().cast("array<double>")))
            .withColumn("explained", F.coalesce("explained", F.array().cast("array<double>"))))


def identity_errors(done: DataFrame, axes: dict[int, Axes]) -> dict[int, float]:
    """Largest absolute entry of whitened's covariance minus the identity, by length of x.

    Lengths are told apart by x, since several may have equal numbers of components."""
    found = {}
    for d, of in axes.items():
        k = len(of.values)
        if not k:
            continue
        white = done.where(F.size("x") == d).select("whitened", "weight")
        n, s = sums(white, "whitened")[k]
        spread = covariances(white, "whitened", {k: mean_of(n, s)}, {k: n})[k]
        found[d] = float(np.abs(spread - np.eye(k)).max())
    return found


def by_component(whitened: DataFrame, *keys: str) -> DataFrame:
    """A row per row and component, numbered from 1."""
    return (whitened.select(*keys, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("_k", "_w"))
            .select(*keys, (F.col("_k") + 1).cast("int").alias("component"), "n", "deviation", F.col("_w").alias("whitened"),
                    F.get("explained", F.col("_k")).alias("explained"), "identity_error"))
