"""Keep-one-per-key operators.

All of them collapse a key on the map side before the shuffle, so a key that
holds a third of the table costs each map task one row for that key:

* ``row_number() = 1`` is planned as a partial and a final WindowGroupLimit
  around the exchange,
* ``groupBy().agg()`` has partial aggregation.

``attach_group`` replaces whole-partition windows (``agg() over (partition by
k)``), which would pull a hot key into one task: the aggregate is joined back
and AQE is free to broadcast it or to split the skewed side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of every key in ``order``.  Give a total order: ties are arbitrary."""
    w = Window.partitionBy(*[_column(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str | Column],
                   order: Sequence[str] = ("_ingested_at", "id")) -> DataFrame:
    """Latest ingest wins; equal ingest times are settled by the record id."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def latest_with_count(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                      count_as: str = "versions") -> DataFrame:
    """Latest row per key and how many rows the key had, in one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[_column(c).alias(f"o{i}") for i, c in enumerate(order)]))
    return (df.groupBy(*keys)
              .agg(best.alias("_best"), F.count("*").alias(count_as))
              .select(*keys, "_best.*", count_as))


def dedup_counts(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """One row: rows_in, rows_kept, duplicates_removed."""
    per_key = df.groupBy(*[_column(k) for k in keys]).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_in"),
        F.count("*").alias("rows_kept"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).cast("bigint").alias("duplicates_removed"))


def attach_group(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row; NULL keys form one group."""
    stats = (df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys])
               .agg(*[c.alias(name) for name, c in aggs.items()]))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return df.join(stats, on, "left").drop(*[f"_g_{k}" for k in keys])


def flag_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str = "is_repeat") -> DataFrame:
    """True on every row of a key except the first in ``order`` (which must be unique per key)."""
    here = F.struct(*order)
    return (attach_group(df, keys, _first=F.min(here))
            .withColumn(flag, here > F.col("_first")).drop("_first"))


def flag_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], id_col: str,
               flag: str = "is_first") -> DataFrame:
    """True on the one row per key that sorts first; ``id_col`` is unique and ends the order."""
    winner = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id")))
    return (attach_group(df, keys, _winner=winner)
            .withColumn(flag, F.col(id_col) == F.col("_winner.id")).drop("_winner"))


def last_wins(df: DataFrame, key: str, order: Sequence[str] = ("_ingested_at", "id")) -> DataFrame:
    """Crosswalk dedup: rows without a key are dropped, the most recent row per key stays."""
    present = df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return latest_per_key(present, [key], order)
