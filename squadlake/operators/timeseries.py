"""Dense entity-by-day grids and the windows that run on them.

Facts are always aggregated to one row per (entity, day) before a window by
entity, so a window partition is bounded by the calendar, not by how many raw
rows an entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scalar(df: DataFrame, column: Column) -> Column:
    """A one-row aggregate used as a scalar subquery."""
    return df.agg(column.alias("v")).scalar()


def explode_days(df: DataFrame, start: str, end: str, day: str = "date_day") -> DataFrame:
    """One row per day from ``start`` to ``end``, both included; none when end < start."""
    days = F.when(F.col(end) >= F.col(start),
                  F.sequence(F.col(start), F.col(end), F.expr("interval 1 day")))
    return df.withColumn(day, F.explode(days))


def day_grid(entities: DataFrame, start: Column, end: Column, day: str = "date_day") -> DataFrame:
    """Every entity on every day of the range, expanded row by row (no cross join)."""
    bounded = entities.withColumns({"_from": start, "_to": end})
    return explode_days(bounded, "_from", "_to", day).drop("_from", "_to")


def trailing(keys: Sequence[str], day: str, days: int):
    """The last ``days`` rows of a dense grid, today included."""
    return Window.partitionBy(*keys).orderBy(day).rowsBetween(-(days - 1), 0)


def ewma(df: DataFrame, keys: Sequence[str], day: str, value: str, look_back: int, means: dict[str, float]) -> DataFrame:
    """Add normalised exponentially weighted means of the last ``look_back`` days, of a
    decay for each column of ``means``, to a grid of one row per key and day without gaps.

    The newest day has weight 1 and each step back (1 - decay).  Days fall into slices of
    ``look_back``, so a frame is the head of its own slice and a tail of the one before:
    the head is a running sum in order of days, the tail one in reverse order, both
    scaled by the place in the slice.  Only sums of scaled values of equal sign meet,
    nothing is subtracted, and a row's work is the same for any look-back.
    (1 - decay) ** -look_back must be a double: at a decay of 0.25 some 2,400 days.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    days = Window.partitionBy(*keys).orderBy(day)  # first, so that slices find the rows dealt by key
    df = df.withColumn("_days", F.least(F.row_number().over(days), F.lit(look_back)).cast("double"))
    df = df.withColumns({"_slice": F.floor(number / look_back), "_place": F.pmod(number, F.lit(look_back)).cast("double")})
    within = Window.partitionBy(*keys, "_slice")
    running = (Window.unboundedPreceding, Window.currentRow)
    head, tail = within.orderBy(day).rowsBetween(*running), within.orderBy(F.desc(day)).rowsBetween(*running)
    power = lambda decay, x: F.pow(F.lit(1.0 - decay), x)
    for name, decay in means.items():
        df = df.withColumns({
            f"_head_{name}": F.sum(F.col(value) * power(decay, -F.col("_place"))).over(head) * power(decay, F.col("_place")),
            f"_tail_{name}": F.sum(F.col(value) * power(decay, look_back - 1 - F.col("_place"))).over(tail)})
    kept = F.struct("_slice", *[f"_tail_{name}" for name in means])
    df = df.withColumn("_oldest", F.coalesce(F.lag(kept, look_back - 1).over(days), F.first(kept).over(days.rowsBetween(*running))))
    for name, decay in means.items():
        older = F.when(F.col("_oldest._slice") < F.col("_slice"), F.col(f"_oldest._tail_{name}") * power(decay, F.col("_place") + 1))
        weight = (F.lit(1.0) - power(decay, F.col("_days"))) / F.lit(decay)
        df = df.withColumn(name, F.try_divide(F.col(f"_head_{name}") + F.coalesce(older, F.lit(0.0)), weight))
    return df.drop("_slice", "_place", "_oldest", "_days", *[f"_{part}_{name}" for part in ("head", "tail") for name in means])


def own_mean(df: DataFrame, keys: Sequence[str], day: str, value: str, *, first: int = 28, last: int = 1,
             mean_as: str, count_as: str) -> DataFrame:
    """Mean and row count over the days ``first``..``last`` before each row (one row per key and day)."""
    dayno = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy(dayno).rangeBetween(-first, -last)
    return df.withColumns({mean_as: F.avg(value).over(w), count_as: F.count("*").over(w)})


def carry_forward(df: DataFrame, keys: Sequence[str], day: str, payload: Column) -> Column:
    """Latest non-null ``payload`` on or before each day of a grid."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(payload, ignorenulls=True).over(w)
