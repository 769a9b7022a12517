"""As-of lookups: the state that applied on a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_day(grid: DataFrame, updates: DataFrame, keys: Sequence[str], *, day: str, update_day: str,
             order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attach ``values`` of the last update whose day is on or before the grid day.

    "Last" is by ``order`` (which should end in a unique id), not by day.
    Updates are first reduced to one per (key, day) with a partial aggregate,
    so a key with a flood of updates is a calendar's worth of rows by the time
    it reaches the running maximum.  One shuffle serves both inputs.
    """
    latest = F.max(F.struct(*order, *values)).alias("_state")
    per_day = (updates.groupBy(*keys, F.col(update_day).alias(day)).agg(latest)
                      .withColumn("_probe", F.lit(False)))
    both = grid.withColumn("_probe", F.lit(True)).unionByName(per_day, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    state = both.withColumn("_seen", F.max("_state").over(w)).where("_probe")
    return state.select(*grid.columns, *[F.col(f"_seen.{v}").alias(v) for v in values])
