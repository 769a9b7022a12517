"""Sliding time windows that do not depend on one key fitting in one task.

``agg(x) over (partition by k order by ts range between 27 days preceding and
current row)`` sends all of a key's history to one task and re-reads the frame
for every row.  ``sliding_stats`` gives the same numbers from three pieces
that combine exactly for sum, count, min and max:

* the leading edge: rows of the newest slice up to the row's offset,
* the whole slices in between, from a table aggregated per (key, slice),
* the trailing edge: rows of the oldest slice from the row's offset on.

Both edges are running aggregates over (key, slice), so the unit of work is
one key's slice and each row is read a fixed number of times.  Sums are only
ever added, never subtracted, so no precision is lost to cancellation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _seed(stat: str, value: Column) -> Column:
    return value.isNotNull().cast("bigint") if stat == "count" else value


def _merge(stat: str, parts: Sequence[Column]) -> Column:
    if stat == "count":
        return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
    if stat == "sum":
        total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
        return F.when(F.coalesce(*parts).isNotNull(), total)
    return F.greatest(*parts) if stat == "max" else F.least(*parts)


def sliding_stats(df: DataFrame, keys: Sequence[str], ts: str, *,
                  frames: Mapping[str, tuple[int, int]],
                  stats: Mapping[str, tuple[str, str]],
                  slice_seconds: int = 86_400) -> DataFrame:
    """Add ``<frame>_<stat>`` columns for trailing time frames.

    ``frames``  name -> (from, to): seconds before the row, both inclusive,
                multiples of ``slice_seconds``; ``to`` may be 0 (the row itself,
                with every row of the same instant).
    ``stats``   name -> (column, "sum" | "count" | "min" | "max").

    A shorter slice splits a hot key further; the answer does not change.
    """
    span = slice_seconds * 1_000_000
    for name, (far, near) in frames.items():
        if far % slice_seconds or near % slice_seconds or far <= near:
            raise ValueError(f"frame {name}: bounds must be multiples of the slice, far > near")
    edges = {name: (far // slice_seconds, near // slice_seconds) for name, (far, near) in frames.items()}

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_us", micros).withColumn("_slice", F.floor(F.col("_us") / F.lit(span)).cast("bigint"))
    rows = rows.withColumn("_off", F.col("_us") - F.col("_slice") * F.lit(span))
    seeds = {f"_v_{n}": _seed(stat, F.col(c)) for n, (c, stat) in stats.items()}
    rows = rows.withColumns(seeds)

    # Whole slices strictly inside the frame, one row per (key, slice).
    per_slice = rows.groupBy(*keys, "_slice").agg(
        *[_COMBINE[stat](f"_v_{n}").alias(f"_s_{n}") for n, (_, stat) in stats.items()])
    inner = [F.col(k).alias(f"_k_{k}") for k in keys] + [F.col("_slice").alias("_k_slice")]
    for name, (far, near) in edges.items():
        w = Window.partitionBy(*keys).orderBy("_slice").rangeBetween(-(far - 1), -(near + 1))
        inner += [(_COMBINE[stat](f"_s_{n}").over(w) if far - 1 >= near + 1 else F.lit(None))
                  .alias(f"_m_{name}_{n}") for n, (_, stat) in stats.items()]
    between = per_slice.select(*inner)

    # Each row once as itself and once per edge it serves, narrow copies only.
    probes = rows.withColumn("_lag", F.lit(0).cast("bigint"))
    lags = sorted({lag for far_near in edges.values() for lag in far_near} - {0})
    edge_rows = (rows.select(*keys, "_slice", "_off", *seeds)
                     .withColumn("_lag", F.explode(F.array(*[F.lit(x).cast("bigint") for x in lags])))
                     .withColumn("_slice", F.col("_slice") + F.col("_lag")))
    both = probes.unionByName(edge_rows, allowMissingColumns=True)

    up = Window.partitionBy(*keys, "_slice").orderBy("_off").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys, "_slice").orderBy(F.col("_off").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    running = {}
    for name, (far, near) in edges.items():
        for n, (_, stat) in stats.items():
            at = lambda lag: F.when(F.col("_lag") == lag, F.col(f"_v_{n}"))
            running[f"_h_{name}_{n}"] = _COMBINE[stat](at(near)).over(up)
            running[f"_t_{name}_{n}"] = _COMBINE[stat](at(far)).over(down)
    edged = both.withColumns(running).where("_lag = 0")

    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_slice") == F.col("_k_slice")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = edged.join(between, cond, "left")
    result = {f"{name}_{n}": _merge(stat, [F.col(f"_t_{name}_{n}"), F.col(f"_m_{name}_{n}"), F.col(f"_h_{name}_{n}")])
              for name in edges for n, (_, stat) in stats.items()}
    return joined.select(*df.columns, *[c.alias(k) for k, c in result.items()])
