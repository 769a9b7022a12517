"""Slowly changing tables on plain files: each call returns the whole new version."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squadlake.operators.numbering import number_new_keys
from squadlake.sources.slices import SliceTable


def upsert_retire(prev: DataFrame, snapshot: DataFrame, *, key: str, sk: str, compare: Sequence[str],
                  now: Column) -> DataFrame:
    """Type-1 upsert of a full snapshot with retirement.

    * a new key gets the next free ``sk`` (and keeps it for life),
    * a known key is rewritten only if a ``compare`` column or its retirement changed,
    * a key missing from the snapshot gets ``valid_to = now`` once,
    * a returning key is revived (``valid_to`` cleared).

    ``prev`` has the snapshot's columns plus ``sk``, valid_from, valid_to, updated_at.
    """
    attrs = [c for c in snapshot.columns if c != key]
    old = prev.select(F.col(key).alias("_k"), *[F.col(c).alias(f"p_{c}") for c in
                                                [sk, *attrs, "valid_from", "valid_to", "updated_at"]])
    j = old.join(snapshot, F.col("_k") == F.col(key), "full")
    had, has = F.col("_k").isNotNull(), F.col(key).isNotNull()
    changed = ~F.struct(*[F.col(f"p_{c}").alias(c) for c in compare]).eqNullSafe(F.struct(*compare))
    changed = changed | F.col("p_valid_to").isNotNull()
    take_new = has & (~had | changed)
    retire = ~has & F.col("p_valid_to").isNull()
    known = j.where(had)
    rows = known.select(
        F.col("p_" + sk).alias(sk), F.col("_k").alias(key),
        *[F.when(take_new, F.col(c)).otherwise(F.col(f"p_{c}")).alias(c) for c in attrs],
        F.col("p_valid_from").alias("valid_from"),
        F.when(take_new, F.lit(None)).when(retire, now).otherwise(F.col("p_valid_to")).cast("timestamp").alias("valid_to"),
        F.when(take_new | retire, now).otherwise(F.col("p_updated_at")).alias("updated_at"))
    fresh = snapshot.join(prev.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    top = F.coalesce(prev.agg(F.max(sk).alias("v")).scalar(), F.lit(0))
    born = number_new_keys(fresh, key, top, sk).select(
        sk, key, *attrs, now.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), now.alias("updated_at"))
    return rows.unionByName(born)


def upsert_stats(table: DataFrame, now: Column) -> DataFrame:
    """One row: total, active, retired by this run, active rows without the numeric id."""
    active = F.col("valid_to").isNull()
    return table.agg(F.count("*").alias("total"), F.count_if(active).alias("active"),
                     F.count_if(F.col("valid_to") == now).alias("retired_this_run"),
                     F.count_if(active & F.col("nfl_id").isNull()).alias("active_without_nfl_id"))


def scd2_merge(history: DataFrame, snapshot: DataFrame, *, key: str, check: Sequence[str], now: Column) -> DataFrame:
    """Type-2 history: close a version and open the next when a ``check`` column changed.

    A key absent from the snapshot keeps its open version (the source keeps
    retired rows, so a retirement arrives as a changed column).  A change in any
    other column opens nothing and leaves the open version as it was.
    ``history`` has the snapshot's columns plus valid_from and valid_to.
    """
    attrs = [c for c in snapshot.columns if c != key]
    closed = history.where("valid_to is not null")
    current = history.where("valid_to is null").select(
        F.col(key).alias("_k"), *[F.col(c).alias(f"p_{c}") for c in [*attrs, "valid_from"]])
    j = current.join(snapshot, F.col("_k") == F.col(key), "full")
    had, has = F.col("_k").isNotNull(), F.col(key).isNotNull()
    changed = ~F.struct(*[F.col(f"p_{c}").alias(c) for c in check]).eqNullSafe(F.struct(*check))
    ends = had & has & changed
    opens = has & (~had | changed)
    far = F.lit(None).cast("timestamp")
    version = lambda cols, start, end: F.struct(
        *[c.alias(n) for n, c in cols.items()], start.alias("valid_from"), end.cast("timestamp").alias("valid_to"))
    old = version({key: F.col("_k"), **{c: F.col(f"p_{c}") for c in attrs}}, F.col("p_valid_from"), F.when(ends, now))
    new = version({key: F.col(key), **{c: F.col(c) for c in attrs}}, now, far)
    versions = F.array_compact(F.array(F.when(had, old), F.when(opens, new)))
    moved = j.select(F.explode(versions).alias("v")).select("v.*")
    return closed.select(moved.columns).unionByName(moved)


def versions(snapshots: DataFrame, *, key: str, check: Sequence[str], at: str) -> DataFrame:
    """Type-2 history of any number of snapshots in one pass and one shuffle.

    ``snapshots`` has a row for each key and snapshot it is in, ``at`` being the
    snapshot's time.  A key's row opens a version where a ``check`` column differs from
    its row before, nulls being equal; the next one closes it.  A version has the other
    columns as they were when it opened.  The result has the columns of ``snapshots``
    but ``at``, and valid_from and valid_to.
    """
    order = Window.partitionBy(key).orderBy(at)
    before = F.lag(F.struct(*check)).over(order)  # null only where there is no row before
    opens = snapshots.withColumn("_before", before).where(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(F.struct(*check))).drop("_before")
    return opens.withColumn("valid_to", F.lead(at).over(order)).withColumnRenamed(at, "valid_from")


def advance(table: SliceTable, snapshots: DataFrame, run: str, after: str | None, *, key: str, check: Sequence[str], at: str) -> None:
    """Carry a version table, sliced by ``slice``, over the snapshots that came since run ``after``.

    Only the versions that run left open are read: each goes ahead of its key's snapshots
    as a row of its own.  What closes and what stays open are slices of this run, so a
    repeated run finds what it found before, and no later run touches what has closed.
    """
    held = table.read().where(F.col("slice") == f"open after {after}").withColumnRenamed("valid_from", at).select(*snapshots.columns)
    moved = versions(held.unionByName(snapshots), key=key, check=check, at=at)
    table.replace(moved.where("valid_to is not null"), slice=f"closed by {run}")
    table.replace(moved.where("valid_to is null"), slice=f"open after {run}")


def version_history(table: SliceTable, last: str) -> DataFrame:
    """All versions as of the run ``last``, the latest one."""
    return table.read().where(F.col("slice").startswith("closed by ") | (F.col("slice") == f"open after {last}")).drop("slice")
