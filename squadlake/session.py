"""Session defaults shared by jobs, tests and the driver entry points."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime SQL settings every plan relies on.  AQE re-plans joins from measured
# sizes: a side is broadcast only after Spark has seen that it is under the
# threshold, and a skewed shuffle partition is split even when the split costs
# an extra exchange.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Paths written by ``materialise``: those of the run under way, or else of the driver's queries.
_WRITTEN: ContextVar[list[str]] = ContextVar("written", default=[])


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "squadlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def work_folder(spark: SparkSession) -> str:
    """Where a query may keep a table: the checkpoint folder, else the warehouse."""
    return f"{(checkpoint_dir(spark) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/squadlake/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame that several consumers read in full, and read it back.

    The table goes to the shared checkpoint folder, so it cuts the lineage,
    survives the loss of executors and, being Parquet, keeps column pruning and
    filter pushdown for every consumer.  Where no folder is configured the
    frame stays lazy, which gives the same rows.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/squadlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """``materialise``, with aggregates over all rows taken by the pass that writes them.

    They are observed in the tasks that write, of which each partition counts once
    however often a task is repeated.  A frame that stays lazy is aggregated for them.
    """
    aggregates = [c.alias(name) for name, c in counts.items()]
    if not checkpoint_dir(df.sparkSession):
        return df, df.agg(*aggregates).first().asDict()
    seen = Observation()
    stored = materialise(df.observe(seen, *aggregates))
    return stored, seen.get


def release(spark: SparkSession) -> None:
    """Delete the tables written so far by queries (or by the run under way), once
    nothing lazy reads them any more."""
    written = _WRITTEN.get()
    while written:
        path = spark._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def intermediates(spark: SparkSession):
    """A run whose intermediate tables are its own: they are deleted at its end, and
    no other run's are."""
    token = _WRITTEN.set([])
    try:
        yield
    finally:
        release(spark)
        _WRITTEN.reset(token)


def bench_cpus(default: int = 8) -> int:
    return int(os.environ.get("BENCH_CPUS", default))
