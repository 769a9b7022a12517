"""Registered queries: a Spark callable and, where SQL can say it, an oracle for the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squadlake.session import materialise, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


class Tables:
    """The given tables; naive timestamps are read as UTC instants."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.frames:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
            self.frames[name] = df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df
        return self.frames[name]


def shared(fn):
    """Build a derived frame once per query: consumers share one plan, so equal
    exchanges are recognised and executed once."""
    key = f"{fn.__module__}.{fn.__name__}"

    @wraps(fn)
    def frame(t: Tables):
        if key not in t.frames:
            t.frames[key] = fn(t)
        return t.frames[key]

    return frame


def shared_table(fn):
    """Like ``shared``, and written once to the cluster's checkpoint folder when it
    names one: for frames that several branches of a query read in full."""
    @wraps(fn)
    def frame(t: Tables):
        return materialise(fn(t))

    return shared(frame)


def text(c: str | Column) -> Column:
    """Dates and instants are compared as text, so both engines print the same."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("string")


def stamp(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rnd(c: str | Column, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def shaped(df: DataFrame, *, dates: tuple[str, ...] = (), stamps: tuple[str, ...] = (), floats: tuple[str, ...] = (),
           keep: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """Select the compared columns in a form both engines agree on."""
    return df.select(*keep, *[text(c).alias(c) for c in dates], *[stamp(c).alias(c) for c in stamps],
                     *[rnd(c, digits).alias(c) for c in floats])
