"""Declarative table tests.  Each returns the failing rows, so an empty frame passes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return unique_combination(df.where(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Combinations that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list; NULL is allowed."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, to: DataFrame, field: str) -> DataFrame:
    """Rows whose non-null key is missing from ``to``.

    Keys are made distinct first, so the anti join sees each key once and the
    rows of a broken key are fetched back only if there are any.
    """
    keys = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_fk")).distinct()
    target = to.select(F.col(field).alias("_pk")).distinct()
    broken = keys.join(target, F.col("_fk") == F.col("_pk"), "left_anti")
    return df.join(broken, F.col(column) == F.col("_fk"), "left_semi")


def is_between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).between(low, high))


def expression_is_true(df: DataFrame, expression: str | Column) -> DataFrame:
    holds = F.expr(expression) if isinstance(expression, str) else expression
    return df.where(~holds)


def failures(tests: Mapping[str, DataFrame]) -> DataFrame:
    """(assertion, failing_rows) for a set of tests, one row each."""
    parts = [df.agg(F.count("*").alias("failing_rows")).select(F.lit(name).alias("assertion"), "failing_rows")
             for name, df in tests.items()]
    return reduce(DataFrame.unionByName, parts)
