"""Tests of tables declared as data, compiled to few passes.

A declaration names, for a table, what has to hold:

    "keys":    column lists that are unique (a single column where it is not null),
    "filled":  columns without nulls,
    "refers":  {column: "table.column"}, values that have to be there, nulls aside,
    "one_of":  {column: values}, nulls aside,
    "within":  {column: [low, high]}, nulls aside,
    "holds":   SQL conditions that are nowhere false,
    "least":   [[condition, value, columns], ...]: rows that meet the condition have the
               least value among the rows that agree in the columns, nulls aside.

All row tests of a table are one aggregate over one scan of it; a key is one grouping;
a reference is one join of distinct values with the rows' counts, so a value that very
many rows hold is one row.  The result has a row for each test.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = "table_name string, test string, subject string, failing_rows bigint"


def read_declarations(path: Path) -> dict[str, dict[str, Any]]:
    return json.loads(path.read_text())


def _row_tests(declared: Mapping[str, Any]) -> list[tuple[str, str, Column]]:
    """(test, subject, whether a row fails it)"""
    out = [("filled", c, F.col(c).isNull()) for c in declared.get("filled", [])]
    out += [("one_of", c, ~F.col(c).isin(*values)) for c, values in declared.get("one_of", {}).items()]
    out += [("within", c, ~F.col(c).between(low, high)) for c, (low, high) in declared.get("within", {}).items()]
    return out + [("holds", condition, ~F.expr(condition)) for condition in declared.get("holds", [])]


def _one_row(counts: DataFrame, name: str, test: str, subject: str) -> DataFrame:
    return counts.select(F.lit(name).alias("table_name"), F.lit(test).alias("test"), F.lit(subject).alias("subject"),
                         F.coalesce("n", F.lit(0)).cast("bigint").alias("failing_rows"))


def _rows_passes(name: str, df: DataFrame, declared: Mapping[str, Any]) -> list[DataFrame]:
    tests = _row_tests(declared)
    if not tests:
        return []
    counts = df.agg(*[F.count_if(failed).alias(f"n{i}") for i, (_, _, failed) in enumerate(tests)])
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(test).alias("test"), F.lit(subject).alias("subject"), F.col(f"n{i}").alias("failing_rows"))
            for i, (test, subject, _) in enumerate(tests)]
    return [counts.select(F.inline(F.array(*rows)))]


def _key_passes(name: str, df: DataFrame, declared: Mapping[str, Any]) -> list[DataFrame]:
    out = []
    for columns in declared.get("keys", []):
        rows = df.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
        repeated = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).agg(F.count_if(F.col("rows") > 1).alias("n"))
        out.append(_one_row(repeated, name, "keys", ", ".join(columns)))
    return out


def _reference_passes(name: str, tables: Mapping[str, DataFrame], declared: Mapping[str, Any]) -> list[DataFrame]:
    out = []
    for column, target in declared.get("refers", {}).items():
        other, field = target.split(".")
        held = tables[name].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("rows"))
        there = tables[other].select(F.col(field).alias("_t")).distinct()
        broken = held.join(there, F.col("_v") == F.col("_t"), "left_anti").agg(F.sum("rows").alias("n"))
        out.append(_one_row(broken, name, "refers", f"{column} to {target}"))
    return out


def _least_passes(name: str, df: DataFrame, declared: Mapping[str, Any]) -> list[DataFrame]:
    out = []
    for condition, value, columns in declared.get("least", []):
        marked = df.where(F.expr(value).isNotNull()).groupBy(*columns, F.expr(value).alias("_v")).agg(F.count_if(F.expr(condition)).alias("marked"))
        above = marked.groupBy(*columns).agg((F.sum("marked") - F.min_by("marked", "_v")).alias("above")).agg(F.sum("above").alias("n"))
        out.append(_one_row(above, name, "least", f"{value} where {condition}"))
    return out


def results(tables: Mapping[str, DataFrame], declarations: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """RESULT_SCHEMA, a row for each declared test; ``tables`` holds each table named."""
    parts = []
    for name, declared in declarations.items():
        df = tables[name]
        parts += [*_rows_passes(name, df, declared), *_key_passes(name, df, declared),
                  *_reference_passes(name, tables, declared), *_least_passes(name, df, declared)]
    return reduce(DataFrame.unionByName, parts)


def count(declarations: Mapping[str, Mapping[str, Any]]) -> int:
    return sum(len(tests) for declared in declarations.values() for tests in declared.values())
