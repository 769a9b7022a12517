"""Declarative expectation suites: one scan per suite, failures routed with a reason.

A suite is data ({"name", "meta", "expectations": [{"type", "kwargs"}]}).  Each
expectation compiles to two Column predicates, *evaluated* (the row counts
towards the percentage) and *failed*; ``KINDS`` has one line per type.  Results are a single aggregate over all
predicates and quarantine rows a single explode, whatever the suite's size.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.functions.casts import general_number

SYSTEMIC_PCT = 50.0

NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
IN_SET = "expect_column_values_to_be_in_set"
BETWEEN = "expect_column_values_to_be_between"
REGEX = "expect_column_values_to_match_regex"
PAIR = "expect_column_pair_values_a_to_be_greater_than_b"
PARSES = "expect_column_values_to_be_parsable"
UNPARSABLE = "unparsable"  # column of a staging frame: the fields whose text is no value of their type

RESULT_SCHEMA = ("run_id string, source string, suite string, expectation_name string, column_name string, "
                 "kwargs string, success boolean, element_count bigint, unexpected_count bigint, "
                 "unexpected_percent double, systemic boolean")
RESULT_COLUMNS = tuple(f.split()[0] for f in RESULT_SCHEMA.split(", "))
QUARANTINE_SCHEMA = ("bronze_id bigint, endpoint string, run_id string, expectation_name string, "
                     "column_name string, observed_value string, reason string")


class SystemicValidationFailure(Exception):
    """At least half of a batch failed an expectation, or a column it names is gone."""


class ReconciliationError(Exception):
    """Rows in, minus duplicates and quarantined, is not rows out."""


def _outside(low: Any, high: Any, value: Column) -> Column:
    bad = [test for limit, test in ((low, value < low), (high, value > high)) if limit is not None]
    return reduce(lambda x, y: x | y, bad, F.lit(False))


class Kind(NamedTuple):
    """How a type of expectation judges a row whose columns are all present."""

    message: str  # fixed wording
    failed: Callable[[Mapping[str, Any], list[Column]], Column]
    with_nulls: bool = False  # judges rows without a value too


KINDS: dict[str, Kind] = {
    NOT_NULL: Kind("{column} is null", lambda kw, c: c[0].isNull(), True),
    PARSES: Kind("{column} text", lambda kw, c: c[0].isNotNull(), True),
    UNIQUE: Kind("{column} is duplicated", lambda kw, c: F.col(_dup(kw["column"]))),
    PAIR: Kind("{column_A} < {column_B}", lambda kw, c: c[0] < c[1] if kw.get("or_equal") else c[0] <= c[1]),
    REGEX: Kind("{column} does not match {regex}", lambda kw, c: ~c[0].rlike(kw["regex"])),
    IN_SET: Kind("{column} not in {value_set}", lambda kw, c: ~c[0].isin(*kw["value_set"])),
    BETWEEN: Kind("{column} outside {min_value}..{max_value}", lambda kw, c: _outside(kw.get("min_value"), kw.get("max_value"), c[0])),
}


@dataclass(frozen=True)
class Expectation:
    type: str
    kwargs: Mapping[str, Any]

    @property
    def kind(self) -> Kind:
        if self.type not in KINDS:
            raise ValueError(f"unsupported expectation {self.type}")
        return KINDS[self.type]

    @property
    def columns(self) -> list[str]:
        """The columns named, in the order of the arguments."""
        return [v for k, v in self.kwargs.items() if k.startswith("column") and v]

    @property
    def column_name(self) -> str:
        """The column that is held responsible: the last one named."""
        return self.columns[-1]

    def reason(self) -> str:
        return self.kind.message.format_map(defaultdict(lambda: None, self.kwargs))

    def evaluated(self) -> Column:
        present = [F.col(c).isNotNull() for c in self.columns]
        return F.lit(True) if self.kind.with_nulls else reduce(lambda x, y: x & y, present)

    def failed(self) -> Column:
        bad = self.kind.failed(self.kwargs, [F.col(c) for c in self.columns])
        return F.coalesce(self.evaluated() & bad, F.lit(False))


@dataclass(frozen=True)
class Suite:
    name: str
    source: str
    endpoint: str
    table: str
    expectations: tuple[Expectation, ...]

    @staticmethod
    def from_dict(doc: Mapping[str, Any]) -> Suite:
        meta = doc["meta"]
        return Suite(doc["name"], meta["source"], meta["endpoint"], meta["table"],
                     tuple(Expectation(e["type"], e["kwargs"]) for e in doc["expectations"]))


def load_suites(folder: Path, source: str | None = None) -> list[Suite]:
    """Suites from a folder of JSON files, by file name."""
    files = sorted((f for f in folder.iterdir() if f.name.endswith(".json")), key=lambda f: f.name)
    docs = [json.loads(f.read_text()) for f in files]
    suites = [Suite.from_dict(d) for d in docs]
    return [s for s in suites if source is None or s.source == source]


def _dup(column: str) -> str:
    return f"_dup_{column}"


def _observed(df: DataFrame, exp: Expectation) -> Column:
    types = dict(df.dtypes)

    def plain(c: str) -> Column:
        floating = types[c] in ("double", "float") or types[c].startswith("decimal")
        text = general_number(F.col(c)) if floating else F.col(c).cast("string")
        return F.concat(F.lit(f"{c}="), F.coalesce(text, F.lit("null")))

    return F.concat_ws(", ", *[plain(c) for c in exp.columns])


class Validation:
    """A frame checked against a suite; both outputs are lazy."""

    def __init__(self, df: DataFrame, suite: Suite, run_id: str, id_col: str = "bronze_id"):
        self.suite, self.run_id, self.id_col = suite, run_id, id_col
        expected = suite.expectations
        if UNPARSABLE in df.columns:
            expected = (*expected, Expectation(PARSES, {"column": UNPARSABLE}))
        self.usable = [e for e in expected if set(e.columns) <= set(df.columns)]
        self.missing = [e for e in expected if e not in self.usable]
        self.source_frame = df
        self.frame = df
        for e in self.usable:
            if e.type == UNIQUE:
                self.frame = self._mark_duplicates(self.frame, e.columns[0])

    @staticmethod
    def _mark_duplicates(df: DataFrame, column: str) -> DataFrame:
        """Every member of a duplicate group is marked; only repeated keys are joined back."""
        repeated = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key"))
                    .agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
        return (df.join(repeated, F.col(column) == F.col("_key"), "left")
                  .withColumn(_dup(column), F.col("_key").isNotNull()).drop("_key"))

    def results(self) -> DataFrame:
        """One row per expectation; the check for unparsable values has one only if it fails."""
        s = self.suite
        aggs = [F.count("*").alias("n")]
        for i, e in enumerate(self.usable):
            aggs += [F.count_if(e.failed()).alias(f"bad{i}"), F.count_if(e.evaluated()).alias(f"seen{i}")]
        one = self.frame.agg(*aggs)

        def row(e: Expectation, bad: Column, pct: Column, raised: bool) -> Column:
            systemic = F.lit(True) if raised else F.coalesce(pct >= SYSTEMIC_PCT, F.lit(False))
            cells = [F.lit(self.run_id), F.lit(s.source), F.lit(s.name), F.lit(e.type), F.lit(e.column_name),
                     F.lit(json.dumps(dict(e.kwargs))), F.lit(False) if raised else bad == 0,
                     F.lit(None).cast("bigint") if raised else F.col("n"), bad.cast("bigint"), pct.cast("double"), systemic]
            return F.struct(*[c.alias(n) for n, c in zip(RESULT_COLUMNS, cells)])

        rows = [row(e, F.col(f"bad{i}"), F.try_divide(100.0 * F.col(f"bad{i}"), F.col(f"seen{i}")), False)
                for i, e in enumerate(self.usable)]
        rows += [row(e, F.lit(None), F.lit(None), True) for e in self.missing]
        every = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        return every.where((F.col("expectation_name") != PARSES) | ~F.col("success"))

    def failed_ids(self) -> DataFrame:
        """Ids of the records that fail anything: a filter, no reason text is built."""
        any_failed = F.lit(False)
        for e in self.usable:
            any_failed = any_failed | e.failed()
        return self.frame.where(any_failed).select(F.col(self.id_col).cast("bigint").alias("bronze_id"))

    def quarantine(self) -> DataFrame:
        """One row per (record, failed expectation).  The explode makes numbers of expectations;
        texts are built behind it, once for a row, and not at all for who reads ids only."""
        if not self.usable:
            return self.frame.sparkSession.createDataFrame([], QUARANTINE_SCHEMA)
        failed = F.array(*[F.when(e.failed(), F.lit(i)) for i, e in enumerate(self.usable)])
        hits = self.frame.select("*", F.explode(F.array_compact(failed)).alias("_failed"))
        text = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_failed") + 1)
        observed = F.coalesce(*[F.when(F.col("_failed") == i, _observed(self.source_frame, e)) for i, e in enumerate(self.usable)])
        return (hits.select(F.col(self.id_col).cast("bigint").alias("bronze_id"), F.lit(self.suite.endpoint).alias("endpoint"),
                            F.lit(self.run_id).alias("run_id"), text(e.type for e in self.usable).alias("expectation_name"),
                            text(e.column_name for e in self.usable).alias("column_name"), observed.alias("observed_value"),
                            text(e.reason() + ": " for e in self.usable).alias("_reason"))
                .select("bronze_id", "endpoint", "run_id", "expectation_name", "column_name", "observed_value",
                        F.concat("_reason", "observed_value").alias("reason")))


def raise_if_systemic(results: DataFrame, suites: Iterable[Suite]) -> None:
    """Fail this source only: call after results and quarantine are written.

    ``results`` has one row per expectation, so what reaches the driver is
    bounded by the suites.
    """
    reasons = {(s.name, e.type, e.column_name): e.reason() for s in suites for e in s.expectations}
    bad = results.where("systemic").select("suite", "expectation_name", "column_name", "unexpected_percent").collect()
    if bad:
        raise SystemicValidationFailure("; ".join(
            f"{r.suite}: {reasons.get((r.suite, r.expectation_name, r.column_name), r.expectation_name)} - "
            + ("column is missing" if r.unexpected_percent is None else f"{r.unexpected_percent:.1f}% unexpected")
            for r in bad))


def quarantined_ids(quarantine: DataFrame, run_id: str | None = None) -> DataFrame:
    """Distinct record ids held back by expectations.  Identity failures recorded
    in the same table are not counted, so a re-run classifies rows the same way."""
    q = quarantine.where("expectation_name <> 'player_resolved'")
    if run_id is not None:
        q = q.where(F.col("run_id") == run_id)
    return q.select("bronze_id").distinct()


def without_quarantined(df: DataFrame, ids: DataFrame, id_col: str = "bronze_id") -> DataFrame:
    held = ids.select(F.col("bronze_id").alias("_held"))
    return df.join(held, F.col(id_col) == F.col("_held"), "left_anti")


def identity_failures(rows: DataFrame, endpoint: str, run_id: str, observed: Column, reason: Column) -> DataFrame:
    """Unresolved records in the shape of the source's quarantine."""
    return rows.select(F.col("bronze_id").cast("bigint"), F.lit(endpoint).alias("endpoint"), F.lit(run_id).alias("run_id"),
                       F.lit("player_resolved").alias("expectation_name"), F.lit("player").alias("column_name"),
                       observed.alias("observed_value"), reason.alias("reason"))


def upsert_results(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the rows of ``fresh`` in the history by (run, source, suite, expectation, column)."""
    key = ["run_id", "source", "suite", "expectation_name", "column_name"]
    incoming = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in key]).distinct()
    same = None
    for k in key:
        eq = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = eq if same is None else same & eq
    return history.join(incoming, same, "left_anti").unionByName(fresh)


def summarise(counts: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Scorecard per source: ``counts`` has source, rows_in, duplicates_removed,
    rows_quarantined_dq, rows_quarantined_identity, rows_in_silver and any profile columns."""
    held = F.col("rows_quarantined_dq") + F.col("rows_quarantined_identity")
    return (counts.withColumn("rows_quarantined", held)
            .withColumn("reconciles", F.col("rows_in") - F.col("duplicates_removed") - F.col("rows_quarantined")
                        == F.col("rows_in_silver"))
            .withColumn("run_id", F.lit(run_id)).withColumn("created_at", now))


def raise_unless_reconciled(summary: DataFrame) -> None:
    """One row per source reaches the driver."""
    bad = summary.where("not reconciles").collect()
    if bad:
        raise ReconciliationError(", ".join(
            f"{r.source}: {r.rows_in} - {r.duplicates_removed} - {r.rows_quarantined} != {r.rows_in_silver}" for r in bad))
