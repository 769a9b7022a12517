"""Report-facing views of the quality tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expectation_results(results: DataFrame) -> DataFrame:
    cols = ["run_id", "source", "suite", "expectation_name", "column_name", "kwargs", "success", "element_count",
            "unexpected_count", "unexpected_percent", "systemic", "validated_at"]
    return results.select(*[c for c in cols if c in results.columns])


def quarantine_all(by_source: Mapping[str, DataFrame]) -> DataFrame:
    """Every source's current quarantine, labelled with its source."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(s)) for s, df in by_source.items()])


def resolution_by_method(vendor_map: DataFrame) -> DataFrame:
    return vendor_map.groupBy("vendor", "resolved_by").agg(
        F.count("*").alias("identifiers"), F.round(F.avg("confidence"), 2).alias("avg_confidence"))


def with_recency(df: DataFrame, at: str, name: str = "run_recency") -> DataFrame:
    """dense_rank by ``at`` (a date or timestamp) descending, NULL first, 1 = latest.

    Distinct instants are ranked within their day, and days get offsets from their
    counts; only days, bounded by the calendar, meet in one place.  Rows get their
    rank by a join, so the number of rows per instant does not matter.
    """
    instants = df.select(F.col(at).alias("_at"), F.to_date(at).alias("_day")).distinct()
    later = Window.orderBy(F.col("_day").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    days = instants.groupBy("_day").agg(F.count("*").alias("_n")).select(
        F.col("_day").alias("_d"), F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_day").orderBy(F.col("_at").desc()))
    ranked = instants.join(days, F.col("_day").eqNullSafe(F.col("_d"))).select("_at", (F.col("_before") + within).cast("int").alias(name))
    return df.join(ranked, F.col(at).eqNullSafe(F.col("_at")), "left").drop("_at")


def run_summary(summary: DataFrame) -> DataFrame:
    return with_recency(summary, "created_at")
