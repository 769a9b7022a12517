"""Surrogate numbers without a sequence, a global sort or a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # hex digits of md5: 4,096 buckets


def number_new_keys(df: DataFrame, key: str, start: Column, number_as: str) -> DataFrame:
    """Give every distinct ``key`` the next free number after ``start``.

    Keys are unique on input.  They are hashed into 4,096 buckets, numbered
    inside their bucket, and each bucket is shifted by the keys in the buckets
    before it (a 4,096-row table).  The result depends only on the keys, so a
    re-run gives the same numbers.
    """
    bucketed = df.withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, BUCKET_DIGITS))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_bucket").orderBy(key)
    return (bucketed.withColumn("_pos", F.row_number().over(inside))
            .join(shifts, F.col("_bucket") == F.col("_b"))
            .withColumn(number_as, (start + F.col("_shift") + F.col("_pos")).cast("bigint"))
            .drop("_bucket", "_b", "_pos", "_shift"))
