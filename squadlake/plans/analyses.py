"""Season analyses over the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hazard_by_lagged_ratio(player_day: DataFrame, injuries: DataFrame, *, cut: float = 1.15, lag: int = 3) -> DataFrame:
    """Injuries per 1,000 player-days, split by the ratio ``lag`` days earlier."""
    w = Window.partitionBy("player_sk").orderBy("date_day")
    events = injuries.groupBy("player_sk", F.col("event_date").alias("date_day")).agg(F.count("*").alias("_events"))
    rows = player_day.withColumn("_before", F.lag("acwr_coupled", lag).over(w)).where("_before is not null")
    rows = rows.join(events, ["player_sk", "date_day"], "left")
    return rows.groupBy((F.col("_before") > cut).alias("above")).agg(
        F.count("*").alias("player_days"), F.coalesce(F.sum("_events"), F.lit(0)).cast("bigint").alias("injuries"),
        (1000.0 * F.coalesce(F.sum("_events"), F.lit(0)) / F.count("*")).alias("per_1000_days"))


def weekly_load_spread(mart: DataFrame) -> DataFrame:
    """Weekly load against the player's own mean: 95th percentile and maximum, and the share of high days."""
    w = Window.partitionBy("player_sk")
    ratio = F.try_divide(F.col("external_load_week"), F.avg("external_load_week").over(w))
    rows = mart.withColumn("_ratio", ratio)
    return rows.agg(F.percentile_approx("_ratio", 0.95, 10_000).alias("p95"), F.max("_ratio").alias("max_ratio"),
                    F.count("_ratio").alias("player_weeks"))


def at_risk(readings: DataFrame, load: DataFrame, *, ratio: float = 1.5, asymmetry: float = 10.0, lag: int = 3) -> DataFrame:
    """Practice and game days, flagged where the ratio ``lag`` days earlier or the asymmetry is above its limit."""
    w = Window.partitionBy("player_sk").orderBy("date_day")
    before = load.withColumn("_before", F.lag("acwr_coupled", lag).over(w)).where("day_type in ('practice', 'game')")
    high = lambda c, limit: F.coalesce(c > limit, F.lit(False))
    return readings.join(before.select("player_sk", "date_day", "_before"), ["player_sk", "date_day"]).withColumn(
        "flagged", high(F.col("_before"), ratio) | high(F.abs("asymmetry_4w_avg"), asymmetry))


def rate_comparison(days: DataFrame, flagged: str, hit: str) -> DataFrame:
    """Hit rate on flagged and on other days."""
    f = F.col(flagged)
    rate = lambda cond: F.try_divide(F.count_if(cond & F.col(hit)), F.count_if(cond))
    return days.agg(F.count_if(f).alias("flagged_days"), F.count_if(~f).alias("base_days"), rate(f).alias("flagged_rate"),
                    rate(~f).alias("base_rate"))


def mean_after(days: DataFrame, keys: list[str], day: str, kind: str, value: str) -> DataFrame:
    """Mean of ``value`` by the kind of the day before (dense grid)."""
    w = Window.partitionBy(*keys).orderBy(day)
    return (days.withColumn("previous_kind", F.lag(kind).over(w)).where("previous_kind is not null")
            .groupBy("previous_kind").agg(F.avg(value).alias("mean_value"), F.count(value).alias("n_days")))
