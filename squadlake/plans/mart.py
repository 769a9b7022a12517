"""The weekly mart: one row per tracked player and season week."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squadlake.functions import units
from squadlake.functions.casts import surrogate_key
from squadlake.operators.dedup import first_per_key

KEY = ["player_sk", "season_week"]


def _weekly(df: DataFrame, day: str, calendar: DataFrame) -> DataFrame:
    """Attach season_week by day; days outside the calendar drop out."""
    days = calendar.select(F.col("date_day").alias("_day"), "season_week")
    return df.join(days, F.col(day) == F.col("_day")).drop("_day")


def mart_player_week(training_load: DataFrame, wellness: DataFrame, strength: DataFrame, nutrition: DataFrame,
                     availability: DataFrame, injury: DataFrame, injury_status: DataFrame, play: DataFrame,
                     players: DataFrame, calendar: DataFrame) -> DataFrame:
    """``players`` is the player dimension (all versions).

    The load grid is dense, so (player, week) comes from it directly; every
    other side is aggregated to (player, week) before it is joined.
    """
    last = F.max(F.struct("date_day", "acute_7d", "chronic_28d", "acwr_coupled", "acwr_ewma", "acwr_band", "internal_acwr"))
    load = training_load.groupBy(*KEY).agg(
        F.sum("external_load").alias("external_load_week"), F.sum("internal_load").alias("internal_load_week"),
        F.sum("sessions").alias("sessions_week"), F.sum("total_distance_m").alias("distance_m_week"),
        F.max("acwr_coupled").alias("_acwr_max"),
        F.count_if(F.col("acwr_band") == "high").alias("days_acwr_high"), last.alias("_end"))
    weeks = training_load.groupBy("season_week").agg(F.min("date_day").alias("week_start"), F.max("date_day").alias("week_end"))

    well = _weekly(wellness, "survey_date", calendar).groupBy(*KEY).agg(
        *[F.round(F.avg(F.col(c).cast("decimal(18,8)")), 2).cast("double").alias(n) for c, n in (
            ("readiness_score", "readiness_avg"), ("soreness", "soreness_avg"), ("fatigue", "fatigue_avg"),
            ("sleep_hours", "sleep_hours_avg"))], F.count("*").alias("surveys"))

    tests = first_per_key(_weekly(strength, "test_date", calendar), KEY, [F.col("test_ts").desc(), F.col("strength_sk").desc()])
    tests = tests.select(*KEY, "asymmetry_pct", F.round("asymmetry_4w_avg", 2).alias("asymmetry_4w_avg"),
                         F.round("asymmetry_trend", 2).alias("asymmetry_trend"), "jump_height_4w_max",
                         F.col("test_date").alias("last_test_date"))

    weighed = first_per_key(_weekly(nutrition.where("is_preferred"), "measured_on", calendar), KEY,
                            [F.col("measured_on").desc(), F.col("method_rank").asc(), F.col("nutrition_sk").desc()])
    weighed = weighed.select(*KEY, "weight_lbs", "body_fat_pct", F.col("method").alias("weight_method"),
                             F.col("measured_on").alias("last_weigh_in"))

    part = F.coalesce("body_part", "body_part_raw")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_date", "injury_sk", part.alias("part")))),
                         lambda x: x["part"])
    new = _weekly(injury, "event_date", calendar).groupBy(*KEY).agg(
        F.count("*").alias("new_injuries"), F.array_join(listed, ", ").alias("new_injury_body_parts"))

    # Status on the injury's last day of the week, then the worst across injuries.
    last_day = injury_status.groupBy("player_sk", "season_week", "injury_id").agg(
        F.max_by(units.practice_rank(F.col("practice_status")), "date_day").alias("_rank"), F.max("date_day").alias("_d"))
    ends = weeks.select(F.col("season_week").alias("_w"), F.col("week_end").alias("_we"))
    status = (last_day.join(ends, (F.col("season_week") == F.col("_w")) & (F.col("_d") <= F.col("_we")))
              .groupBy(*KEY).agg(F.count("*").alias("open_injuries"), F.min("_rank").alias("_worst")))

    games = play.where("season_week is not null").groupBy(*KEY).agg(
        F.sum("plays").alias("plays"), F.round(F.sum("epa_total"), 2).alias("epa_total"),
        F.sum("offense_snaps").alias("offense_snaps"), F.sum("defense_snaps").alias("defense_snaps"),
        F.round(F.avg("offense_pct"), 3).alias("offense_pct"), F.count("*").alias("games"))

    who = players.where("is_current").select(F.col("player_sk").alias("_sk"), "full_name", "team", "position")
    held = availability.select(*KEY, "availability_pct", "scheduled_sessions", "missed_sessions")
    wide = load.join(weeks, "season_week").join(who, F.col("player_sk") == F.col("_sk"), "left")
    for side in (well, tests, weighed, held, new, status, games):
        wide = wide.join(side, KEY, "left")
    r = lambda c, n: F.round(F.col(f"_end.{c}"), n).alias(c)
    return wide.select(
        surrogate_key(F.col("player_sk"), F.col("season_week")).alias("player_week_sk"), *KEY, "week_start", "week_end",
        "full_name", "team", "position", "external_load_week", "internal_load_week", "sessions_week", "distance_m_week",
        r("acute_7d", 1), r("chronic_28d", 1), r("acwr_coupled", 3), r("acwr_ewma", 3), r("internal_acwr", 3),
        F.col("_end.acwr_band").alias("acwr_band"), F.round("_acwr_max", 3).alias("acwr_max_week"), "days_acwr_high",
        "readiness_avg", "soreness_avg", "fatigue_avg", "sleep_hours_avg", "surveys", "asymmetry_pct", "asymmetry_4w_avg",
        "asymmetry_trend", "jump_height_4w_max", "last_test_date", "weight_lbs", "body_fat_pct", "weight_method",
        "last_weigh_in", "availability_pct", "scheduled_sessions", "missed_sessions",
        F.coalesce("new_injuries", F.lit(0)).alias("new_injuries"), "new_injury_body_parts",
        F.coalesce("open_injuries", F.lit(0)).alias("open_injuries"),
        F.coalesce(units.label_of(F.col("_worst"), units.PRACTICE), F.lit("FP")).alias("practice_status"),
        F.coalesce("games", F.lit(0)).alias("games"), "plays", "epa_total", "offense_snaps", "defense_snaps", "offense_pct")


def ratio_bands(mart: DataFrame) -> DataFrame:
    """Next week's injury rate by this week's closing workload band."""
    w = Window.partitionBy("player_sk").orderBy("season_week")
    nxt = mart.withColumn("_next", F.lead("new_injuries").over(w)).where("acwr_band is not null and _next is not null")
    return nxt.groupBy("acwr_band").agg(
        F.count("*").alias("player_weeks"), F.count_if(F.col("_next") > 0).alias("with_injury"),
        F.round(100.0 * F.count_if(F.col("_next") > 0) / F.count("*"), 4).alias("next_week_rate_pct"))
