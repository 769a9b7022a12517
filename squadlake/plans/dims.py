"""Dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squadlake.functions import casts
from squadlake.functions.casts import surrogate_key
from squadlake.functions.text import clean_name
from squadlake.operators.dedup import attach_group, last_wins, latest_per_key
from squadlake.operators.scd import scd2_merge, upsert_retire

# Season calendar, tracked columns and the weekly schedule (1 = Monday).
SEASON_START = "2026-07-20"
SEASON_END = "2027-07-31"
TRACKED = ("full_name", "team", "position", "weight_lbs", "height_in", "roster_valid_to")
COMPARED = ("nfl_id", "espn_id", "pfr_id", "team", "position", "full_name", "football_name", "weight_lbs", "height_in")
DAY_TYPES = ("off", "off", "practice", "practice", "practice", "walkthrough", "game")
COUNTED_DOWS = (3, 4, 5, 7)

MASTER_SCHEMA = ("player_sk bigint, gsis_id string, nfl_id bigint, espn_id bigint, pfr_id string, full_name string, "
                 "clean_name string, first_name string, last_name string, football_name string, team string, "
                 "position string, weight_lbs double, height_in double, bronze_id bigint, valid_from timestamp, "
                 "valid_to timestamp, updated_at timestamp")
SNAPSHOT_SCHEMA = ("player_sk bigint, gsis_id string, nfl_id bigint, espn_id bigint, pfr_id string, full_name string, "
                   "clean_name string, first_name string, last_name string, football_name string, team string, "
                   "position string, weight_lbs double, height_in double, roster_valid_to timestamp, "
                   "valid_from timestamp, valid_to timestamp")

ROSTER_FIELDS = ("player_id", "player_name", "first_name", "last_name", "football_name", "team", "position", "weight",
                 "height", "espn_id", "pfr_id")
CROSSWALK_FIELDS = ("gsis_id", "nfl_id", "espn_id", "pfr_id")


def calendar_columns(day: Column, start: Column) -> dict[str, Column]:
    """Calendar attributes of a day; weeks count from ``start``."""
    dow = F.weekday(day) + 1
    return {
        "iso_dow": dow, "day_name": F.date_format(day, "E"),
        "season_week": (F.floor(F.datediff(day, start) / 7) + 1).cast("int"),
        "day_type": F.element_at(F.array(*[F.lit(t) for t in DAY_TYPES]), dow),
        "is_scheduled": dow.between(3, 7), "counts_for_availability": dow.isin(*COUNTED_DOWS),
        "year": F.year(day), "month": F.month(day)}


def dim_date(spark: SparkSession, start: str = SEASON_START, end: str = SEASON_END) -> DataFrame:
    """One row per day, ``end`` excluded."""
    first, last = F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1)
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("date_day"))
    return days.select("date_day", *[c.alias(n) for n, c in calendar_columns(F.col("date_day"), first).items()])


def dim_team(master: DataFrame, stadiums: DataFrame) -> DataFrame:
    teams = (master.where("team is not null").groupBy("team")
             .agg(F.count_if(F.col("valid_to").isNull()).alias("active_players")))
    place = stadiums.withColumnRenamed("team", "_t")
    return teams.join(place, F.col("team") == F.col("_t"), "left").select(
        F.col("team").alias("team_sk"), "team", "stadium", "city", "state", "latitude", "longitude",
        F.coalesce("is_dome", F.lit(False)).alias("is_dome"), "surface", "active_players")


def dim_injury_type(seed: DataFrame) -> DataFrame:
    return seed.select(surrogate_key(F.col("raw_text")).alias("injury_type_sk"), F.lower("raw_text").alias("raw_text"),
                       "body_part", "body_region", F.nullif(F.col("side"), F.lit("")).alias("side"))


def roster_snapshot(bronze: DataFrame) -> DataFrame:
    """Latest roster row per league id with ids filled from the crosswalk."""
    def stream(endpoint: str, fields: tuple[str, ...]) -> DataFrame:
        schema = ", ".join(f"{f} string" for f in fields)
        return (bronze.where((F.col("_source") == "nflverse") & (F.col("_endpoint") == endpoint))
                .select("id", "_ingested_at", F.from_json("payload", schema).alias("p"))
                .select("id", "_ingested_at", "p.*"))

    present = lambda c: F.nullif(F.col(c), F.lit(""))
    roster = latest_per_key(stream("rosters", ROSTER_FIELDS), ["player_id"])
    xwalk = last_wins(stream("ids", CROSSWALK_FIELDS), "gsis_id").select(
        F.col("gsis_id").alias("_g"), *[F.col(c).alias(f"x_{c}") for c in CROSSWALK_FIELDS[1:]])
    spelled = F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    rows = roster.join(xwalk, F.col("player_id") == F.col("_g"), "left").withColumn(
        "full_name", F.coalesce(present("player_name"), spelled))
    return rows.select(
        F.col("player_id").alias("gsis_id"), casts.whole(F.col("x_nfl_id")).alias("nfl_id"),
        casts.whole(F.coalesce(present("espn_id"), F.col("x_espn_id"))).alias("espn_id"),
        F.coalesce(present("pfr_id"), F.col("x_pfr_id")).alias("pfr_id"), "full_name",
        clean_name(F.col("full_name")).alias("clean_name"), "first_name", "last_name", "football_name", "team", "position",
        casts.num(F.col("weight")).alias("weight_lbs"), casts.num(F.col("height")).alias("height_in"),
        F.col("id").alias("bronze_id"))


def build_player_master(bronze: DataFrame, prev: DataFrame, now: Column) -> DataFrame:
    return upsert_retire(prev, roster_snapshot(bronze), key="gsis_id", sk="player_sk", compare=COMPARED, now=now)


def snapshot_players(history: DataFrame, master: DataFrame, now: Column) -> DataFrame:
    """Fold the master's current state into the version history."""
    state = master.select("player_sk", "gsis_id", "nfl_id", "espn_id", "pfr_id", "full_name", "clean_name", "first_name",
                          "last_name", "football_name", "team", "position", "weight_lbs", "height_in",
                          F.col("valid_to").alias("roster_valid_to"))
    return scd2_merge(history, state, key="player_sk", check=TRACKED, now=now)


def dim_player(history: DataFrame) -> DataFrame:
    rows = attach_group(history, ["player_sk"], versions=F.count("*"))
    return rows.select(
        surrogate_key(F.col("player_sk"), F.col("valid_from")).alias("player_version_sk"), "player_sk", "gsis_id", "nfl_id",
        "espn_id", "pfr_id", "full_name", "clean_name", "first_name", "last_name", "football_name", "team", "position",
        "weight_lbs", "height_in", F.col("roster_valid_to").isNull().alias("on_roster"), "valid_from", "valid_to",
        F.col("valid_to").isNull().alias("is_current"), "versions")


def dim_player_current(dim: DataFrame) -> DataFrame:
    return dim.where("is_current").select(
        "player_sk", "gsis_id", "nfl_id", "espn_id", "pfr_id", "full_name", "first_name", "last_name", "football_name", "team",
        "position", F.col("weight_lbs").alias("roster_weight_lbs"), F.col("height_in").alias("roster_height_in"),
        "on_roster", "valid_from")
