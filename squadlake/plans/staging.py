"""Typed projections of the raw feeds: unpack, keep the current row per key, convert units.

Every function takes the Bronze frame (``id, payload, _source, _endpoint,
_ingested_at, _schema_version``) and is lazy.  The endpoint filter prunes
partitions, JSON parsing is limited to the listed fields, and the dedup
collapses re-emissions before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.functions import casts, units
from squadlake.operators.dedup import attach_group, first_per_key, latest_with_count
from squadlake.operators.quality import UNPARSABLE
from squadlake.session import materialise, materialise_counted

# Field names of the payloads.
@dataclass(frozen=True)
class Feed:
    source: str
    endpoint: str
    key: tuple[str, ...]
    fields: tuple[str, ...]
    presence: tuple[str, ...] = ()  # payload keys of which it matters whether they are there, null or not


FORCEDECK = Feed("forcedeck", "/v1/tests", ("test_id",), (
    "test_id", "athlete_gsis_id", "test_ts", "test_type", "rep", "jump_height_cm", "peak_force", "force_unit",
    "rfd", "asymmetry_pct", "device_id"), ("device_id",))
CATAPULT = Feed("catapult", "/v1/sessions", ("session_id",), (
    "session_id", "player_id", "session_ts", "session_type", "duration_min", "distance_unit", "total_distance",
    "high_speed_distance", "speed_unit", "max_speed", "sprint_count", "accel_count", "decel_count", "player_load"))
ATHLETES = Feed("catapult", "/v1/athletes", ("athlete_id",), ("athlete_id", "first_name", "last_name"))
WELLNESS = Feed("ams_wellness", "/v1/surveys", ("survey_id",), (
    "survey_id", "athlete_id", "player_id", "name", "first_name", "last_name", "submitted_at", "scale_max",
    "sleep_hours", "sleep_quality", "soreness", "fatigue", "stress", "mood", "srpe"), ("athlete_id", "scale_max"))
NUTRITION = Feed("nutrition", "/v1/measurements", ("measurement_id",), (
    "measurement_id", "player_name", "team", "measured_on", "method", "weight", "weight_unit", "body_fat_pct",
    "lean_mass", "hydration_status"))
INJURIES = Feed("emr", "/v1/injuries", ("injury_id",), (
    "injury_id", "player", "team", "event_date", "body_part", "side", "injury_type", "severity", "expected_rtp",
    "opened_at"))
STATUS_UPDATES = Feed("emr", "/v1/status_updates", ("update_id",), (
    "update_id", "injury_id", "player", "practice_status", "game_status", "note", "updated_at"))
PLAYS = Feed("nflverse", "pbp", ("game_id", "play_id"), (
    "game_id", "play_id", "season", "week", "game_date", "posteam", "defteam", "play_type", "passer_player_id",
    "rusher_player_id", "receiver_player_id", "epa", "qb_epa", "success", "yards_gained", "touchdown"))
SNAP_COUNTS = Feed("nflverse", "snap_counts", ("pfr_game_id", "pfr_player_id"), (
    "game_id", "pfr_game_id", "season", "week", "game_type", "player", "pfr_player_id", "position", "team", "opponent",
    "offense_snaps", "offense_pct", "defense_snaps", "defense_pct", "st_snaps", "st_pct"))
FORECAST = Feed("open_meteo", "forecast", ("stadium", "time"), (
    "stadium", "team", "timezone", "time", "temperature_2m", "apparent_temperature", "relative_humidity_2m",
    "precipitation", "wind_speed_10m", "wind_gusts_10m", "weather_code"))


class Unpacked:
    """A Bronze frame whose current records are unpacked once per feed and stored, for
    runs in which staging, validation, Silver and the scorecard all read them.  Takes
    a Bronze frame's place in every function here."""

    def __init__(self, bronze: DataFrame):
        self.bronze = bronze
        self.stored: dict[Feed, DataFrame] = {}
        self.every: dict[Feed, DataFrame] = {}
        self.counted: dict[Feed, dict] = {}

    def current(self, feed: Feed) -> DataFrame:
        """The current records; how many came and how many are kept is counted on the way."""
        if feed not in self.stored:
            came = self.every.get(feed, unpack(self.bronze, feed))
            kept = latest_with_count(came, feed.key, ("_ingested_at", "bronze_id"), "_versions").select(*came.columns, "_versions")
            stored, self.counted[feed] = materialise_counted(
                kept, rows_in=F.coalesce(F.sum("_versions"), F.lit(0)), rows_kept=F.count(F.lit(1)))
            self.stored[feed] = stored.drop("_versions")
        return self.stored[feed]

    def rows(self, feed: Feed) -> DataFrame:
        """All records, for feeds whose current ones are picked in several ways."""
        if feed not in self.every:
            self.every[feed] = materialise(unpack(self.bronze, feed))
        return self.every[feed]

    def counts(self, feed: Feed) -> dict[str, int]:
        """rows_in and rows_kept, as counted when the current records were stored."""
        self.current(feed)
        return self.counted[feed]


def rows_of(bronze: DataFrame | Unpacked, feed: Feed) -> DataFrame:
    """The records of one stream; a filter on the partition columns."""
    frame = bronze.bronze if isinstance(bronze, Unpacked) else bronze
    return frame.where((F.col("_source") == feed.source) & (F.col("_endpoint") == feed.endpoint))


def unpack(bronze: DataFrame | Unpacked, feed: Feed) -> DataFrame:
    """Payload fields as text, next to the record's metadata and whether the keys of
    ``feed.presence`` are there.  The payload itself is left behind: what follows
    shuffles, sorts and stores the rows."""
    schema = ", ".join(f"`{f}` string" for f in feed.fields)
    keys = [F.json_object_keys("payload").alias("_keys")] if feed.presence else []
    there = [F.array_contains("_keys", name).alias(_presence(name)) for name in feed.presence]
    return (rows_of(bronze, feed)
            .select(F.col("id").alias("bronze_id"), "_schema_version", "_ingested_at", *keys,
                    F.from_json("payload", schema).alias("_p"))
            .select("bronze_id", "_schema_version", "_ingested_at", *there, "_p.*"))


def every_row(bronze: DataFrame | Unpacked, feed: Feed) -> DataFrame:
    """All unpacked records of a feed, stored once where the frame is an ``Unpacked``."""
    return bronze.rows(feed) if isinstance(bronze, Unpacked) else unpack(bronze, feed)


def counts(bronze: DataFrame | Unpacked, feed: Feed) -> DataFrame:
    """One row: rows_in and rows_kept of a feed."""
    if isinstance(bronze, Unpacked):
        n = bronze.counts(feed)
        return bronze.bronze.sparkSession.createDataFrame([(n["rows_in"], n["rows_kept"])], "rows_in bigint, rows_kept bigint")
    per_key = unpack(bronze, feed).groupBy(*feed.key).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in"), F.count("*").alias("rows_kept"))


def _presence(name: str) -> str:
    return f"_has_{name}"


def has_key(name: str) -> Column:
    """Whether the payload carries the key at all, null or not; one of the feed's ``presence``."""
    return F.col(_presence(name))


def newest() -> list[Column]:
    return [F.col("_ingested_at").desc(), F.col("bronze_id").desc()]


def current(bronze: DataFrame | Unpacked, feed: Feed) -> DataFrame:
    """Latest ingest per business key."""
    if isinstance(bronze, Unpacked):
        return bronze.current(feed)
    return first_per_key(unpack(bronze, feed), feed.key, newest())


def _d(name: str) -> Column:
    return F.col(name).try_cast("double")


def _i(name: str) -> Column:
    return F.col(name).try_cast("int")


def unparsable(*, double: tuple[str, ...] = (), int: tuple[str, ...] = (), bigint: tuple[str, ...] = ()) -> Column:
    """The fields whose text is no number of their type, with that text; NULL if all are.
    Validation quarantines such a record, so its other values are not lost silently."""
    typed = [(c, kind) for kind, names in (("double", double), ("int", int), ("bigint", bigint)) for c in names]
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), F.concat(F.lit(f"{c}="), F.col(c))) for c, kind in typed]
    return F.nullif(F.concat_ws(", ", *bad), F.lit("")).alias(UNPARSABLE)


META = ("_schema_version", "_ingested_at")


def stg_forcedeck(bronze: DataFrame) -> DataFrame:
    force = _d("peak_force")
    return current(bronze, FORCEDECK).select(
        "bronze_id", "test_id", "athlete_gsis_id",
        F.timestamp_seconds(F.col("test_ts").try_cast("bigint")).alias("test_ts"), "test_type", _i("rep").alias("rep"),
        _d("jump_height_cm").alias("jump_height_cm"), force.alias("peak_force_raw"), "force_unit",
        units.to_newtons(force).alias("peak_force_n"), _d("rfd").alias("rfd"), _d("asymmetry_pct").alias("asymmetry_pct"),
        "device_id", unparsable(double=("peak_force", "jump_height_cm", "rfd", "asymmetry_pct"), int=("rep",), bigint=("test_ts",)), *META)


def stg_catapult(bronze: DataFrame) -> DataFrame:
    unit = F.col("distance_unit")
    return current(bronze, CATAPULT).select(
        "bronze_id", "session_id", "player_id", casts.guarded_iso(F.col("session_ts"), casts.ISO_Z).alias("session_ts"),
        "session_type", _i("duration_min").alias("duration_min"), "distance_unit",
        units.to_metres(_d("total_distance"), unit).alias("total_distance_m"),
        units.to_metres(_d("high_speed_distance"), unit).alias("high_speed_distance_m"), "speed_unit",
        units.to_ms(_d("max_speed")).alias("max_speed_ms"), _i("sprint_count").alias("sprint_count"),
        _i("accel_count").alias("accel_count"), _i("decel_count").alias("decel_count"),
        _d("player_load").alias("player_load"),
        unparsable(double=("total_distance", "high_speed_distance", "max_speed", "player_load"),
                   int=("duration_min", "sprint_count", "accel_count", "decel_count")), *META)


def stg_wellness(bronze: DataFrame) -> DataFrame:
    """Scale: the row's own declaration, else the cohort of its calendar day over all current rows."""
    at = F.col("submitted_at")
    rows = (current(bronze, WELLNESS)
            .withColumn("_day", F.left(at, F.lit(10))).withColumn("_declared", _i("scale_max"))
            .withColumn("_top", F.greatest(*[_d(c) for c in units.LIKERT])))
    rows = attach_group(rows, ["_day"], _day_top=F.max("_top"))
    person = F.concat_ws(" ", "first_name", "last_name")
    return rows.select(
        "bronze_id", "survey_id", F.coalesce("athlete_id", "player_id").try_cast("bigint").alias("nfl_id"),
        F.coalesce("name", person).alias("player_name"),
        F.when(has_key("athlete_id") | has_key("scale_max"), "v2").otherwise("v1").alias("schema_shape"),
        at.alias("submitted_at_raw"),
        F.when(at.rlike(casts.NAIVE_PREFIX), casts.wall_time(at, casts.FACILITY_TZ)).alias("submitted_at"),
        at.endswith("+00:00").alias("tz_claimed_utc"),
        F.coalesce("_declared", units.day_scale(F.col("_day_top"))).alias("scale_max"),
        F.col("_declared").isNull().alias("scale_inferred"), _d("sleep_hours").alias("sleep_hours"),
        *[_d(c).alias(c) for c in units.LIKERT], _i("srpe").alias("srpe"),
        unparsable(double=("sleep_hours", *units.LIKERT), int=("scale_max", "srpe"), bigint=("athlete_id", "player_id")), *META)


def stg_nutrition(bronze: DataFrame) -> DataFrame:
    lean = _d("lean_mass")
    return current(bronze, NUTRITION).select(
        "bronze_id", "measurement_id", "player_name", "team", casts.us_date(F.col("measured_on")).alias("measured_on"),
        "method", _d("weight").alias("weight_lbs"), "weight_unit", (F.col("weight_unit") == "kg").alias("weight_mislabeled"),
        _d("body_fat_pct").alias("body_fat_pct"), lean.alias("lean_mass_raw"),
        (lean < units.LEAN_PCT_BELOW).alias("lean_mass_is_pct"), "hydration_status",
        unparsable(double=("weight", "body_fat_pct", "lean_mass")), *META)


def stg_emr_injuries(bronze: DataFrame) -> DataFrame:
    event, rtp = F.col("event_date"), F.col("expected_rtp")
    return current(bronze, INJURIES).select(
        "bronze_id", "injury_id", "player", "team", casts.guarded_iso(event, casts.ISO_OFFSET).alias("event_ts"),
        F.when(event.rlike(casts.DATE_PREFIX), casts.iso_date(event)).alias("event_date"),
        "body_part", "side", "injury_type", "severity",
        F.when(rtp.rlike(casts.DATE_ONLY), casts.iso_date(rtp)).alias("expected_rtp"), *META)


def stg_emr_status_updates(bronze: DataFrame) -> DataFrame:
    """A correction re-emits the id with a later event time, so event time decides first."""
    at = F.col("updated_at")
    rows = first_per_key(every_row(bronze, STATUS_UPDATES), STATUS_UPDATES.key,
                         [F.try_to_timestamp(at).desc_nulls_first(), *newest()])
    return rows.select("bronze_id", "update_id", "injury_id", "player",
                       casts.guarded_iso(at, casts.ISO_OFFSET).alias("updated_at"),
                       "practice_status", "game_status", "note", *META)


def stg_open_meteo(bronze: DataFrame) -> DataFrame:
    local = F.to_timestamp_ntz(F.regexp_replace("time", "T", " "))
    renamed = {"temperature_2m": "temperature_c", "apparent_temperature": "apparent_temperature_c",
               "relative_humidity_2m": "relative_humidity_pct", "precipitation": "precipitation_mm",
               "wind_speed_10m": "wind_speed_kmh", "wind_gusts_10m": "wind_gusts_kmh"}
    return current(bronze, FORECAST).select(
        "bronze_id", "stadium", "team", local.alias("local_hour"),
        F.to_utc_timestamp(local.cast("timestamp"), F.col("timezone")).alias("hour_utc"),
        *[_d(c).alias(n) for c, n in renamed.items()], F.col("weather_code").try_cast("double").try_cast("int").alias("weather_code"),
        "_ingested_at")


def stg_pbp(bronze: DataFrame) -> DataFrame:
    return current(bronze, PLAYS).select(
        "bronze_id", "game_id", _d("play_id").try_cast("bigint").alias("play_id"), _i("season").alias("season"),
        _i("week").alias("nfl_week"), F.left("game_date", F.lit(10)).try_cast("date").alias("game_date"), "posteam", "defteam",
        "play_type", "passer_player_id", "rusher_player_id", "receiver_player_id",
        *[_d(c).alias(c) for c in ("epa", "qb_epa", "success", "yards_gained", "touchdown")])


def stg_snap_counts(bronze: DataFrame) -> DataFrame:
    return current(bronze, SNAP_COUNTS).select(
        "bronze_id", "game_id", "pfr_game_id", _i("season").alias("season"), _i("week").alias("nfl_week"), "game_type",
        F.col("player").alias("player_name"), "pfr_player_id", "position", "team", "opponent",
        *[e.alias(n) for side in ("offense", "defense", "st")
          for e, n in ((_d(f"{side}_snaps").try_cast("int"), f"{side}_snaps"), (_d(f"{side}_pct"), f"{side}_pct"))])


STAGING = {f.__name__: f for f in (
    stg_forcedeck, stg_catapult, stg_wellness, stg_nutrition, stg_emr_injuries, stg_emr_status_updates,
    stg_open_meteo, stg_pbp, stg_snap_counts)}


def create_views(bronze: DataFrame, prefix: str = "") -> None:
    """Register every staging projection as a temporary view: always current, never stored."""
    for name, build in STAGING.items():
        build(bronze).createOrReplaceTempView(prefix + name)
