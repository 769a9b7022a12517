"""Silver: one typed row per real-world event, every player resolved to one key.

Each builder is a pure function of Bronze, the quarantined ids, the player
master and the vendor map, and returns a ``SilverRun``: the fact rows, the
identity failures for the source's quarantine, and what the run learned.
Rebuilding from all of Bronze gives the same tables every time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from squadlake.functions import casts, units
from squadlake.functions.casts import num
from squadlake.functions.text import body_part
from squadlake.functions.units import flags
from squadlake.operators import identity
from squadlake.operators.dedup import attach_group, flag_repeats, latest_with_count
from squadlake.operators.quality import QUARANTINE_SCHEMA, identity_failures, without_quarantined
from squadlake.plans import staging
from squadlake.session import materialise
from squadlake.sources.bronze import BRONZE_SCHEMA


@dataclass
class SilverRun:
    vendor: str
    tables: dict[str, DataFrame]
    failures: DataFrame
    resolved: list[identity.Resolved]
    profile: dict[str, Column] = field(default_factory=dict)  # percentages over the main table
    timestamp_profile: Column | None = None


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def _with_candidates(found: identity.Resolved) -> tuple[DataFrame, Column]:
    """Unresolved records with the tied players as reason text."""
    arrays = identity.candidate_arrays(found.identifiers, found.index).select(
        F.col("candidate_name").alias("_cn"), F.col("candidate_team").alias("_ct"), "candidate_sks")
    rows = found.records.where("player_sk is null").join(
        arrays, (F.col("reason") == "ambiguous") & (F.col("candidate_name") == F.col("_cn"))
        & F.col("candidate_team").eqNullSafe(F.col("_ct")), "left")
    listed = F.concat(F.lit(" candidates=["), F.array_join(F.col("candidate_sks").cast("array<string>"), ", "), F.lit("]"))
    return rows, F.coalesce(listed, F.lit(""))


def accepted(bronze: DataFrame | staging.Unpacked, feed: staging.Feed, held: DataFrame) -> DataFrame:
    """Current records that passed validation.  Resolution reads them twice (their
    distinct identifiers, then the rows), so give an ``Unpacked`` frame: its current
    records are stored."""
    return without_quarantined(staging.current(bronze, feed), held)


def forcedeck(bronze: DataFrame, held: DataFrame, players: DataFrame, vendor_map: DataFrame,
              run_id: str = "manual") -> SilverRun:
    feed = staging.FORCEDECK
    rows = accepted(bronze, feed, held)
    gsis = F.col("athlete_gsis_id")
    found = identity.resolve(rows, players, vendor_map, feed.source, gsis=gsis, vid=gsis)
    raw = num(F.col("peak_force"))
    newtons, inferred = units.normalise_force(raw, F.col("force_unit"))
    tests = found.records.where("player_sk is not null").select(
        "bronze_id", "test_id", "player_sk", "resolved_by", "athlete_gsis_id",
        casts.epoch_utc(F.col("test_ts")).alias("test_ts"), "test_type", F.col("rep").try_cast("int").alias("rep"),
        num(F.col("jump_height_cm")).alias("jump_height_cm"), F.round(newtons, 2).alias("peak_force_n"),
        raw.alias("peak_force_raw"), F.col("force_unit").alias("force_unit_raw"), inferred.alias("force_unit_inferred"),
        num(F.col("rfd")).alias("rfd"), num(F.col("asymmetry_pct")).alias("asymmetry_pct"), "device_id",
        flags((inferred, "force_unit_inferred"), (~staging.has_key("device_id"), "missing_device")).alias("qc_flags"))
    failed = identity_failures(found.records.where("player_sk is null"), feed.endpoint, run_id, gsis,
                               F.concat(F.lit("player "), F.col("reason"), F.lit(": gsis_id="), _quoted(gsis)))
    return SilverRun(feed.source, {"forcedeck_tests": tests}, failed, [found],
                     {"pct_units_inferred": F.col("force_unit_inferred")})


def nutrition(bronze: DataFrame, held: DataFrame, players: DataFrame, vendor_map: DataFrame,
              run_id: str = "manual") -> SilverRun:
    feed = staging.NUTRITION
    rows = accepted(bronze, feed, held)
    found = identity.resolve(rows, players, vendor_map, feed.source, name=F.col("player_name"), team=F.col("team"))
    weight, lean_raw = num(F.col("weight")), num(F.col("lean_mass"))
    lean, was_pct = units.lean_mass(lean_raw, weight)
    mislabeled = units.weight_mislabeled(F.col("weight_unit"))
    measured = found.records.where("player_sk is not null").select(
        "bronze_id", "measurement_id", "player_sk", "resolved_by", F.col("player_name").alias("player_name_raw"), "team",
        casts.us_date(F.col("measured_on")).alias("measured_on"), "method", weight.alias("weight_lbs"),
        F.col("weight_unit").alias("weight_unit_raw"), mislabeled.alias("weight_mislabeled"),
        num(F.col("body_fat_pct")).alias("body_fat_pct"), lean.alias("lean_mass_lbs"), lean_raw.alias("lean_mass_raw"),
        was_pct.alias("lean_mass_was_pct"), "hydration_status",
        flags((mislabeled, "weight_mislabeled"), (was_pct, "lean_mass_was_pct")).alias("qc_flags"))
    unresolved, listed = _with_candidates(found)
    failed = identity_failures(unresolved, feed.endpoint, run_id, F.col("player_name"), F.concat(
        F.lit("player "), F.col("reason"), F.lit(": "), _quoted(F.col("player_name")),
        F.lit(" ("), F.coalesce("team", F.lit("None")), F.lit(")"), listed))
    return SilverRun(feed.source, {"nutrition_measurements": measured}, failed, [found])


def wellness(bronze: DataFrame, held: DataFrame, players: DataFrame, vendor_map: DataFrame,
             run_id: str = "manual") -> SilverRun:
    """Day scale: any value declared that day (the last in ingest order), else the
    cohort of the rows that passed validation; a row's own declaration overrides."""
    feed = staging.WELLNESS
    rows = accepted(bronze, feed, held)
    instant, corrected = casts.facility_local(F.col("submitted_at"))
    declared = F.nullif(F.col("scale_max").try_cast("int"), F.lit(0))
    rows = rows.withColumns({
        "_ts": instant, "tz_corrected": corrected, "_day": F.left("submitted_at", F.lit(10)), "_declared": declared,
        "_top": F.greatest(*[num(F.col(c)) for c in units.LIKERT])})
    rows = attach_group(
        rows, ["_day"], _day_top=F.max("_top"),
        _day_declared=F.max_by("_declared", F.when(F.col("_declared").isNotNull(), F.struct("_ingested_at", "bronze_id"))))
    rows = rows.withColumns({
        "_scale": F.coalesce("_declared", "_day_declared", units.day_scale(F.col("_day_top"))),
        "scale_inferred": F.col("_declared").isNull() & F.col("_day_declared").isNull()})
    nfl = F.when(staging.has_key("athlete_id"), F.col("athlete_id")).otherwise(F.col("player_id"))
    person = F.trim(F.concat(F.coalesce("first_name", F.lit("")), F.lit(" "), F.coalesce("last_name", F.lit(""))))
    rows = rows.withColumns({"_nfl": nfl, "_name": F.coalesce(F.nullif(F.col("name"), F.lit("")), person)})
    found = identity.resolve(rows, players, vendor_map, feed.source, nfl=F.col("_nfl"), vid=F.col("_nfl"),
                             name=F.col("_name"))
    ok = flag_repeats(found.records.where("player_sk is not null"), ["player_sk", "_day"], ["_ts", "bronze_id"],
                      "is_resubmission")
    surveys = ok.select(
        "bronze_id", "survey_id", "player_sk", "resolved_by", casts.whole(F.col("_nfl")).alias("vendor_nfl_id"),
        casts.local_date(F.col("_ts")).alias("survey_date"), F.col("_ts").alias("submitted_at"), "tz_corrected",
        F.when(staging.has_key("athlete_id") | staging.has_key("scale_max"), "v2").otherwise("v1").alias("schema_shape"),
        F.col("_scale").alias("scale_max"), "scale_inferred", num(F.col("sleep_hours")).alias("sleep_hours"),
        *[units.rescale(num(F.col(c)), F.col("_scale")).alias(c) for c in units.LIKERT],
        F.col("srpe").try_cast("int").alias("srpe"), "is_resubmission",
        flags((F.col("tz_corrected"), "tz_corrected"), (F.col("scale_inferred"), "scale_inferred"),
              (F.col("is_resubmission"), "resubmission")).alias("qc_flags"))
    nfl_text = F.coalesce("_nfl", F.lit("None"))
    failed = identity_failures(found.records.where("player_sk is null"), feed.endpoint, run_id, nfl_text, F.concat(
        F.lit("player "), F.col("reason"), F.lit(": nfl_id="), nfl_text, F.lit(" name="), _quoted(F.col("_name"))))
    return SilverRun(feed.source, {"wellness_surveys": surveys}, failed, [found],
                     {"pct_units_inferred": F.col("scale_inferred")})


def catapult(bronze: DataFrame, held: DataFrame, players: DataFrame, vendor_map: DataFrame,
             run_id: str = "manual") -> SilverRun:
    """Sessions carry only the vendor id; the athlete list supplies the name."""
    feed = staging.CATAPULT
    part = lambda c: F.coalesce(c, F.lit(""))
    athletes = (staging.current(bronze, staging.ATHLETES)
                .withColumn("_name", F.concat(part("first_name"), F.lit(" "), part("last_name"))))
    listed_athletes = identity.resolve(athletes, players, vendor_map, feed.source, vid=F.col("athlete_id"), name=F.col("_name"))
    rows = accepted(bronze, feed, held)
    names = athletes.select(F.col("athlete_id").alias("_aid"), "_name")
    rows = rows.join(names, F.col("player_id") == F.col("_aid"), "left").drop("_aid")
    found = identity.resolve(rows, players, vendor_map, feed.source, vid=F.col("player_id"), name=F.col("_name"))
    unit = F.col("distance_unit")
    dist, dist_inferred = units.normalise_distance(num(F.col("total_distance")), unit)
    fast, _ = units.normalise_distance(num(F.col("high_speed_distance")), unit)
    speed, speed_inferred = units.normalise_speed(num(F.col("max_speed")), F.col("speed_unit"))
    at = casts.iso_utc(F.col("session_ts"))
    sessions = found.records.where("player_sk is not null").select(
        "bronze_id", "session_id", "player_sk", "resolved_by", F.col("player_id").alias("vendor_player_id"),
        at.alias("session_ts"), casts.local_date(at).alias("session_date"), "session_type",
        F.col("duration_min").try_cast("int").alias("duration_min"), F.round(dist, 1).alias("total_distance_m"),
        F.round(fast, 1).alias("high_speed_distance_m"), unit.alias("distance_unit_raw"),
        dist_inferred.alias("distance_unit_inferred"), F.round(speed, 2).alias("max_speed_ms"),
        F.col("speed_unit").alias("speed_unit_raw"), speed_inferred.alias("speed_unit_inferred"),
        *[F.col(c).try_cast("int").alias(c) for c in ("sprint_count", "accel_count", "decel_count")],
        num(F.col("player_load")).alias("player_load"), "_ingested_at",
        flags((dist_inferred, "distance_unit_inferred"), (speed_inferred, "speed_unit_inferred")).alias("qc_flags"))
    unresolved, listed = _with_candidates(found)
    failed = identity_failures(unresolved, feed.endpoint, run_id, F.col("player_id"), F.concat(
        F.lit("player "), F.col("reason"), F.lit(": "), part("player_id"), F.lit(" = "), _quoted(F.col("_name")), listed))
    return SilverRun(feed.source, {"catapult_sessions": sessions}, failed, [found, listed_athletes],
                     {"pct_units_inferred": F.col("distance_unit_inferred") | F.col("speed_unit_inferred")},
                     timestamp_profile=~F.col("session_ts").endswith("Z"))


def emr(bronze: DataFrame, held: DataFrame, players: DataFrame, vendor_map: DataFrame,
        run_id: str = "manual") -> SilverRun:
    """Injuries, and status updates that inherit the injury's player."""
    inj_rows = accepted(bronze, staging.INJURIES, held)
    upd_rows = staging.every_row(bronze, staging.STATUS_UPDATES).withColumn("_at", casts.iso_utc(F.col("updated_at")))
    upd_rows = latest_with_count(upd_rows, ["update_id"], ["_at", "_ingested_at", "bronze_id"])
    upd_rows = materialise(without_quarantined(upd_rows, held))

    found = identity.resolve(inj_rows, players, vendor_map, "emr", name=F.col("player"), team=F.col("team"))
    last_dnp = (upd_rows.where("practice_status = 'DNP'").groupBy(F.col("injury_id").alias("_iid"))
                .agg(F.max(casts.local_date(F.col("_at"))).alias("_last_dnp")))
    part, side, side_source = body_part(F.col("body_part"), F.col("side"))
    rtp = casts.iso_date(F.nullif(F.col("expected_rtp"), F.lit("")))
    at = casts.iso_utc(F.col("event_date"))
    typed = (found.records.where("player_sk is not null")
             .withColumns({"_part": part, "_side": side, "side_source": side_source, "_rtp": rtp})
             .join(last_dnp, F.col("injury_id") == F.col("_iid"), "left"))
    written = F.lower(F.trim(F.coalesce("body_part", F.lit(""))))
    injuries = typed.select(
        "bronze_id", "injury_id", "player_sk", "resolved_by", F.col("player").alias("player_raw"), "team",
        at.alias("event_ts"), casts.local_date(at).alias("event_date"), F.col("_part").alias("body_part"),
        F.col("body_part").alias("body_part_raw"), F.col("_side").alias("side"), "side_source", "injury_type", "severity",
        F.col("_rtp").alias("expected_rtp"), casts.iso_utc(F.nullif(F.col("opened_at"), F.lit(""))).alias("opened_at"),
        flags((F.col("_part").isNull(), "body_part_unmapped"), (F.col("side_source") == "text", "side_from_text"),
              (written != F.coalesce("_part", F.lit("")), "body_part_free_text"),
              (F.col("_rtp") < F.col("_last_dnp"), "stale_expected_rtp")).alias("qc_flags"))
    inj_failed = identity_failures(found.records.where("player_sk is null"), "/v1/injuries", run_id, F.col("player"),
                                   F.concat(F.lit("player "), F.col("reason"), F.lit(": "), _quoted(F.col("player")),
                                            F.lit(" ("), F.coalesce("team", F.lit("None")), F.lit(")")))

    # An update takes its injury's outcome, resolved or not; only an update whose
    # injury is unknown is looked up by its own name, without a team.
    outcome = found.records.select(F.col("injury_id").alias("_iid"), F.col("player_sk").alias("_isk"),
                                   F.col("resolved_by").alias("_iby"), F.col("reason").alias("_ireason"))
    linked = upd_rows.join(outcome, F.col("injury_id") == F.col("_iid"), "left").withColumn("_orphan", F.col("_iid").isNull())
    lone = identity.resolve(linked.where("_orphan"), players, vendor_map, "emr", name=F.col("player"))
    tied = [c for c in linked.columns if c not in ("_iid", "_isk", "_iby", "_ireason")]
    inherited = linked.where("not _orphan").select(
        *tied, F.col("_isk").alias("player_sk"), F.col("_iby").alias("resolved_by"), F.col("_ireason").alias("reason"))
    every = inherited.unionByName(lone.records.select(*tied, "player_sk", "resolved_by", "reason"))
    correction = F.col("versions") > 1
    updates = every.where("player_sk is not null").select(
        "bronze_id", "update_id", "injury_id", "player_sk", "resolved_by", F.col("player").alias("player_raw"),
        F.col("_at").alias("updated_at"), casts.local_date(F.col("_at")).alias("update_date"), "practice_status",
        "game_status", "note", correction.alias("is_correction"),
        flags((correction, "correction_overwrite"), (F.col("_orphan"), "orphan_update")).alias("qc_flags"))
    upd_failed = identity_failures(every.where("player_sk is null"), "/v1/status_updates", run_id, F.col("player"),
                                   F.concat(F.lit("player "), F.col("reason"), F.lit(": "), _quoted(F.col("player")),
                                            F.lit(" via injury "), F.coalesce("injury_id", F.lit("None"))))
    return SilverRun("emr", {"emr_injuries": injuries, "emr_status_updates": updates},
                     inj_failed.unionByName(upd_failed), [found, lone])


BUILDERS = {"forcedeck": forcedeck, "catapult": catapult, "ams_wellness": wellness, "nutrition": nutrition, "emr": emr}

# Fact streams whose rows a source's scorecard counts.
FACT_FEEDS = {"forcedeck": (staging.FORCEDECK,), "catapult": (staging.CATAPULT,), "ams_wellness": (staging.WELLNESS,),
              "nutrition": (staging.NUTRITION,), "emr": (staging.INJURIES, staging.STATUS_UPDATES)}


TABLES = ("forcedeck_tests", "catapult_sessions", "wellness_surveys", "nutrition_measurements", "emr_injuries", "emr_status_updates")


def schemas(spark: SparkSession, players: DataFrame, vendor_map: DataFrame) -> dict[str, StructType]:
    """The fact tables' schemas, from the builders themselves over no records."""
    nothing = spark.createDataFrame([], BRONZE_SCHEMA)
    held = spark.createDataFrame([], QUARANTINE_SCHEMA).select("bronze_id")
    runs = [build(nothing, held, players, vendor_map) for build in BUILDERS.values()]
    return {name: df.schema for run in runs for name, df in run.tables.items()}
