"""Landing, staging, validation and silver over the derived feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squadlake.catalog import feeds as f
from squadlake.catalog.registry import ORACLES, query, rnd, shaped, shared, stamp
from squadlake.catalog.shapes import EV, ev, measure
from squadlake.operators import identity, quality
from squadlake.operators.dedup import dedup_counts, last_wins
from squadlake.plans import dq_views, silver, staging, suites
from squadlake.session import materialise, materialise_counted, work_folder
from squadlake.sources import bronze as b
from squadlake.sources.slices import SliceTable
from squadlake.sources.tables import TableStore
from squadlake.streaming.landing import read_parquet_stream, stream_land

RUN = "r1"


# ---------------------------------------------------------------- landing

def landed_table(t) -> b.BronzeTable:
    """A Bronze table of this query's own."""
    return b.BronzeTable(t.spark, work_folder(t.spark))


@query("hash_landing", f"""WITH {EV}, p AS (SELECT event_type, user_id, k, min(event_id) AS first_event FROM ev GROUP BY ALL)
SELECT user_id, md5('{{"event_type":"' || event_type || '","k":' || k || ',"user_id":' || user_id || '}}') AS payload_hash, '1.0' AS schema_version,
  first_event AS kept_event, row_number() OVER (PARTITION BY user_id ORDER BY first_event) AS landed_as FROM p""")
def hash_landing(t):
    """Records landed in two batches: key order does not matter, equal records collapse to
    the first one emitted, and ids follow emission."""
    flip = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("user_id", "k", "event_type"))).otherwise(
        F.to_json(F.struct("event_type", "user_id", "k")))
    rows = ev(t).select("event_id", flip.alias("payload"), b.payload_hash(flip).alias("h"))
    table = landed_table(t)
    middle = rows.agg((F.max("event_id") / 2).cast("bigint").alias("m")).first().m
    for batch, part in (("b1", rows.where(F.col("event_id") <= middle)), ("b2", rows.where(F.col("event_id") > middle))):
        table.land(part, source="s", endpoint="/e", batch_id=batch, schema_version="1.0", order=["event_id"])
    kept = rows.groupBy("h").agg(F.min("event_id").alias("kept_event"))
    user = F.get_json_object("payload", "$.user_id").cast("bigint")
    got = table.fetch("s", "/e").withColumn("user_id", user).join(kept, F.col("_payload_hash") == F.col("h"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("id"))
    return got.select("user_id", F.col("_payload_hash").alias("payload_hash"), F.col("_schema_version").alias("schema_version"), "kept_event",
                      place.alias("landed_as"))


@query("land_snapshot_unseen", f"""WITH {EV}, seen AS (SELECT DISTINCT user_id, k FROM ev WHERE d < DATE '2024-01-20')
SELECT user_id, count(*) AS new_rows FROM (SELECT DISTINCT user_id, k FROM ev) e WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = e.user_id AND s.k = e.k) GROUP BY user_id""")
def land_snapshot_unseen(t):
    """A full snapshot landed over an earlier part of it: only unseen records are new."""
    rows = ev(t).select("event_id", "d", F.to_json(F.struct("user_id", "k")).alias("payload"))
    table = landed_table(t)
    table.land(rows.where("d < DATE'2024-01-20'"), source="s", endpoint="/e", batch_id="old", order=["event_id"])
    table.land(rows, source="s", endpoint="/e", batch_id="snapshot", order=["event_id"])
    new = table.fetch("s", "/e").where("_batch_id = 'snapshot'")
    return new.groupBy(F.get_json_object("payload", "$.user_id").cast("bigint").alias("user_id")).agg(F.count("*").alias("new_rows"))


BATCHES = 10


def batch_slices(t):
    """Records of the events in ten batches by event_id, each sent along with the batch before it."""
    width = t.events.agg((F.floor(F.max("event_id") / BATCHES) + 1).alias("w")).first().w
    rows = ev(t).select("event_id", F.floor(F.col("event_id") / width).alias("slot"), F.to_json(F.struct("user_id", "k", "event_type")).alias("payload"))
    return [rows.where(F.col("slot").isin(i - 1, i)) for i in range(BATCHES)]


LANDED_FIELDS = "user_id bigint, k int, event_type string"
SLICED = f"{EV}, width AS (SELECT max(event_id) // {BATCHES} + 1 AS w FROM events)"


@query("landed_in_batches", f"""WITH {SLICED}
SELECT user_id, k, event_type, '#' || min(event_id // w) AS batch_id FROM ev, width GROUP BY user_id, k, event_type""")
def landed_in_batches(t):
    """Ten overlapping batches: a record lands with the first batch that has it.  What came
    before is looked up in the index of landed hashes, not in Bronze."""
    table = landed_table(t)
    for i, part in enumerate(batch_slices(t)):
        table.land(part, source="s", endpoint="/e", batch_id=f"#{i}", order=["event_id"])
    return table.fetch("s", "/e").select(F.from_json("payload", LANDED_FIELDS).alias("p"), F.col("_batch_id").alias("batch_id")).select("p.*", "batch_id")


@query("stream_landed", f"""WITH {EV}, first AS (SELECT user_id, k, event_type, min(event_id) AS kept_event FROM ev GROUP BY user_id, k, event_type)
SELECT user_id, k, event_type, kept_event, row_number() OVER (PARTITION BY user_id ORDER BY kept_event) AS landed_as,
  (SELECT count(*) FROM first) AS landed, CAST(0 AS BIGINT) AS landed_by_replay FROM first""")
def stream_landed(t):
    """A drop folder landed by a stream in two runs, files arriving in between; then its
    checkpoint is lost and everything comes again.  Emission order is kept, the replay lands nothing."""
    folder, table = work_folder(t.spark), landed_table(t)
    drop = f"{folder}/drop"
    half = t.events.agg(F.floor(F.max("event_id") / 2).alias("m")).first().m
    lines = ev(t).select("event_id", F.to_json(F.struct("user_id", "k", "event_type", F.col("event_id").alias("_e"))).alias("payload"))
    record = F.to_json(F.from_json("payload", LANDED_FIELDS)).alias("payload")

    def run(checkpoint: str) -> None:
        came = read_parquet_stream(t.spark, drop, "event_id bigint, payload string").select("event_id", record)
        stream_land(came, table, source="s", endpoint="/e", checkpoint=f"{folder}/{checkpoint}", order=["event_id"])

    lines.where(F.col("event_id") <= half).write.mode("append").parquet(drop)
    run("first")
    lines.where(F.col("event_id") > half).write.mode("append").parquet(drop)
    run("first")
    before = table.fetch("s", "/e").count()
    run("second")
    after = table.fetch("s", "/e").count()
    kept = ev(t).groupBy("user_id", "k", "event_type").agg(F.min("event_id").alias("kept_event"))
    rows = table.fetch("s", "/e").select("id", F.from_json("payload", LANDED_FIELDS).alias("p")).select("id", "p.*").join(kept, ["user_id", "k", "event_type"])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("id"))
    return rows.select("user_id", "k", "event_type", "kept_event", place.alias("landed_as"), F.lit(before).cast("bigint").alias("landed"),
                       F.lit(after - before).cast("bigint").alias("landed_by_replay"))


@query("fetch_projected", f"""WITH {EV} SELECT DISTINCT user_id, k FROM ev e WHERE event_id % 2 = 1
  AND NOT EXISTS (SELECT 1 FROM ev s WHERE s.event_id % 2 = 0 AND s.user_id = e.user_id AND s.k = e.k)""")
def fetch_projected(t):
    """Two streams of one source landed with only the columns that are used; one of them fetched back."""
    table = landed_table(t)
    for number, endpoint in enumerate(("/even", "/odd")):
        part = b.project_at_ingest(ev(t).where(F.col("event_id") % 2 == number), ["user_id", "k"])
        table.land(b.records_json(part), source="s", endpoint=endpoint, batch_id=endpoint)
    fields = F.from_json("payload", "user_id bigint, k int")
    return table.fetch("s", "/odd").select(fields.alias("p")).select("p.*")


@query("replace_table", """SELECT o_orderkey, CAST(o_custkey + 2 AS BIGINT) AS n FROM orders""")
def replace_table(t):
    """A table rebuilt from itself twice; readers see the last committed version."""
    store = TableStore(t.spark, work_folder(t.spark))
    store.replace("n", t.orders.select("o_orderkey", F.col("o_custkey").cast("bigint").alias("n")))
    for _ in range(2):
        store.replace("n", store.read("n").withColumn("n", F.col("n") + 1))
    return store.read("n")


@query("crosswalk_last_wins", f"""WITH {EV}, c AS (SELECT event_id, ts, user_id AS code, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '' ELSE 'p' || user_id % 40 END AS key FROM ev)
SELECT key, event_id, code FROM c WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1""")
def crosswalk_last_wins(t):
    """Crosswalk rows without a key are dropped, the most recent row per key stays."""
    key = F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 5 == 1, "").otherwise(F.concat(F.lit("p"), F.col("user_id") % 40))
    return last_wins(ev(t).withColumn("key", key), "key", ("ts", "event_id")).select("key", "event_id", F.col("user_id").alias("code"))


@query("explode_columnar", """SELECT o_orderkey, strftime(o_orderdate + to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS time, round(o_totalprice / (i + 1), 6) AS price, o_custkey AS station, 'USD' AS unit
FROM orders, (VALUES (0), (1), (2)) v(i)""")
def explode_columnar(t):
    """Array-of-columns payloads unwound to one row per position, constants repeated."""
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    packed = t.orders.select(
        "o_orderkey", F.col("o_custkey").alias("station"), F.lit("USD").alias("unit"),
        F.struct(F.array(*[day(n) for n in range(3)]).alias("time"),
                 F.array(*[F.col("o_totalprice") / (n + 1) for n in range(3)]).alias("price")).alias("h"))
    out = b.explode_columnar(packed, "time", ["price"], "h", ["o_orderkey", "station", "unit"])
    return out.select("o_orderkey", "time", rnd("price").alias("price"), "station", "unit")


@query("records_to_json", """SELECT o_orderkey, md5('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","ratio":' || coalesce(CAST(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS VARCHAR), 'null') || '}') AS payload_md5 FROM orders""")
def records_to_json(t):
    """Rows to JSON text: NaN becomes null, every other value and key is kept."""
    rows = t.orders.withColumn("ratio", F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_custkey").cast("double")))
    json = b.records_json(rows.select("o_orderkey", "o_orderpriority", "ratio"))
    return json.select(F.get_json_object("payload", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
                       F.md5(F.regexp_replace(F.to_json(F.parse_json("payload")), r"\.0}$", "}")).alias("payload_md5"))


@query("schema_versions", """WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT CASE WHEN k % 2 = 0 THEN '1.0' ELSE 'none' END AS schema_version, count(*) AS records FROM e GROUP BY ALL""")
def schema_versions(t):
    """Records per envelope version."""
    return b.schema_versions(f.forcedeck(t))


# ---------------------------------------------------------------- staging

@query("stg_forcedeck", f"""WITH {EV}, {f.FORCEDECK}
SELECT bronze_id, test_id, gsis AS athlete_gsis_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS test_ts, test_type, rep, round(jump, 6) AS jump_height_cm, round(raw, 6) AS peak_force_raw,
  unit AS force_unit, round(newtons, 6) AS peak_force_n, round(rfd, 6) AS rfd, round(asym, 6) AS asymmetry_pct, device AS device_id FROM fdn""")
def stg_forcedeck(t):
    return shaped(staging.stg_forcedeck(f.forcedeck(t)), stamps=("test_ts",), keep=("bronze_id", "test_id", "athlete_gsis_id", "test_type", "rep", "force_unit", "device_id"),
                  floats=("jump_height_cm", "peak_force_raw", "peak_force_n", "rfd", "asymmetry_pct"))


@query("stg_catapult", f"""WITH {EV}, {f.CATAPULT}
SELECT bronze_id, session_id, player_id, strftime(session_ts, '%Y-%m-%d %H:%M:%S') AS session_ts, session_type, minutes AS duration_min, du AS distance_unit, su AS speed_unit, sprints AS sprint_count,
  round(dist_m, 6) AS total_distance_m, round(fast_m, 6) AS high_speed_distance_m, round(speed_ms, 6) AS max_speed_ms, round(load, 6) AS player_load FROM can""")
def stg_catapult(t):
    return shaped(staging.stg_catapult(f.catapult(t)), stamps=("session_ts",), keep=("bronze_id", "session_id", "player_id", "session_type", "duration_min", "distance_unit", "speed_unit", "sprint_count"),
                  floats=("total_distance_m", "high_speed_distance_m", "max_speed_ms", "player_load"))


@query("stg_wellness", f"""WITH {EV}, {f.WELLNESS}
SELECT bronze_id, survey_id, nfl_id, CASE WHEN k % 2 = 0 THEN 'v2' ELSE 'v1' END AS schema_shape, strftime(local_ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS submitted_at, bogus AS tz_claimed_utc, scale_max,
  declared IS NULL AS scale_inferred, round(sleep_hours, 6) AS sleep_hours, CAST(soreness AS DOUBLE) AS soreness, CAST(mood AS DOUBLE) AS mood, srpe FROM wes""")
def stg_wellness(t):
    return shaped(staging.stg_wellness(f.wellness(t)), stamps=("submitted_at",), keep=("bronze_id", "survey_id", "nfl_id", "schema_shape", "tz_claimed_utc", "scale_max", "scale_inferred", "srpe"),
                  floats=("sleep_hours", "soreness", "mood"))


@query("stg_nutrition", f"""WITH {EV}, {f.NUTRITION}
SELECT bronze_id, measurement_id, raw_name AS player_name, team, CAST(measured_on AS VARCHAR) AS measured_on, method, round(weight, 6) AS weight_lbs, unit AS weight_unit, unit = 'kg' AS weight_mislabeled, round(fat, 6) AS body_fat_pct,
  round(lean, 6) AS lean_mass_raw, lean < 100 AS lean_mass_is_pct, hydration AS hydration_status FROM nu""")
def stg_nutrition(t):
    return shaped(staging.stg_nutrition(f.nutrition(t)), dates=("measured_on",), keep=("bronze_id", "measurement_id", "player_name", "team", "method", "weight_unit", "weight_mislabeled", "lean_mass_is_pct", "hydration_status"),
                  floats=("weight_lbs", "body_fat_pct", "lean_mass_raw"))


@query("stg_emr_injuries", f"""WITH {EV}, {f.EMR}
SELECT bronze_id, injury_id, raw_name AS player, team, strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS event_ts, CAST(d AS VARCHAR) AS event_date, body_part, side, severity, CAST(rtp AS VARCHAR) AS expected_rtp FROM ij""")
def stg_emr_injuries(t):
    return shaped(staging.stg_emr_injuries(f.emr(t)), stamps=("event_ts",), dates=("event_date", "expected_rtp"), keep=("bronze_id", "injury_id", "player", "team", "body_part", "side", "severity"))


@query("stg_emr_status_updates", f"""WITH {EV}, {f.EMR}
SELECT bronze_id, update_id, injury_id, raw_name AS player, strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS updated_at, status AS practice_status, game AS game_status FROM us""")
def stg_emr_status_updates(t):
    return shaped(staging.stg_emr_status_updates(f.emr(t)), stamps=("updated_at",), keep=("bronze_id", "update_id", "injury_id", "player", "practice_status", "game_status"))


@shared
def forecast(t):
    """Hourly readings per event type ("stadium"), re-issued with later values."""
    hour = F.date_trunc("hour", "ts")
    m = measure()
    return f.bronze(ev(t), F.struct(
        F.col("event_type").alias("stadium"), F.lit("NE").alias("team"), F.lit("America/New_York").alias("timezone"),
        F.date_format(hour, "yyyy-MM-dd'T'HH:mm").alias("time"), m.alias("temperature_2m"), (m - 1).alias("apparent_temperature"),
        F.col("k").alias("relative_humidity_2m"), (m / 10).alias("precipitation"), (m * 2).alias("wind_speed_10m"), (m * 3).alias("wind_gusts_10m"),
        (F.col("k") % 4).alias("weather_code")), "open_meteo", "forecast")


METEO_SQL = """wx AS (SELECT event_id AS bronze_id, event_type AS stadium, date_trunc('hour', ts) AS local_hour, date_trunc('hour', ts) + INTERVAL 5 HOUR AS hour_utc,
  sqrt(value + 0.003) AS temperature_c, k AS humidity, k % 4 AS code FROM ev QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1)"""


@query("stg_open_meteo", f"""WITH {EV}, {METEO_SQL}
SELECT bronze_id, stadium, 'NE' AS team, strftime(local_hour, '%Y-%m-%d %H:%M:%S') AS local_hour, strftime(hour_utc, '%Y-%m-%d %H:%M:%S') AS hour_utc, round(temperature_c, 6) AS temperature_c, round(temperature_c * 3, 6) AS wind_gusts_kmh,
  CAST(humidity AS DOUBLE) AS relative_humidity_pct, code AS weather_code FROM wx""")
def stg_open_meteo(t):
    return shaped(staging.stg_open_meteo(forecast(t)), stamps=("local_hour", "hour_utc"), keep=("bronze_id", "stadium", "team", "weather_code"), floats=("temperature_c", "wind_gusts_kmh", "relative_humidity_pct"))


@shared
def plays(t):
    m = measure()
    u = F.col("user_id")
    who = lambda cond: F.when(cond, f.c.gsis)
    return f.bronze(ev(t), F.struct(
        F.concat(F.lit("g"), F.col("d"), F.lit("-"), (u % 4)).alias("game_id"), F.concat(u, F.lit("."), F.lit("0")).alias("play_id"),
        F.lit(2024).alias("season"), F.dayofmonth("d").alias("week"), F.concat(F.col("d"), F.lit("T00:00:00.000")).alias("game_date"),
        f.c.team.alias("posteam"), F.col("event_type").alias("play_type"), who(F.col("k") % 3 == 0).alias("passer_player_id"),
        who(F.col("k") % 5 == 0).alias("rusher_player_id"), who(F.col("k") % 2 == 0).alias("receiver_player_id"),
        F.when(F.col("k") % 7 > 0, m - 8).alias("epa"), m.alias("qb_epa"), (F.col("k") % 2).alias("success"), F.col("k").alias("yards_gained"),
        F.lit(0).alias("touchdown")), "nflverse", "pbp")


@shared
def snaps(t):
    u, m = F.col("user_id"), measure()
    return f.bronze(ev(t).where("event_type IN ('view', 'purchase')"), F.struct(
        F.concat(F.lit("g"), F.col("d"), F.lit("-"), (u % 4)).alias("game_id"), F.concat(F.lit("p"), F.col("d")).alias("pfr_game_id"),
        F.lit(2024).alias("season"), F.dayofmonth("d").alias("week"), F.lit("REG").alias("game_type"), f.c.raw_name.alias("player"),
        F.concat(F.lit("Pfr"), u).alias("pfr_player_id"), F.lit("WR").alias("position"), f.c.team.alias("team"), F.lit("OPP").alias("opponent"),
        F.concat(F.col("k").cast("string"), F.lit(".0")).alias("offense_snaps"), (m / 30).alias("offense_pct"), F.lit(0).alias("defense_snaps"), F.lit(0.0).alias("defense_pct"),
        F.lit(3).alias("st_snaps"), F.lit(0.25).alias("st_pct")), "nflverse", "snap_counts")


PLAY_CTE = f"""pl AS (SELECT event_id AS bronze_id, 'g' || d || '-' || (user_id % 4) AS game_id, user_id AS play_id, day(d) AS nfl_week, d AS game_date, {f.TEAM_SQL} AS posteam,
  CASE WHEN k % 3 = 0 THEN {f.GSIS_SQL} END AS passer, CASE WHEN k % 5 = 0 THEN {f.GSIS_SQL} END AS rusher, CASE WHEN k % 2 = 0 THEN {f.GSIS_SQL} END AS receiver,
  CASE WHEN k % 7 > 0 THEN sqrt(value + 0.003) - 8 END AS epa, k % 2 AS success FROM ev QUALIFY row_number() OVER (PARTITION BY d, user_id ORDER BY ts DESC, event_id DESC) = 1),
sn AS (SELECT event_id AS bronze_id, 'g' || d || '-' || (user_id % 4) AS game_id, 'p' || d AS pfr_game_id, day(d) AS nfl_week, 'Pfr' || user_id AS pfr_player_id, {f.TEAM_SQL} AS team, k AS offense_snaps,
  sqrt(value + 0.003) / 30 AS offense_pct FROM ev WHERE event_type IN ('view', 'purchase') QUALIFY row_number() OVER (PARTITION BY d, user_id ORDER BY ts DESC, event_id DESC) = 1)"""


@query("stg_pbp", f"""WITH {EV}, {PLAY_CTE}
SELECT bronze_id, game_id, play_id, nfl_week, CAST(game_date AS VARCHAR) AS game_date, posteam, passer AS passer_player_id, rusher AS rusher_player_id, receiver AS receiver_player_id, round(epa, 6) AS epa, CAST(success AS DOUBLE) AS success FROM pl""")
def stg_pbp(t):
    return shaped(staging.stg_pbp(plays(t)), dates=("game_date",), keep=("bronze_id", "game_id", "play_id", "nfl_week", "posteam", "passer_player_id", "rusher_player_id", "receiver_player_id"), floats=("epa", "success"))


@query("stg_snap_counts", f"""WITH {EV}, {PLAY_CTE}
SELECT bronze_id, game_id, pfr_game_id, nfl_week, pfr_player_id, team, offense_snaps, round(offense_pct, 6) AS offense_pct, 3 AS st_snaps FROM sn""")
def stg_snap_counts(t):
    return shaped(staging.stg_snap_counts(snaps(t)), keep=("bronze_id", "game_id", "pfr_game_id", "nfl_week", "pfr_player_id", "team", "offense_snaps", "st_snaps"), floats=("offense_pct",))


# ---------------------------------------------------------------- validation

FEEDS = {"forcedeck": f.forcedeck, "catapult": f.catapult, "ams_wellness": f.wellness, "nutrition": f.nutrition, "emr": f.emr}


def unpacked(t, source: str) -> staging.Unpacked:
    """A feed whose current records are stored once for the query."""
    key = f"unpacked {source}"
    if key not in t.frames:
        t.frames[key] = staging.Unpacked(FEEDS[source](t))
    return t.frames[key]


def checked(t, suite) -> quality.Validation:
    """A suite against its staging projection of the stored records."""
    key = f"stored {suite.table}"
    if key not in t.frames:
        t.frames[key] = staging.STAGING[suite.table](unpacked(t, suite.source))
    return quality.Validation(t.frames[key], suite, RUN)


def held_ids(t, source: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [checked(t, s).failed_ids() for s in suites.suites_for(source)])


def stored_held_ids(t, source: str) -> DataFrame:
    """The ids of a source's held records, stored once: Silver reads them for every stream and again for its records."""
    key = f"held {source}"
    if key not in t.frames:
        t.frames[key] = materialise(held_ids(t, source))
    return t.frames[key]


def _result_sql(cte: str, checks: list[tuple[str, str, str, str]]) -> str:
    """UNION ALL of (expectation, column, failing condition, evaluated condition)."""
    rows = [f"""SELECT '{e}' AS expectation_name, '{c}' AS column_name, count(*) AS element_count, count(*) FILTER ({bad}) AS unexpected_count,
      round(100.0 * count(*) FILTER ({bad}) / nullif(count(*) FILTER ({seen}), 0), 6) AS unexpected_percent, count(*) FILTER ({bad}) = 0 AS success,
      coalesce(100.0 * count(*) FILTER ({bad}) / nullif(count(*) FILTER ({seen}), 0) >= 50, false) AS systemic FROM {cte}""" for e, c, bad, seen in checks]
    return "\nUNION ALL ".join(rows)


def _range(cte_col: str, name: str, lo, hi):
    return (quality.BETWEEN, name, f"{cte_col} NOT BETWEEN {lo} AND {hi}", f"{cte_col} IS NOT NULL")


FORCEDECK_CHECKS = [
    (quality.NOT_NULL, "test_id", "test_id IS NULL", "true"), (quality.UNIQUE, "test_id", "false", "true"),
    (quality.REGEX, "athlete_gsis_id", "NOT regexp_matches(gsis, '^00-00\\d{5}$')", "true"), (quality.NOT_NULL, "test_ts", "ts IS NULL", "true"),
    (quality.NOT_NULL, "test_type", "test_type IS NULL", "true"), (quality.IN_SET, "test_type", "test_type NOT IN ('CMJ', 'IMTP', 'DJ')", "test_type IS NOT NULL"),
    _range("rep", "rep", 1, 3), _range("jump", "jump_height_cm", 5, 90), _range("newtons", "peak_force_n", 800, 7000), _range("rfd", "rfd", 1000, 20000),
    _range("asym", "asymmetry_pct", -50, 50)]


@query("expectation_results", f"WITH {EV}, {f.FORCEDECK}\n" + _result_sql("fdn", FORCEDECK_CHECKS))
def expectation_results(t):
    """Eleven expectations in one aggregate: counts, percent, success, systemic."""
    out = checked(t, suites.FORCEDECK).results()
    return out.select("expectation_name", "column_name", "element_count", "unexpected_count", rnd("unexpected_percent").alias("unexpected_percent"), "success", "systemic")


@query("result_history", "SELECT run_id, expectation_name, column_name, element_count, unexpected_count FROM (VALUES ('r1'), ('r2')) runs(run_id), (\n"
       f"WITH {EV}, {f.FORCEDECK}\n" + _result_sql("fdn", FORCEDECK_CHECKS) + ")")
def result_history(t):
    """Results of two runs; the first run repeated replaces its own slice."""
    history = SliceTable(t.spark, work_folder(t.spark), quality.RESULT_SCHEMA, ("run_id", "source"))
    for run in ("r1", "r2", "r1"):
        history.replace(quality.Validation(checked(t, suites.FORCEDECK).source_frame, suites.FORCEDECK, run).results(), run_id=run, source="forcedeck")
    return history.read().select("run_id", "expectation_name", "column_name", "element_count", "unexpected_count")


@query("quarantine_rows", f"""WITH {EV}, {f.FORCEDECK}
SELECT bronze_id, 'test_type' AS column_name, 'test_type=null' AS observed_value, 'test_type is null: test_type=null' AS reason FROM fdn WHERE test_type IS NULL
UNION ALL SELECT bronze_id, 'rep', 'rep=' || rep, 'rep outside 1..3: rep=' || rep FROM fdn WHERE rep NOT BETWEEN 1 AND 3
UNION ALL SELECT bronze_id, 'jump_height_cm', 'jump_height_cm=' || format('{{:g}}', jump), 'jump_height_cm outside 5..90: jump_height_cm=' || format('{{:g}}', jump) FROM fdn WHERE jump NOT BETWEEN 5 AND 90
UNION ALL SELECT bronze_id, 'peak_force_n', 'peak_force_n=' || format('{{:g}}', newtons), 'peak_force_n outside 800..7000: peak_force_n=' || format('{{:g}}', newtons) FROM fdn WHERE newtons NOT BETWEEN 800 AND 7000
UNION ALL SELECT bronze_id, 'rfd', 'rfd=' || format('{{:g}}', rfd), 'rfd outside 1000..20000: rfd=' || format('{{:g}}', rfd) FROM fdn WHERE rfd NOT BETWEEN 1000 AND 20000
UNION ALL SELECT bronze_id, 'asymmetry_pct', 'asymmetry_pct=' || format('{{:g}}', asym), 'asymmetry_pct outside -50..50: asymmetry_pct=' || format('{{:g}}', asym) FROM fdn WHERE asym NOT BETWEEN -50 AND 50""")
def quarantine_rows(t):
    """One row per failed expectation, with the observed value and a readable reason."""
    return checked(t, suites.FORCEDECK).quarantine().select("bronze_id", "column_name", "observed_value", "reason")


@query("unique_and_pair_checks", """WITH c AS (SELECT l_orderkey, l_linenumber, l_orderkey * 8 + l_linenumber AS line_key, l_quantity, l_extendedprice / 2000 AS half FROM lineitem),
d AS (SELECT line_key FROM c GROUP BY 1 HAVING count(*) > 1)
SELECT 'expect_column_values_to_be_unique' AS expectation_name, (SELECT count(*) FROM c JOIN d USING (line_key)) AS unexpected_count, (SELECT count(*) FROM c) AS element_count
UNION ALL SELECT 'expect_column_pair_values_a_to_be_greater_than_b', count(*) FILTER (l_quantity < half), count(*) FROM c""")
def unique_and_pair_checks(t):
    """All members of a duplicate group fail; a pair fails when A < B."""
    suite = quality.Suite("lines", "lineitem", "lines", "lineitem", (
        quality.Expectation(quality.UNIQUE, {"column": "line_key"}),
        quality.Expectation(quality.PAIR, {"column_A": "l_quantity", "column_B": "half", "or_equal": True})))
    rows = t.lineitem.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_key"), "l_quantity",
                             (F.col("l_extendedprice") / 2000).alias("half"))
    out = quality.Validation(rows, suite, RUN, id_col="line_key").results()
    return out.select("expectation_name", "unexpected_count", "element_count")


@query("missing_column_is_systemic", """SELECT 'gone' AS column_name, false AS success, true AS systemic UNION ALL SELECT 'o_orderkey', count(*) FILTER (o_orderkey IS NULL) = 0, false FROM orders""")
def missing_column(t):
    """An expectation on a column that vanished is systemic; the others still run."""
    suite = quality.Suite("o", "orders", "o", "orders", (quality.Expectation(quality.NOT_NULL, {"column": "gone"}),
                                                         quality.Expectation(quality.NOT_NULL, {"column": "o_orderkey"})))
    return quality.Validation(t.orders, suite, RUN, id_col="o_orderkey").results().select("column_name", "success", "systemic")


def _held_sql(cte: str, n_suites: str) -> str:
    return f"""WITH {EV}, {cte} SELECT bronze_id FROM {n_suites} WHERE held"""


for _source, _cte, _frame in (("nutrition", f.NUTRITION, "nubad"), ("catapult", f.CATAPULT, "cabad"), ("ams_wellness", f.WELLNESS, "webad")):
    @query(f"quarantined_ids_{_source}", _held_sql(_cte, _frame))
    def quarantined(t, source=_source):
        """Records a feed's suites hold back."""
        return held_ids(t, source).distinct()


@query("quarantined_ids_emr", f"WITH {EV}, {f.EMR} SELECT bronze_id FROM ijbad WHERE held UNION ALL SELECT bronze_id FROM usbad WHERE held")
def quarantined_emr(t):
    """Two suites of one source."""
    return held_ids(t, "emr")


@query("quarantine_union", f"""WITH {EV}, {f.FORCEDECK}, {f.WELLNESS} SELECT 'forcedeck' AS source, count(DISTINCT bronze_id) AS records FROM fdbad WHERE held
UNION ALL SELECT 'wellness', count(DISTINCT bronze_id) FROM webad WHERE held""")
def quarantine_union(t):
    """Quarantines of several sources under one label column."""
    both = dq_views.quarantine_all({"forcedeck": checked(t, suites.FORCEDECK).quarantine(), "wellness": checked(t, suites.WELLNESS).quarantine()})
    return both.groupBy("source").agg(F.count_distinct("bronze_id").alias("records"))


HELD = {"forcedeck": ("fdbad",), "catapult": ("cabad",), "ams_wellness": ("webad",), "nutrition": ("nubad",), "emr": ("ijbad", "usbad")}
ALL_FEEDS = f"{f.FORCEDECK}, {f.CATAPULT}, {f.WELLNESS}, {f.NUTRITION}, {f.EMR}"


@query("quarantine_union_rows", f"WITH {EV}, {ALL_FEEDS}\n" + "\nUNION ALL ".join(
    f"SELECT '{source}' AS source, bronze_id FROM {frame} WHERE held" for source, frames in HELD.items() for frame in frames))
def quarantine_union_rows(t):
    """The quarantined records of all five sources under one label column."""
    by_source = {source: reduce(DataFrame.unionByName, [checked(t, s).quarantine() for s in suites.suites_for(source)]) for source in FEEDS}
    return dq_views.quarantine_all(by_source).select("source", "bronze_id").distinct()


def _by_run_sql() -> str:
    rows = "\nUNION ALL ".join(f"SELECT '{source}' AS source, bronze_id FROM {frame} WHERE held" for source, frames in HELD.items() for frame in frames)
    return f"WITH {EV}, {ALL_FEEDS}, q AS ({rows}) SELECT run_id, source, bronze_id FROM q, (VALUES ('r1'), ('r2')) runs(run_id) WHERE run_id = 'r1' OR source <> 'emr'"


@query("quarantine_by_run", _by_run_sql())
def quarantine_by_run(t):
    """The quarantine of two runs over all five sources, a slice for each run and source.  The
    first run saw half the records and is repeated over all; the second loses a source's slice again."""
    table = SliceTable(t.spark, work_folder(t.spark), quality.QUARANTINE_SCHEMA + ", source string", ("run_id", "source"))
    half = t.events.agg(F.floor(F.max("event_id") / 2).alias("m")).first().m
    held = {source: materialise(reduce(DataFrame.unionByName, [checked(t, s).quarantine() for s in suites.suites_for(source)])) for source in FEEDS}
    for run, part in (("r1", F.col("bronze_id") <= half), ("r2", F.lit(True)), ("r1", F.lit(True))):
        for source in FEEDS:
            table.replace(held[source].where(part), run_id=run, source=source)
    table.replace(held["emr"].where("false"), run_id="r2", source="emr")
    return table.read().select("run_id", "source", "bronze_id").distinct()


# ---------------------------------------------------------------- identity

@query("name_key", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'robert' WHEN c_custkey % 3 = 1 THEN 'michael' ELSE 'jose' END || ' o' || lower(c_mktsegment) || c_nationkey AS clean FROM customer""")
def name_key(t):
    """Spelling variants of one name collapse to one key: case, accents, comma order, suffix, nickname."""
    from squadlake.functions.text import clean_name
    k, last = F.col("c_custkey"), F.concat(F.lit("O'"), F.col("c_mktsegment"), F.col("c_nationkey"))
    spelled = (F.when(k % 3 == 0, F.concat(last, F.lit(" III,  Robert "))).when(k % 3 == 1, F.concat(F.lit("MIKE   "), last, F.lit(" Jr.")))
               .otherwise(F.concat(F.lit("José "), last)))
    return t.customer.select("c_custkey", clean_name(spelled).alias("clean"))


@query("split_names", """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS rest FROM part""")
def split_names(t):
    """First token and the rest."""
    from squadlake.functions.text import split_name
    first, rest = split_name(F.col("p_name"))
    return t.part.select("p_partkey", first.alias("first"), rest.alias("rest"))


def mixed_records(t):
    """Events as records of one vendor that carry different identifiers by type."""
    e = ev(t).withColumn("bronze_id", F.col("event_id"))
    kind = F.col("event_type")
    return e, dict(gsis=F.when(kind == "purchase", f.c.gsis), nfl=F.when(kind == "click", F.concat((F.col("user_id") + 1000).cast("string"), F.lit(".0"))),
                   vid=F.when(kind == "view", f.c.cat_id), name=F.when(kind != "error", f.c.raw_name), team=F.when(kind == "signup", F.lower(f.c.team)))


RESOLVE_SQL = f"""rec AS (SELECT e.event_id, e.user_id, e.event_type, CASE WHEN event_type <> 'error' THEN {f.NAME_SQL.replace('user_id', 'e.user_id')} ELSE '' END AS clean,
    CASE WHEN event_type = 'signup' THEN {f.TEAM_SQL.replace('user_id', 'e.user_id')} END AS team, m1.player_sk AS s1, m2.player_sk AS s2, vm.player_sk AS s3 FROM ev e
    LEFT JOIN mas m1 ON e.event_type = 'purchase' AND m1.user_id = e.user_id LEFT JOIN mas m2 ON e.event_type = 'click' AND m2.user_id = e.user_id
    LEFT JOIN vm ON e.event_type = 'view' AND vm.vid = {f.CAT_SQL.replace('user_id', 'e.user_id')}),
nm AS ({f.name_rule('rec')}),
res AS (SELECT event_id, user_id, event_type, coalesce(s1, s2, s3, player_sk) AS player_sk, CASE WHEN s1 IS NOT NULL THEN 'gsis_id' WHEN s2 IS NOT NULL THEN 'nfl_id' WHEN s3 IS NOT NULL THEN 'vendor_map' ELSE resolved_by END AS resolved_by,
    CASE WHEN coalesce(s1, s2, s3) IS NULL THEN reason END AS reason, CASE WHEN coalesce(s1, s2, s3) IS NULL THEN n_candidates ELSE 0 END AS n_candidates FROM nm),
resc AS (SELECT *, CASE resolved_by WHEN 'gsis_id' THEN 1.0 WHEN 'nfl_id' THEN 1.0 WHEN 'vendor_map' THEN 0.75 WHEN 'name_team' THEN 0.9 WHEN 'name_unique' THEN 0.75 END AS confidence FROM res)"""


@shared
def resolved(t):
    rows, ids = mixed_records(t)
    return identity.resolve(rows, f.master(t), f.vendor_map(t), "catapult", **ids)


@query("resolve_cascade", f"""WITH {EV}, {f.MASTER}, {RESOLVE_SQL}
SELECT event_id, player_sk, resolved_by, CAST(confidence AS DOUBLE) AS confidence, reason, n_candidates FROM resc""")
def resolve_cascade(t):
    """All six rules over records with mixed identifiers, one pass over the distinct identifiers."""
    return resolved(t).records.select("event_id", "player_sk", "resolved_by", rnd("confidence").alias("confidence"), "reason", "n_candidates")


@query("resolution_methods", f"""WITH {EV}, {f.MASTER}, {RESOLVE_SQL} SELECT resolved_by, count(*) AS records FROM resc GROUP BY ALL""")
def resolution_methods(t):
    """Records per method."""
    return identity.method_counts(resolved(t).identifiers)


VID_SQL = f"""vid AS (SELECT r.*, CASE WHEN r.event_type = 'view' THEN {f.CAT_SQL.replace('user_id', 'e.user_id')} WHEN r.event_type <> 'error' THEN {f.RAW_SQL.replace('user_id', 'e.user_id')} END AS vid FROM resc r JOIN ev e USING (event_id))"""


@query("vendor_pins", f"""WITH {EV}, {f.MASTER}, {RESOLVE_SQL}, {VID_SQL}
SELECT vid AS vendor_player_id, player_sk, resolved_by, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT * FROM vid WHERE player_sk IS NOT NULL AND vid IS NOT NULL AND resolved_by <> 'vendor_map'
  AND vid NOT IN (SELECT vid FROM vm) QUALIFY row_number() OVER (PARTITION BY vid ORDER BY event_id DESC) = 1)""")
def vendor_pins(t):
    """New (vendor id -> player) pins of the run."""
    out = identity.new_pins(resolved(t), f.vendor_map(t), "catapult")
    return out.select("vendor_player_id", "player_sk", "resolved_by", rnd("confidence").alias("confidence"))


@query("merged_pins", f"""WITH {EV}, {f.MASTER}, seen AS (SELECT DISTINCT {f.CAT_SQL} AS vid, user_id + 1 AS player_sk FROM ev WHERE event_type = 'purchase')
SELECT coalesce(vm.vid, seen.vid) AS vendor_player_id, coalesce(vm.player_sk, seen.player_sk) AS player_sk, CASE WHEN vm.vid IS NULL THEN '2024-02-01' ELSE '2023-12-31' END AS first_seen,
  CASE WHEN seen.vid IS NULL THEN '2023-12-31' ELSE '2024-02-01' END AS last_seen FROM vm FULL JOIN seen ON seen.vid = vm.vid""")
def merged_pins(t):
    """Insert new pins, touch known ones."""
    known = f.vendor_map(t).where("vendor = 'catapult'")
    pins = ev(t).where("event_type = 'purchase'").select(
        F.lit("catapult").alias("vendor"), f.c.cat_id.alias("vendor_player_id"), (F.col("user_id") + 1).alias("player_sk"),
        F.lit("gsis_id").alias("resolved_by"), F.lit(1.0).alias("confidence")).distinct()
    out = identity.merge_pins(known, pins, F.lit("2024-02-01").cast("timestamp"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("vendor_player_id", "player_sk", day("first_seen"), day("last_seen"))


@query("identity_quarantine", f"""WITH {EV}, {f.MASTER}, {RESOLVE_SQL}, {VID_SQL}
SELECT coalesce(vid, '') AS vendor_player_id, reason, count(*) AS occurrences, min(event_id) AS example_bronze_id FROM vid WHERE player_sk IS NULL GROUP BY ALL""")
def identity_quarantine(t):
    """Identifiers that could not be pinned: how often, and one example."""
    out = identity.identity_quarantine(resolved(t), "catapult", with_candidates=False)
    return out.select("vendor_player_id", "reason", "occurrences", "example_bronze_id")


@query("ambiguous_candidates", f"""WITH {EV}, {f.MASTER}, {RESOLVE_SQL}, amb AS (SELECT DISTINCT n.clean, CASE WHEN nt.n > 1 THEN n.team END AS team FROM nm n LEFT JOIN nt ON nt.clean = n.clean AND nt.team = n.team
  JOIN resc r ON r.event_id = n.event_id WHERE r.reason = 'ambiguous')
SELECT amb.clean AS candidate_name, amb.team AS candidate_team, string_agg(DISTINCT CAST(a.player_sk AS VARCHAR), ',' ORDER BY CAST(a.player_sk AS VARCHAR)) AS candidates, count(DISTINCT a.player_sk) AS n FROM amb JOIN ali a ON a.clean = amb.clean AND (amb.team IS NULL OR a.team = amb.team) GROUP BY ALL""")
def ambiguous_candidates(t):
    """The tied players of each ambiguous name."""
    r = resolved(t)
    out = identity.candidate_arrays(r.identifiers, r.index)
    text = F.array_join(F.sort_array(F.col("candidate_sks").cast("array<string>")), ",")
    return out.select("candidate_name", "candidate_team", text.alias("candidates"), F.size("candidate_sks").cast("bigint").alias("n"))


@query("resolution_by_method", f"""WITH {EV}, {f.MASTER} SELECT vendor, 'name_unique' AS resolved_by, count(*) AS identifiers, 0.75::DOUBLE AS avg_confidence FROM vm, (VALUES ('catapult'), ('nutrition')) v(vendor) GROUP BY ALL""")
def resolution_by_method(t):
    """Identifiers per vendor and establishing method."""
    return dq_views.resolution_by_method(f.vendor_map(t))


# ---------------------------------------------------------------- silver

def build(t, source: str) -> silver.SilverRun:
    return silver.BUILDERS[source](unpacked(t, source), stored_held_ids(t, source), f.master(t), f.vendor_map(t), RUN)


def counted_build(t, source: str) -> dict[str, int]:
    """Silver of a source with its counts, each taken while its rows are written."""
    rows = {"n": F.count(F.lit(1))}
    feeds = unpacked(t, source)
    held, n_held = materialise_counted(held_ids(t, source), **rows)
    run = silver.BUILDERS[source](feeds, held, f.master(t), f.vendor_map(t), RUN)
    written = [materialise_counted(table, **rows)[1]["n"] for table in run.tables.values()]
    _, failed = materialise_counted(run.failures.select("bronze_id"), **rows)
    seen = [feeds.counts(feed) for feed in silver.FACT_FEEDS[source]]
    came, kept = (sum(n[c] for n in seen) for c in ("rows_in", "rows_kept"))
    return {"rows_in": came, "duplicates_removed": came - kept, "rows_quarantined_dq": n_held["n"],
            "rows_quarantined_identity": failed["n"], "rows_in_silver": sum(written)}


def flags_text(c="qc_flags"):
    return F.array_join(c, ",").alias(c)


@query("silver_forcedeck", f"""WITH {EV}, {f.FORCEDECK}, {f.MASTER}
SELECT b.bronze_id, b.test_id, m.player_sk, 'gsis_id' AS resolved_by, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS test_ts, round(newtons, 2) AS peak_force_n, round(raw, 6) AS peak_force_raw,
  unit IS DISTINCT FROM CASE WHEN raw < 1500 THEN 'lbf' ELSE 'N' END AS force_unit_inferred,
  concat_ws(',', CASE WHEN unit IS DISTINCT FROM CASE WHEN raw < 1500 THEN 'lbf' ELSE 'N' END THEN 'force_unit_inferred' END, CASE WHEN device IS NULL THEN 'missing_device' END) AS qc_flags
FROM fdbad b JOIN mas m ON m.gsis_id = b.gsis WHERE NOT held""")
def silver_forcedeck(t):
    """Force-plate tests: newtons by magnitude, flags, league-id resolution."""
    out = build(t, "forcedeck").tables["forcedeck_tests"]
    return out.select("bronze_id", "test_id", "player_sk", "resolved_by", stamp("test_ts").alias("test_ts"), rnd("peak_force_n").alias("peak_force_n"),
                      rnd("peak_force_raw").alias("peak_force_raw"), "force_unit_inferred", flags_text())


@query("silver_nutrition", f"""WITH {EV}, {f.NUTRITION}, {f.MASTER}, ok AS (SELECT * FROM nubad WHERE NOT held), r AS ({f.name_rule('ok')})
SELECT bronze_id, measurement_id, player_sk, resolved_by, CAST(measured_on AS VARCHAR) AS measured_on, round(weight, 6) AS weight_lbs, coalesce(unit = 'kg', false) AS weight_mislabeled,
  round(CASE WHEN lean < 100 THEN weight * lean / 100 ELSE lean END, 2) AS lean_mass_lbs, lean < 100 AS lean_mass_was_pct,
  concat_ws(',', CASE WHEN unit = 'kg' THEN 'weight_mislabeled' END, CASE WHEN lean < 100 THEN 'lean_mass_was_pct' END) AS qc_flags FROM r WHERE player_sk IS NOT NULL""")
def silver_nutrition(t):
    """Body composition: name resolution, pounds whatever the label says, percent lean mass converted."""
    out = build(t, "nutrition").tables["nutrition_measurements"]
    return out.select("bronze_id", "measurement_id", "player_sk", "resolved_by", F.col("measured_on").cast("string").alias("measured_on"), rnd("weight_lbs").alias("weight_lbs"),
                      "weight_mislabeled", rnd("lean_mass_lbs").alias("lean_mass_lbs"), "lean_mass_was_pct", flags_text())


WELL_SCALE = f"""ok AS (SELECT * FROM webad WHERE NOT held),
sc AS (SELECT *, max(greatest(sleep_quality, soreness, fatigue, stress, mood)) OVER (PARTITION BY d) AS top_answer,
  arg_max(declared, CASE WHEN declared IS NOT NULL THEN ts END) OVER (PARTITION BY d) AS day_declared FROM ok),
sv AS (SELECT *, coalesce(declared, day_declared, CASE WHEN top_answer > 5 THEN 10 ELSE 5 END) AS scale, declared IS NULL AND day_declared IS NULL AS inferred FROM sc)"""


@query("silver_wellness", f"""WITH {EV}, {f.WELLNESS}, {f.MASTER}, {WELL_SCALE}, rs AS (SELECT sv.*, sv.scale AS sc_max, CASE WHEN m.player_sk IS NOT NULL THEN m.player_sk END AS n_sk, {f.sql_pick(f.CLEAN, 'sv.user_id % 7')} || ' smith' || (sv.user_id // 20) AS clean FROM sv LEFT JOIN mas m ON m.nfl_id = sv.nfl_id),
r AS (SELECT x.*, coalesce(x.n_sk, CASE WHEN nn.n = 1 THEN nn.sk END) AS player_sk, CASE WHEN x.n_sk IS NOT NULL THEN 'nfl_id' ELSE 'name_unique' END AS resolved_by FROM rs x LEFT JOIN nn ON nn.clean = x.clean),
z AS (SELECT *, row_number() OVER (PARTITION BY player_sk, d ORDER BY local_ts, bronze_id) > 1 AS again FROM r WHERE player_sk IS NOT NULL)
SELECT bronze_id, survey_id, player_sk, resolved_by, CAST(d AS VARCHAR) AS survey_date, strftime(local_ts + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS submitted_at, bogus AS tz_corrected, sc_max AS scale_max, inferred AS scale_inferred,
  round(CASE WHEN sc_max = 10 THEN soreness ELSE 1 + (soreness - 1) * 9 / (sc_max - 1) END, 2) AS soreness, srpe, again AS is_resubmission,
  concat_ws(',', CASE WHEN bogus THEN 'tz_corrected' END, CASE WHEN inferred THEN 'scale_inferred' END, CASE WHEN again THEN 'resubmission' END) AS qc_flags FROM z""")
def silver_wellness(t):
    """Surveys: drifted shapes, facility-local stamps, day scale, resubmissions."""
    out = build(t, "ams_wellness").tables["wellness_surveys"]
    return out.select("bronze_id", "survey_id", "player_sk", "resolved_by", F.col("survey_date").cast("string").alias("survey_date"), stamp("submitted_at").alias("submitted_at"),
                      "tz_corrected", "scale_max", "scale_inferred", rnd("soreness").alias("soreness"), "srpe", "is_resubmission", flags_text())


@query("silver_catapult", f"""WITH {EV}, {f.CATAPULT}, {f.MASTER}, ath AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'signup'),
ok AS (SELECT c.*, CASE WHEN a.user_id IS NOT NULL THEN {f.sql_pick(f.CLEAN, 'c.user_id % 7')} || ' smith' || (c.user_id // 20) ELSE '' END AS clean FROM cabad c LEFT JOIN ath a ON a.user_id = c.user_id WHERE NOT held),
r AS (SELECT ok.*, coalesce(vm.player_sk, CASE WHEN nn.n = 1 THEN nn.sk END) AS player_sk, CASE WHEN vm.player_sk IS NOT NULL THEN 'vendor_map' ELSE 'name_unique' END AS resolved_by FROM ok LEFT JOIN vm ON vm.vid = ok.player_id LEFT JOIN nn ON nn.clean = ok.clean)
SELECT bronze_id, session_id, player_sk, resolved_by, strftime(session_ts, '%Y-%m-%d %H:%M:%S') AS session_ts, CAST(CAST(session_ts - INTERVAL 5 HOUR AS DATE) AS VARCHAR) AS session_date, round(dist_m, 1) AS total_distance_m,
  round(speed_ms, 2) AS max_speed_ms, round(load, 6) AS player_load, concat_ws(',', CASE WHEN du IS NULL THEN 'distance_unit_inferred' END,
  CASE WHEN su IS DISTINCT FROM CASE WHEN speed > 12 THEN 'mph' ELSE 'm/s' END THEN 'speed_unit_inferred' END) AS qc_flags FROM r WHERE player_sk IS NOT NULL""")
def silver_catapult(t):
    """Sessions: athlete names, vendor map, unit inference, local date."""
    out = build(t, "catapult").tables["catapult_sessions"]
    return out.select("bronze_id", "session_id", "player_sk", "resolved_by", stamp("session_ts").alias("session_ts"), F.col("session_date").cast("string").alias("session_date"),
                      rnd("total_distance_m").alias("total_distance_m"), rnd("max_speed_ms").alias("max_speed_ms"), rnd("player_load").alias("player_load"), flags_text())


EMR_SILVER = f"""iok AS (SELECT * FROM ijbad WHERE NOT held), ir AS ({f.name_rule('iok')}),
uok AS (SELECT u.*, ir.bronze_id IS NULL AS orphan, ir.player_sk AS isk, ir.resolved_by AS iby FROM usbad u LEFT JOIN ir ON ir.injury_id = u.injury_id WHERE NOT u.held),
ulone AS (SELECT uok.*, CASE WHEN nn.n = 1 THEN nn.sk END AS lsk FROM uok LEFT JOIN nn ON nn.clean = uok.clean),
ur AS (SELECT *, CASE WHEN orphan THEN lsk ELSE isk END AS player_sk, CASE WHEN orphan THEN CASE WHEN lsk IS NULL THEN 'unresolved' ELSE 'name_unique' END ELSE iby END AS resolved_by FROM ulone),
dnp AS (SELECT injury_id, max(d) AS last_dnp FROM usbad WHERE NOT held AND status = 'DNP' GROUP BY ALL)"""


@query("silver_emr_injuries", f"""WITH {EV}, {f.EMR}, {f.MASTER}, {EMR_SILVER},
p AS (SELECT ir.*, dnp.last_dnp, list_extract(['hamstring', 'hamstring', 'knee', 'ankle', 'shoulder', 'concussion', NULL, 'knee'], CAST(k % 8 AS INTEGER) + 1) AS part,
  coalesce(side, list_extract([NULL, NULL, 'L', 'R', 'L', NULL, NULL, 'R'], CAST(k % 8 AS INTEGER) + 1)) AS final_side FROM ir LEFT JOIN dnp USING (injury_id) WHERE player_sk IS NOT NULL)
SELECT bronze_id, injury_id, player_sk, resolved_by, CAST(d AS VARCHAR) AS event_date, part AS body_part, body_part AS body_part_raw, final_side AS side,
  CASE WHEN side IS NOT NULL THEN 'field' WHEN final_side IS NOT NULL THEN 'text' END AS side_source, CAST(rtp AS VARCHAR) AS expected_rtp,
  concat_ws(',', CASE WHEN part IS NULL THEN 'body_part_unmapped' END, CASE WHEN side IS NULL AND final_side IS NOT NULL THEN 'side_from_text' END,
    CASE WHEN lower(body_part) <> coalesce(part, '') THEN 'body_part_free_text' END, CASE WHEN rtp < last_dnp THEN 'stale_expected_rtp' END) AS qc_flags FROM p""")
def silver_emr_injuries(t):
    """Injuries: free-text parts and sides, stale return dates."""
    out = build(t, "emr").tables["emr_injuries"]
    return out.select("bronze_id", "injury_id", "player_sk", "resolved_by", *[F.col(c).cast("string").alias(c) for c in ("event_date", "expected_rtp")],
                      "body_part", "body_part_raw", "side", "side_source", flags_text())


@query("silver_emr_status_updates", f"""WITH {EV}, {f.EMR}, {f.MASTER}, {EMR_SILVER}
SELECT bronze_id, update_id, injury_id, player_sk, resolved_by, CAST(d AS VARCHAR) AS update_date, status AS practice_status, game AS game_status, versions > 1 AS is_correction,
  concat_ws(',', CASE WHEN versions > 1 THEN 'correction_overwrite' END, CASE WHEN orphan THEN 'orphan_update' END) AS qc_flags FROM ur WHERE player_sk IS NOT NULL""")
def silver_emr_updates(t):
    """Status updates: latest event time, the injury's player, orphans by name."""
    out = build(t, "emr").tables["emr_status_updates"]
    return out.select("bronze_id", "update_id", "injury_id", "player_sk", "resolved_by", F.col("update_date").cast("string").alias("update_date"),
                      "practice_status", "game_status", "is_correction", flags_text())


@query("reconcile", f"""WITH {EV}, {f.FORCEDECK}, {f.MASTER}, c AS (SELECT (SELECT count(*) FROM ev) AS rows_in, (SELECT count(*) FROM fd) AS kept, count(*) FILTER (held) AS dq, count(*) FILTER (NOT held AND m.player_sk IS NULL) AS ident,
  count(*) FILTER (NOT held AND m.player_sk IS NOT NULL) AS out_rows FROM fdbad b LEFT JOIN mas m ON m.gsis_id = b.gsis)
SELECT 'forcedeck' AS source, rows_in, rows_in - kept AS duplicates_removed, dq AS rows_quarantined_dq, ident AS rows_quarantined_identity, out_rows AS rows_in_silver, dq + ident AS rows_quarantined, true AS reconciles FROM c""")
def reconcile(t):
    """Rows in, minus duplicates and quarantined, equals rows out."""
    run = build(t, "forcedeck")
    counted = dedup_counts(staging.unpack(f.forcedeck(t), staging.FORCEDECK), ["test_id"]).select("rows_in", "duplicates_removed")
    n = lambda df: df.agg(F.count("*").alias("v")).scalar()
    line = counted.withColumns({"source": F.lit("forcedeck"), "rows_quarantined_dq": n(stored_held_ids(t, "forcedeck")),
                                "rows_quarantined_identity": n(run.failures), "rows_in_silver": n(run.tables["forcedeck_tests"])})
    return quality.summarise(line, RUN, F.lit(None)).drop("run_id", "created_at")


@query("profile_percentages", f"""WITH {EV}, {f.CATAPULT} SELECT round(100.0 * count(*) FILTER (du IS NULL OR su IS DISTINCT FROM CASE WHEN speed > 12 THEN 'mph' ELSE 'm/s' END) / count(*), 2) AS pct_units_inferred,
  round(100.0 * count(*) FILTER (k % 10 = 0) / count(*), 2) AS pct_timestamps_reformatted FROM ca""")
def profile_percentages(t):
    """Share of rows whose units were inferred and whose stamps are not in UTC form."""
    from squadlake.functions import units
    from squadlake.functions.casts import num, pct
    rows = staging.current(f.catapult(t), staging.CATAPULT)
    _, d = units.normalise_distance(num(F.col("total_distance")), F.col("distance_unit"))
    _, v = units.normalise_speed(num(F.col("max_speed")), F.col("speed_unit"))
    return rows.agg(pct(F.count_if(d | v), F.count("*")).alias("pct_units_inferred"),
                    pct(F.count_if(~F.col("session_ts").endswith("Z")), F.count("*")).alias("pct_timestamps_reformatted"))


SILVER = {"forcedeck": ("silver_forcedeck",), "catapult": ("silver_catapult",), "ams_wellness": ("silver_wellness",), "nutrition": ("silver_nutrition",),
          "emr": ("silver_emr_injuries", "silver_emr_status_updates")}


def _reconciled_sql(source: str) -> str:
    held = " + ".join(f"(SELECT count(*) FILTER (held) FROM {frame})" for frame in HELD[source])
    kept = " + ".join(f"(SELECT count(*) FROM {frame})" for frame in HELD[source])
    out = " + ".join(f"(SELECT count(*) FROM ({ORACLES[name]}))" for name in SILVER[source])
    return f"SELECT '{source}' AS source, (SELECT count(*) FROM ev) AS rows_in, {kept} AS kept, {held} AS dq, {out} AS out_rows"


@query("reconcile_sources", f"WITH {EV}, {ALL_FEEDS}, c AS (" + "\nUNION ALL ".join(_reconciled_sql(source) for source in FEEDS) + """)
SELECT source, rows_in, rows_in - kept AS duplicates_removed, dq AS rows_quarantined_dq, kept - dq - out_rows AS rows_quarantined_identity, out_rows AS rows_in_silver,
  kept - out_rows AS rows_quarantined, true AS reconciles FROM c""")
def reconcile_sources(t):
    """A line for each of the five sources: rows in, minus duplicates and quarantined, equals rows out."""
    lines = [counted_build(t, source) for source in FEEDS]
    names = ("rows_in", "duplicates_removed", "rows_quarantined_dq", "rows_quarantined_identity", "rows_in_silver")
    counts = t.spark.createDataFrame([(source, *(line[n] for n in names)) for source, line in zip(FEEDS, lines)],
                                     "source string, " + ", ".join(f"{n} bigint" for n in names))
    return quality.summarise(counts, RUN, F.lit(None)).drop("run_id", "created_at")


INFERRED = {"forcedeck": "force_unit_inferred", "catapult": "contains(qc_flags, 'unit_inferred')", "ams_wellness": "scale_inferred"}


def _profile_sql(source: str) -> str:
    share = f"round(100.0 * count(*) FILTER ({INFERRED[source]}) / count(*), 2)" if source in INFERRED else "0.0::DOUBLE"
    stamps = "(SELECT round(100.0 * count(*) FILTER (k % 10 = 0) / count(*), 2) FROM cabad WHERE NOT held)" if source == "catapult" else "100.0::DOUBLE"
    return f"SELECT '{source}' AS source, {share} AS pct_units_inferred, {stamps} AS pct_timestamps_reformatted" + (f" FROM ({ORACLES[SILVER[source][0]]})" if source in INFERRED else "")


@query("profile_percentages_sources", f"WITH {EV}, {f.CATAPULT}\n" + "\nUNION ALL ".join(_profile_sql(source) for source in FEEDS))
def profile_percentages_sources(t):
    """A line for each of the five sources, as a daily run counts them: shares of the main
    table's rows with inferred units, and of the valid records' stamps that are not in UTC form."""
    from squadlake.functions.casts import pct
    lines = []
    for source in FEEDS:
        run = build(t, source)
        inferred = run.profile.get("pct_units_inferred")
        share = F.lit(0.0) if inferred is None else pct(F.count_if(inferred), F.count("*"))
        stamps = F.lit(100.0)
        if run.timestamp_profile is not None:
            valid = quality.without_quarantined(staging.current(unpacked(t, source), silver.FACT_FEEDS[source][0]), stored_held_ids(t, source))
            stamps = valid.agg(pct(F.count_if(run.timestamp_profile), F.count("*")).alias("v")).scalar()
        main = next(iter(run.tables.values()))
        lines.append(main.agg(share.alias("pct_units_inferred")).select(F.lit(source).alias("source"), "pct_units_inferred", stamps.alias("pct_timestamps_reformatted")))
    return reduce(DataFrame.unionByName, lines)


# ---------------------------------------------------------------- plays and weather

@query("role_unpivot_sums", f"""WITH {EV}, {PLAY_CTE}, {f.MASTER}, pm AS (SELECT player_sk, gsis_id, 'Pfr' || user_id AS pfr FROM mas),
rl AS (SELECT game_id, game_date, nfl_week, posteam, passer AS g, 'pass' AS role, epa, success FROM pl WHERE passer IS NOT NULL UNION ALL SELECT game_id, game_date, nfl_week, posteam, rusher, 'rush', epa, success FROM pl WHERE rusher IS NOT NULL
  UNION ALL SELECT game_id, game_date, nfl_week, posteam, receiver, 'receive', epa, success FROM pl WHERE receiver IS NOT NULL),
ep AS (SELECT game_id, nfl_week, posteam, player_sk, count(*) AS plays, sum(epa) AS tot, sum(epa) FILTER (role = 'pass') AS ep_pass, sum(epa) FILTER (role = 'rush') AS ep_rush, sum(epa) FILTER (role = 'receive') AS ep_rec, avg(success) AS sr FROM rl JOIN pm ON pm.gsis_id = rl.g GROUP BY ALL),
sc AS (SELECT sn.*, player_sk FROM sn JOIN pm ON pm.pfr = sn.pfr_player_id)
SELECT coalesce(ep.player_sk, sc.player_sk) AS player_sk, coalesce(ep.game_id, sc.game_id) AS game_id, CAST(CAST(substr(coalesce(ep.game_id, sc.game_id), 2, 10) AS DATE) AS VARCHAR) AS game_date,
  CAST(date_diff('day', DATE '2024-01-01', CAST(substr(coalesce(ep.game_id, sc.game_id), 2, 10) AS DATE)) // 7 + 1 AS INTEGER) AS season_week, coalesce(ep.nfl_week, sc.nfl_week) AS nfl_week, coalesce(ep.posteam, sc.team) AS team,
  coalesce(plays, 0) AS plays, round(tot, 6) AS epa_total, round(ep_pass, 6) AS epa_pass, round(ep_rush, 6) AS epa_rush, round(ep_rec, 6) AS epa_receive, round(sr, 6) AS success_rate, offense_snaps, round(offense_pct, 6) AS offense_pct
FROM ep FULL JOIN sc ON sc.player_sk = ep.player_sk AND sc.game_id = ep.game_id""")
def role_unpivot_sums(t):
    """Plays unpivoted by role, summed per player and game, full outer joined to snap counts."""
    return shaped(play_fact(t), dates=("game_date",), keep=("player_sk", "game_id", "season_week", "nfl_week", "team", "plays", "offense_snaps"),
                  floats=("epa_total", "epa_pass", "epa_rush", "epa_receive", "success_rate", "offense_pct"))


@shared
def play_fact(t):
    from squadlake.catalog.shapes import calendar
    from squadlake.plans import facts
    who = f.master(t).withColumn("pfr_id", F.concat(F.lit("Pfr"), F.col("player_sk") - 1))
    return facts.fact_play(staging.stg_pbp(plays(t)), staging.stg_snap_counts(snaps(t)), who, calendar(t))


@query("hourly_match", f"""WITH {EV}, {METEO_SQL}, games AS (SELECT event_id, user_id, ts, d, sqrt(value + 0.003) * 10 AS load FROM ev WHERE event_type = 'purchase'),
wv AS (SELECT * FROM wx WHERE stadium = 'view')
SELECT CAST(g.event_id AS VARCHAR) AS session_id, g.user_id AS player_sk, CAST(g.d AS VARCHAR) AS session_date, CAST(date_diff('day', DATE '2024-01-01', g.d) // 7 + 1 AS INTEGER) AS season_week, 'NE' AS stadium_team, 'Gillette Stadium' AS stadium, false AS is_dome,
  round(g.load, 6) AS player_load, round(w.temperature_c, 6) AS temperature_c, w.code AS weather_code, w.temperature_c IS NOT NULL AS has_weather
FROM games g LEFT JOIN wv w ON w.hour_utc = date_trunc('hour', g.ts)""")
def hourly_match(t):
    """Game sessions matched to the forecast hour they started in at one stadium."""
    return shaped(game_weather(t), dates=("session_date",), keep=("session_id", "player_sk", "season_week", "stadium_team", "stadium", "is_dome", "weather_code", "has_weather"),
                  floats=("player_load", "temperature_c"))


@shared
def game_weather(t):
    from squadlake.catalog.shapes import calendar, sessions
    from squadlake.plans import dims, facts
    from squadlake.sources import seeds
    weather = staging.stg_open_meteo(forecast(t)).where("stadium = 'view'")
    roster = t.events.select(f.c.team.alias("team")).distinct().withColumn("valid_to", F.lit(None).cast("timestamp"))
    teams = dims.dim_team(roster, seeds.stadiums(t.spark))
    return facts.fact_game_weather(sessions(t), weather, teams, play_fact(t), calendar(t))


@query("hourly_match_plays", f"""WITH hm AS ({ORACLES["hourly_match"]}), pf AS ({ORACLES["role_unpivot_sums"]}),
points AS (SELECT player_sk, game_date, round(sum(epa_total), 6) AS epa_total, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(offense_snaps) AS BIGINT) AS offense_snaps FROM pf GROUP BY ALL)
SELECT hm.*, epa_total, plays, offense_snaps FROM hm LEFT JOIN points p ON p.player_sk = hm.player_sk AND p.game_date = hm.session_date""")
def hourly_match_plays(t):
    """The same sessions with the player's points, plays and snaps of the day."""
    return shaped(game_weather(t), dates=("session_date",), keep=("session_id", "player_sk", "season_week", "stadium_team", "stadium", "is_dome", "weather_code", "has_weather", "plays", "offense_snaps"),
                  floats=("player_load", "temperature_c", "epa_total"))
