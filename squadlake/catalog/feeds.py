"""Raw feeds derived from ``events``: JSON payloads with the dirt the rules exist for.

Ids repeat (user and k), labels are missing or wrong, stamps are naive or
malformed, names come in several spellings.  The SQL twins read the base
columns, so an oracle never sees the JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.catalog.registry import Tables, shared, shared_table
from squadlake.catalog.shapes import PARTS, TEAMS, ev, measure, pick, sql_pick

FIRST = ("Mike", "Josh", "Chris", "Anna", "Lee", "Kim", "Pat")
CLEAN = ("michael", "joshua", "christopher", "anna", "lee", "kim", "patrick")


class _Columns:
    """Columns shared by the feeds, built on use (a Column needs a running session)."""

    @property
    def user(self) -> Column:
        return F.col("user_id")

    @property
    def k(self) -> Column:
        return F.col("k")

    @property
    def first_name(self) -> Column:
        return pick(FIRST, self.user % 7)

    @property
    def last_name(self) -> Column:
        return F.concat(F.lit("Smith"), F.floor(self.user / 20).cast("bigint").cast("string"))

    @property
    def team(self) -> Column:
        return pick(TEAMS, self.user % 4)

    @property
    def gsis(self) -> Column:
        return F.format_string("00-00%05d", self.user)

    @property
    def cat_id(self) -> Column:
        return F.concat(F.lit("cat_"), F.lpad(F.lower(F.hex(self.user)), 8, "0"))

    @property
    def raw_name(self) -> Column:
        k, first, last = self.k, self.first_name, self.last_name
        return (F.when(k % 4 == 0, F.concat_ws(" ", first, last))
                .when(k % 4 == 1, F.upper(F.concat(last, F.lit(", "), first)))
                .when(k % 4 == 2, F.concat(last, F.lit(" Jr., "), first))
                .otherwise(F.concat(F.lit("Ace "), last)))


c = _Columns()

# SQL twins.
TEAM_SQL = sql_pick(TEAMS, "user_id % 4")
LAST_SQL = "'Smith' || (user_id // 20)"
GSIS_SQL = "printf('00-00%05d', user_id)"
CAT_SQL = "'cat_' || printf('%08x', user_id)"
RAW_SQL = f"""CASE k % 4 WHEN 0 THEN {sql_pick(FIRST, 'user_id % 7')} || ' ' || {LAST_SQL} WHEN 1 THEN upper({LAST_SQL} || ', ' || {sql_pick(FIRST, 'user_id % 7')})
    WHEN 2 THEN {LAST_SQL} || ' Jr., ' || {sql_pick(FIRST, 'user_id % 7')} ELSE 'Ace ' || {LAST_SQL} END"""
NAME_SQL = f"CASE WHEN k % 4 = 3 THEN 'ace' ELSE {sql_pick(CLEAN, 'user_id % 7')} END || ' smith' || (user_id // 20)"


def bronze(rows: DataFrame, payload: Column, source: str, endpoint: str) -> DataFrame:
    """``rows`` as landed records: event id as record id, event time as ingest time."""
    return rows.select(
        F.col("event_id").alias("id"), F.to_json(payload).alias("payload"), F.lit(source).alias("_source"),
        F.lit(endpoint).alias("_endpoint"), F.col("ts").alias("_ingested_at"), F.lit("b1").alias("_batch_id"),
        F.when(c.k % 2 == 0, "1.0").otherwise(None).alias("_schema_version"))


@shared
def forcedeck(t: Tables) -> DataFrame:
    m = measure()
    return bronze(ev(t), F.struct(
        F.concat(F.lit("t"), c.user, F.lit("-"), c.k).alias("test_id"), c.gsis.alias("athlete_gsis_id"),
        F.unix_seconds("ts").alias("test_ts"), F.when(c.k % 4 < 3, pick(("CMJ", "IMTP", "DJ"), c.k % 3)).alias("test_type"),
        (c.k % 4).alias("rep"), (m * 5).alias("jump_height_cm"), (m * 200 + 300).alias("peak_force"),
        F.when(c.k % 3 == 0, "N").when(c.k % 3 == 1, "lbf").alias("force_unit"), (m * 1000 + 500).alias("rfd"),
        (m + c.k - 50).alias("asymmetry_pct"), F.when(c.k % 7 > 0, "d1").alias("device_id")), "forcedeck", "/v1/tests")


FORCEDECK = f"""fd AS (SELECT event_id AS bronze_id, user_id, k, ts, 't' || user_id || '-' || k AS test_id, {GSIS_SQL} AS gsis,
    CASE WHEN k % 4 < 3 THEN {sql_pick(('CMJ', 'IMTP', 'DJ'), 'k % 3')} END AS test_type, k % 4 AS rep, m * 5 AS jump, m * 200 + 300 AS raw,
    CASE k % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'lbf' END AS unit, m * 1000 + 500 AS rfd, m + k - 50 AS asym, CASE WHEN k % 7 > 0 THEN 'd1' END AS device
    FROM (SELECT *, sqrt(value + 0.003) AS m FROM ev) QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1),
fdn AS (SELECT *, CASE WHEN raw < 1500 THEN raw * 4.4482216152605::DOUBLE ELSE raw END AS newtons FROM fd),
fdbad AS (SELECT *, test_type IS NULL OR rep NOT BETWEEN 1 AND 3 OR jump NOT BETWEEN 5 AND 90 OR newtons NOT BETWEEN 800 AND 7000
    OR rfd NOT BETWEEN 1000 AND 20000 OR asym NOT BETWEEN -50 AND 50 OR NOT regexp_matches(gsis, '^00-00\\d{{5}}$') AS held FROM fdn)"""


@shared
def nutrition(t: Tables) -> DataFrame:
    m = measure()
    method = F.when(F.col("event_type") == "purchase", "DEXA").when(F.col("event_type") == "click", "BIA").otherwise("scale")
    return bronze(ev(t), F.struct(
        F.concat(F.lit("m"), c.user, F.lit("-"), c.k).alias("measurement_id"), c.raw_name.alias("player_name"), c.team.alias("team"),
        F.when(c.k % 10 > 0, F.date_format("d", "MM/dd/yyyy")).otherwise(F.date_format("d", "yyyy-MM-dd")).alias("measured_on"),
        method.alias("method"), (m * 15 + 120).alias("weight"),
        F.when(c.k % 3 == 0, "lb").when(c.k % 3 == 1, "kg").alias("weight_unit"), (c.k / 2.0).alias("body_fat_pct"),
        F.when(c.k % 2 == 0, m + 60).otherwise(m * 4 + 120).alias("lean_mass"),
        F.when(c.k % 6 == 0, "soaked").otherwise("mild").alias("hydration_status")), "nutrition", "/v1/measurements")


NUTRITION = f"""nu AS (SELECT event_id AS bronze_id, user_id, k, d, ts, 'm' || user_id || '-' || k AS measurement_id, {RAW_SQL} AS raw_name, {NAME_SQL} AS clean,
    {TEAM_SQL} AS team, CASE WHEN k % 10 > 0 THEN d END AS measured_on, CASE event_type WHEN 'purchase' THEN 'DEXA' WHEN 'click' THEN 'BIA' ELSE 'scale' END AS method,
    m * 15 + 120 AS weight, CASE k % 3 WHEN 0 THEN 'lb' WHEN 1 THEN 'kg' END AS unit, k / 2.0 AS fat,
    CASE WHEN k % 2 = 0 THEN m + 60 ELSE m * 4 + 120 END AS lean, CASE WHEN k % 6 = 0 THEN 'soaked' ELSE 'mild' END AS hydration
    FROM (SELECT *, sqrt(value + 0.003) AS m FROM ev) QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1),
nubad AS (SELECT *, measured_on IS NULL OR weight NOT BETWEEN 130 AND 420 OR fat NOT BETWEEN 3 AND 40 OR hydration <> 'mild'
    OR NOT regexp_matches(team, '^[A-Z]{{2,3}}$') AS held FROM nu)"""


@shared
def catapult(t: Tables) -> DataFrame:
    """Sessions, and an athlete list from the sign-ups."""
    m = measure()
    kind = F.when(F.col("event_type") == "purchase", "game").when(F.col("event_type") == "view", "walkthrough").otherwise("practice")
    sessions = bronze(ev(t), F.struct(
        F.concat(F.lit("x"), c.user, F.lit("-"), c.k).alias("session_id"), c.cat_id.alias("player_id"),
        F.when(c.k % 10 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("session_ts"),
        kind.alias("session_type"), (c.k + 15).alias("duration_min"), (m * 700).alias("total_distance"), (m * 80).alias("high_speed_distance"),
        F.when(c.k % 3 == 0, "yd").when(c.k % 3 == 1, "m").alias("distance_unit"), (m + 2).alias("max_speed"),
        F.when(c.k % 4 == 0, "mph").when(c.k % 4 < 3, "m/s").alias("speed_unit"), (c.k % 70).alias("sprint_count"), c.k.alias("accel_count"),
        c.k.alias("decel_count"), F.when(c.k % 20 > 0, m * 50).alias("player_load")), "catapult", "/v1/sessions")
    athletes = bronze(ev(t).where("event_type = 'signup'"), F.struct(
        c.cat_id.alias("athlete_id"), c.first_name.alias("first_name"), c.last_name.alias("last_name")), "catapult", "/v1/athletes")
    return sessions.unionByName(athletes)


CATAPULT = f"""ca AS (SELECT event_id AS bronze_id, user_id, k, d, ts, 'x' || user_id || '-' || k AS session_id, {CAT_SQL} AS player_id,
    CASE WHEN k % 10 > 0 THEN date_trunc('second', ts) END AS session_ts, CASE event_type WHEN 'purchase' THEN 'game' WHEN 'view' THEN 'walkthrough' ELSE 'practice' END AS session_type,
    k + 15 AS minutes, m * 700 AS dist, m * 80 AS fast, CASE k % 3 WHEN 0 THEN 'yd' WHEN 1 THEN 'm' END AS du, m + 2 AS speed,
    CASE WHEN k % 4 = 0 THEN 'mph' WHEN k % 4 < 3 THEN 'm/s' END AS su, k % 70 AS sprints, CASE WHEN k % 20 > 0 THEN m * 50 END AS load
    FROM (SELECT *, sqrt(value + 0.003) AS m FROM ev) QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1),
can AS (SELECT *, CASE WHEN du = 'yd' THEN dist * 0.9144::DOUBLE ELSE dist END AS dist_m, CASE WHEN du = 'yd' THEN fast * 0.9144::DOUBLE ELSE fast END AS fast_m,
    CASE WHEN speed > 12 THEN speed / 2.2369362920544::DOUBLE ELSE speed END AS speed_ms FROM ca),
cabad AS (SELECT *, session_ts IS NULL OR minutes NOT BETWEEN 20 AND 180 OR dist_m NOT BETWEEN 500 AND 12000 OR fast_m NOT BETWEEN 0 AND 3000
    OR speed_ms NOT BETWEEN 3 AND 12 OR load IS NULL OR load NOT BETWEEN 100 AND 1000 OR sprints NOT BETWEEN 0 AND 60 AS held FROM can)"""

SWITCH_DAY = "2024-01-15"  # the answers go from 1..5 to 1..10 on this day


@shared
def wellness(t: Tables) -> DataFrame:
    m, late = measure(), F.col("d") >= F.lit(SWITCH_DAY).cast("date")
    v2 = c.k % 2 == 0
    top = F.when(late, 10).otherwise(5)
    shift = {"sleep_quality": 0, "soreness": 3, "fatigue": 5, "stress": 7, "mood": 2}
    nfl = c.user + 1000
    return bronze(ev(t), F.struct(
        F.concat(F.lit("s"), c.user, F.lit("-"), c.k).alias("survey_id"), F.when(v2, nfl).alias("athlete_id"), F.when(~v2, nfl).alias("player_id"),
        F.when(~v2, F.concat_ws(" ", c.first_name, c.last_name)).alias("name"), F.when(v2, c.first_name).alias("first_name"),
        F.when(v2, c.last_name).alias("last_name"),
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(c.k % 5 == 0, "+00:00").otherwise("")).alias("submitted_at"),
        F.when(c.k % 6 == 0, top).alias("scale_max"), m.alias("sleep_hours"),
        *[(1 + (c.k + s) % top).alias(n) for n, s in shift.items()], (c.k % 12).alias("srpe")), "ams_wellness", "/v1/surveys")


WELLNESS = f"""we0 AS (SELECT *, sqrt(value + 0.003) AS m, CASE WHEN d >= DATE '{SWITCH_DAY}' THEN 10 ELSE 5 END AS top FROM ev
    QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY ts DESC, event_id DESC) = 1),
we AS (SELECT event_id AS bronze_id, user_id, k, d, ts, 's' || user_id || '-' || k AS survey_id, user_id + 1000 AS nfl_id, date_trunc('second', ts) AS local_ts, k % 5 = 0 AS bogus,
    CASE WHEN k % 6 = 0 THEN top END AS declared, m AS sleep_hours, 1 + k % top AS sleep_quality, 1 + (k + 3) % top AS soreness, 1 + (k + 5) % top AS fatigue,
    1 + (k + 7) % top AS stress, 1 + (k + 2) % top AS mood, k % 12 AS srpe FROM we0),
wes AS (SELECT *, coalesce(declared, CASE WHEN max(greatest(sleep_quality, soreness, fatigue, stress, mood)) OVER (PARTITION BY d) > 5 THEN 10 ELSE 5 END) AS scale_max FROM we),
webad AS (SELECT *, sleep_hours NOT BETWEEN 3 AND 12 OR srpe NOT BETWEEN 0 AND 10 OR sleep_quality NOT BETWEEN 1 AND 10
    OR scale_max < sleep_quality OR scale_max < soreness OR scale_max < fatigue OR scale_max < stress OR scale_max < mood AS held FROM wes)"""


@shared
def emr(t: Tables) -> DataFrame:
    """Errors open injuries (re-emitted under one id), everything else updates them."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    iid = F.concat(F.lit("i"), c.user, F.lit("-"), c.k % 3)
    injuries = bronze(ev(t).where("event_type = 'error'"), F.struct(
        iid.alias("injury_id"), c.raw_name.alias("player"), c.team.alias("team"), at.alias("event_date"), pick(PARTS, c.k % 8).alias("body_part"),
        F.when(c.k % 5 == 0, "R").alias("side"), F.lit("strain").alias("injury_type"),
        F.when(c.k % 11 == 0, "fatal").otherwise("minor").alias("severity"),
        F.when(c.k % 3 > 0, F.date_format(F.date_add("d", c.k % 20 - 2), "yyyy-MM-dd")).alias("expected_rtp"), at.alias("opened_at")),
        "emr", "/v1/injuries")
    status = F.when(F.col("event_type") == "view", "DNP").when(F.col("event_type") == "purchase", "FP").when(c.k % 13 == 0, "??").otherwise("LP")
    updates = bronze(ev(t).where("event_type <> 'error'"), F.struct(
        F.concat(F.lit("u"), c.user, F.lit("-"), c.k).alias("update_id"), iid.alias("injury_id"), c.raw_name.alias("player"),
        status.alias("practice_status"), F.when(c.k % 4 == 0, "Out").alias("game_status"), at.alias("updated_at")), "emr", "/v1/status_updates")
    return injuries.unionByName(updates)


EMR = f"""ij AS (SELECT event_id AS bronze_id, user_id, k, d, ts, 'i' || user_id || '-' || (k % 3) AS injury_id, {RAW_SQL} AS raw_name, {NAME_SQL} AS clean, {TEAM_SQL} AS team,
    {sql_pick(PARTS, 'k % 8')} AS body_part, CASE WHEN k % 5 = 0 THEN 'R' END AS side, CASE WHEN k % 11 = 0 THEN 'fatal' ELSE 'minor' END AS severity,
    CASE WHEN k % 3 > 0 THEN d + (k % 20 - 2) END AS rtp FROM ev WHERE event_type = 'error'
    QUALIFY row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY ts DESC, event_id DESC) = 1),
ijbad AS (SELECT *, severity <> 'minor' OR coalesce(rtp < d, false) AS held FROM ij),
us0 AS (SELECT event_id AS bronze_id, user_id, k, d, ts, 'u' || user_id || '-' || k AS update_id, 'i' || user_id || '-' || (k % 3) AS injury_id, {RAW_SQL} AS raw_name, {NAME_SQL} AS clean,
    CASE WHEN event_type = 'view' THEN 'DNP' WHEN event_type = 'purchase' THEN 'FP' WHEN k % 13 = 0 THEN '??' ELSE 'LP' END AS status,
    CASE WHEN k % 4 = 0 THEN 'Out' END AS game FROM ev WHERE event_type <> 'error'),
us AS (SELECT *, count(*) OVER (PARTITION BY update_id) AS versions FROM us0 QUALIFY row_number() OVER (PARTITION BY update_id ORDER BY date_trunc('second', ts) DESC, ts DESC, bronze_id DESC) = 1),
usbad AS (SELECT *, status = '??' AS held FROM us)"""


@shared_table
def master(t: Tables) -> DataFrame:
    """Users whose first event is not a sign-up are on the roster."""
    known = ev(t).groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("_f")).where("_f <> 'signup'")
    full = F.concat_ws(" ", c.first_name, c.last_name)
    from squadlake.functions.text import clean_name
    return known.select(
        (c.user + 1).alias("player_sk"), c.gsis.alias("gsis_id"), (c.user + 1000).alias("nfl_id"), full.alias("full_name"),
        clean_name(full).alias("clean_name"), c.first_name.alias("first_name"), c.last_name.alias("last_name"),
        F.when(c.user % 5 == 0, "Ace").alias("football_name"), c.team.alias("team"), F.lit(None).cast("timestamp").alias("valid_to"))


@shared_table
def vendor_map(t: Tables) -> DataFrame:
    """Users whose last event is a view are already pinned for two vendors."""
    last = ev(t).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("_l")).where("_l = 'view'")
    pins = last.select((c.user + 1).alias("player_sk"), F.explode(F.array(
        F.struct(F.lit("catapult").alias("vendor"), c.cat_id.alias("vendor_player_id")),
        F.struct(F.lit("nutrition").alias("vendor"), F.concat(c.first_name, F.lit(" X"), c.user).alias("vendor_player_id")))).alias("p"))
    stamp = F.lit("2023-12-31").cast("timestamp")
    return pins.select("p.vendor", "p.vendor_player_id", "player_sk", F.lit("name_unique").alias("resolved_by"), F.lit(0.75).alias("confidence"),
                       stamp.alias("first_seen"), stamp.alias("last_seen"))


MASTER = f"""mas AS (SELECT user_id, user_id + 1 AS player_sk, {GSIS_SQL} AS gsis_id, user_id + 1000 AS nfl_id, {TEAM_SQL} AS team, {sql_pick(CLEAN, 'user_id % 7')} || ' smith' || (user_id // 20) AS clean
    FROM (SELECT user_id, arg_min(event_type, (ts, event_id)) AS f FROM ev GROUP BY user_id) WHERE f <> 'signup'),
ali AS (SELECT player_sk, clean, team FROM mas UNION SELECT player_sk, 'ace smith' || (user_id // 20), team FROM mas WHERE user_id % 5 = 0),
nt AS (SELECT clean, team, count(*) AS n, min(player_sk) AS sk FROM ali GROUP BY ALL),
nn AS (SELECT clean, count(DISTINCT player_sk) AS n, min(player_sk) AS sk FROM ali GROUP BY ALL),
vm AS (SELECT user_id + 1 AS player_sk, {CAT_SQL} AS vid FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS l FROM ev GROUP BY user_id) WHERE l = 'view')"""


def name_rule(src: str, with_team: bool = True) -> str:
    """SQL for rules 4 to 6 on a CTE with ``clean`` and ``team`` columns."""
    join_team = "LEFT JOIN nt ON nt.clean = r.clean AND nt.team = r.team" if with_team else "LEFT JOIN (SELECT NULL AS n, NULL AS sk) nt ON false"
    return f"""SELECT r.*, CASE WHEN nt.n = 1 THEN nt.sk WHEN nt.n IS NULL AND nn.n = 1 THEN nn.sk END AS player_sk,
    CASE WHEN nt.n = 1 THEN 'name_team' WHEN nt.n IS NULL AND nn.n = 1 THEN 'name_unique' ELSE 'unresolved' END AS resolved_by,
    CASE WHEN nt.n = 1 OR (nt.n IS NULL AND nn.n = 1) THEN NULL WHEN nt.n > 1 OR nn.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS reason,
    CASE WHEN nt.n > 1 THEN nt.n WHEN nt.n IS NULL AND nn.n > 1 THEN nn.n ELSE 0 END AS n_candidates
    FROM {src} r {join_team} LEFT JOIN nn ON nn.clean = r.clean"""
