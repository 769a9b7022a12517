"""Silver-shaped frames derived from the given tables, and the same shapes as SQL.

``events`` is read as athlete monitoring data: every event is a session and a
force-plate test, its type decides whether it is also a survey, an injury or a
status update.  Measures are built with a square root so that no rounded value
sits on a tie.  The SQL twin of each frame is a CTE of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.catalog.registry import Tables, shared
from squadlake.functions import units
from squadlake.plans import dims

START, END = "2024-01-01", "2024-02-12"
PARTS = ("hamstring", "hammy", "L mcl", "high ankle (r)", "left ac joint", "concussion protocol", "elbow", "Knee (R)")
TEAMS = ("NE", "KC", "BUF", "SF")
POSITIONS = ("QB", "WR", "CB")


def pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{listed}], CAST({index} AS INTEGER) + 1)"


@shared
def ev(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", F.to_date("ts").alias("d"), "user_id", "event_type", "value",
                           F.get_json_object("props", "$.k").cast("int").alias("k"))


EV = """ev AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, user_id, event_type, value,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""


def measure():
    return F.sqrt(F.col("value") + 0.003)


@shared
def sessions(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "game").when(F.col("event_type") == "view", "walkthrough").otherwise("practice")
    m = measure()
    return ev(t).select(
        F.col("event_id").alias("bronze_id"), F.col("event_id").cast("string").alias("session_id"),
        F.col("user_id").alias("player_sk"), F.col("ts").alias("session_ts"), F.col("d").alias("session_date"),
        kind.alias("session_type"), (F.col("k") + 20).alias("duration_min"), (m * 10).alias("player_load"),
        (m * 100).alias("total_distance_m"), (m * 20).alias("high_speed_distance_m"), (m / 3).alias("max_speed_ms"),
        (F.col("k") % 7).alias("sprint_count"))


SESS = """sess AS (SELECT event_id AS bronze_id, CAST(event_id AS VARCHAR) AS session_id, user_id AS player_sk, ts AS session_ts,
    d AS session_date, CASE event_type WHEN 'purchase' THEN 'game' WHEN 'view' THEN 'walkthrough' ELSE 'practice' END AS session_type,
    k + 20 AS duration_min, sqrt(value + 0.003) * 10 AS player_load, sqrt(value + 0.003) * 100 AS total_distance_m,
    sqrt(value + 0.003) * 20 AS high_speed_distance_m, sqrt(value + 0.003) / 3 AS max_speed_ms, k % 7 AS sprint_count FROM ev)"""

SURVEYED = ("view", "click", "signup")


@shared
def surveys(t: Tables) -> DataFrame:
    k = F.col("k")
    shift = {"sleep_quality": 0, "soreness": 3, "fatigue": 5, "stress": 7, "mood": 2}
    return ev(t).where(F.col("event_type").isin(*SURVEYED)).select(
        F.col("event_id").alias("bronze_id"), F.col("user_id").alias("player_sk"), F.col("d").alias("survey_date"),
        F.col("ts").alias("submitted_at"), measure().alias("sleep_hours"),
        *[(1 + (k + s) % 10).cast("double").alias(c) for c, s in shift.items()], (k % 11).alias("srpe"),
        F.lit(10).alias("scale_max"), F.lit(False).alias("scale_inferred"), F.lit(False).alias("tz_corrected"),
        F.lit(False).alias("is_resubmission"))


SURV = """surv AS (SELECT event_id AS bronze_id, user_id AS player_sk, d AS survey_date, ts AS submitted_at,
    sqrt(value + 0.003) AS sleep_hours, 1 + k % 10 AS sleep_quality, 1 + (k + 3) % 10 AS soreness, 1 + (k + 5) % 10 AS fatigue,
    1 + (k + 7) % 10 AS stress, 1 + (k + 2) % 10 AS mood, k % 11 AS srpe
    FROM ev WHERE event_type IN ('view', 'click', 'signup'))"""


@shared
def tests(t: Tables) -> DataFrame:
    return ev(t).select(
        F.col("event_id").alias("bronze_id"), F.concat(F.lit("t"), "event_id").alias("test_id"),
        F.col("user_id").alias("player_sk"), F.col("ts").alias("test_ts"), F.lit("CMJ").alias("test_type"),
        (F.col("k") % 3 + 1).alias("rep"), F.when(F.col("k") % 5 > 0, measure()).alias("jump_height_cm"),
        (measure() * 100 + 800).alias("peak_force_n"), F.lit(False).alias("force_unit_inferred"), F.lit(1500.0).alias("rfd"),
        F.when(F.col("k") % 9 > 0, measure() + F.col("k") - 50).alias("asymmetry_pct"), F.lit("d1").alias("device_id"))


TESTS = """tests AS (SELECT event_id AS bronze_id, user_id AS player_sk, ts AS test_ts,
    CASE WHEN k % 5 > 0 THEN sqrt(value + 0.003) END AS jump_height_cm,
    CASE WHEN k % 9 > 0 THEN sqrt(value + 0.003) + k - 50 END AS asymmetry_pct FROM ev)"""


@shared
def measurements(t: Tables) -> DataFrame:
    method = F.when(F.col("event_type") == "purchase", "DEXA").when(F.col("event_type") == "click", "BIA").otherwise("scale")
    return ev(t).where(F.col("event_type").isin("purchase", "click", "error")).select(
        F.col("event_id").alias("bronze_id"), F.concat(F.lit("m"), "event_id").alias("measurement_id"),
        F.col("user_id").alias("player_sk"), F.col("d").alias("measured_on"), method.alias("method"),
        (measure() * 5 + 150).alias("weight_lbs"), F.lit(False).alias("weight_mislabeled"),
        (F.col("k") / 4.0).alias("body_fat_pct"), (measure() * 4 + 120).alias("lean_mass_lbs"),
        F.lit(False).alias("lean_mass_was_pct"), F.lit("mild").alias("hydration_status"))


MEAS = """meas AS (SELECT event_id AS bronze_id, user_id AS player_sk, d AS measured_on,
    CASE event_type WHEN 'purchase' THEN 'DEXA' WHEN 'click' THEN 'BIA' ELSE 'scale' END AS method,
    sqrt(value + 0.003) * 5 + 150 AS weight_lbs, k / 4.0 AS body_fat_pct
    FROM ev WHERE event_type IN ('purchase', 'click', 'error'))"""


@shared
def injuries(t: Tables) -> DataFrame:
    """The earliest error of each (user, k mod 3) opens an injury."""
    k = F.col("k")
    first = (ev(t).where("event_type = 'error'").groupBy("user_id", (k % 3).alias("lane"))
             .agg(F.min_by(F.struct("event_id", "ts", "d", "k"), F.struct("ts", "event_id")).alias("e"))
             .select("user_id", "lane", "e.*"))
    return first.select(
        F.col("event_id").alias("bronze_id"), (F.col("user_id") * 3 + F.col("lane")).alias("injury_id"),
        F.col("user_id").alias("player_sk"), pick(TEAMS, F.col("user_id") % 4).alias("team"), F.col("ts").alias("event_ts"),
        F.col("d").alias("event_date"), F.when(k % 8 == 6, None).otherwise("knee").alias("body_part"),
        pick(PARTS, k % 8).alias("body_part_raw"), F.when(k % 4 == 0, "L").alias("side"), F.lit("strain").alias("injury_type"),
        pick(("minor", "moderate", "major"), F.col("lane")).alias("severity"),
        F.date_add("d", k % 20).alias("expected_rtp"), F.col("ts").alias("opened_at"), F.array().cast("array<string>").alias("qc_flags"))


INJ = f"""inj AS (SELECT event_id AS bronze_id, user_id * 3 + lane AS injury_id, user_id AS player_sk,
    {sql_pick(TEAMS, 'user_id % 4')} AS team, d AS event_date, CASE WHEN k % 8 = 6 THEN NULL ELSE 'knee' END AS body_part,
    {sql_pick(PARTS, 'k % 8')} AS body_part_raw, CASE WHEN k % 4 = 0 THEN 'L' END AS side,
    {sql_pick(('minor', 'moderate', 'major'), 'lane')} AS severity, d + k % 20 AS expected_rtp
    FROM (SELECT *, k % 3 AS lane, row_number() OVER (PARTITION BY user_id, k % 3 ORDER BY ts, event_id) AS pos
          FROM ev WHERE event_type = 'error') WHERE pos = 1)"""

STATUS_SQL = "CASE event_type WHEN 'view' THEN 'DNP' WHEN 'purchase' THEN 'FP' ELSE 'LP' END"


@shared
def updates(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "DNP").when(F.col("event_type") == "purchase", "FP").otherwise("LP")
    game = F.when(F.col("k") % 4 == 0, "Out").when(F.col("k") % 4 == 1, "Doubtful").when(F.col("k") % 4 == 2, "Questionable")
    return ev(t).where("event_type <> 'error'").select(
        F.col("event_id").alias("bronze_id"), F.col("event_id").cast("string").alias("update_id"),
        (F.col("user_id") * 3 + F.col("k") % 3).alias("injury_id"), F.col("user_id").alias("player_sk"),
        F.col("ts").alias("updated_at"), F.col("d").alias("update_date"), kind.alias("practice_status"), game.alias("game_status"))


UPD = f"""upd AS (SELECT event_id AS bronze_id, user_id * 3 + k % 3 AS injury_id, user_id AS player_sk, ts AS updated_at,
    d AS update_date, {STATUS_SQL} AS practice_status,
    CASE k % 4 WHEN 0 THEN 'Out' WHEN 1 THEN 'Doubtful' WHEN 2 THEN 'Questionable' END AS game_status
    FROM ev WHERE event_type <> 'error')"""


@shared
def calendar(t: Tables) -> DataFrame:
    return dims.dim_date(t.spark, START, END)


CAL = f"""cal AS (SELECT CAST(g AS DATE) AS date_day, CAST(date_diff('day', DATE '{START}', CAST(g AS DATE)) // 7 + 1 AS INTEGER) AS season_week,
    {sql_pick(dims.DAY_TYPES, 'isodow(g) - 1')} AS day_type, isodow(g) IN (3, 4, 5, 7) AS counted
    FROM generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 DAY, INTERVAL 1 DAY) AS s(g))"""


@shared
def players(t: Tables) -> DataFrame:
    """One current version per user."""
    u = F.col("user_id")
    return t.events.select("user_id").distinct().select(
        u.alias("player_sk"), F.concat(F.lit("Player "), F.lpad(u.cast("string"), 9, "0")).alias("full_name"),
        pick(TEAMS, u % 4).alias("team"), pick(POSITIONS, u % 3).alias("position"), F.lit(True).alias("is_current"))


WHO = f"""who AS (SELECT DISTINCT user_id AS player_sk, 'Player ' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS full_name,
    {sql_pick(TEAMS, 'user_id % 4')} AS team, {sql_pick(POSITIONS, 'user_id % 3')} AS position FROM events)"""

# Practice and game ranks shared by several oracles.
PRACTICE_RANK = "CASE {c} WHEN 'DNP' THEN 1 WHEN 'LP' THEN 2 ELSE 3 END"
GAME_RANK = "CASE {c} WHEN 'Out' THEN 1 WHEN 'Doubtful' THEN 2 WHEN 'Questionable' THEN 3 END"

GRID = f"""lim AS (SELECT greatest((SELECT max(session_date) FROM sess), (SELECT max(survey_date) FROM surv)) AS last_day),
people AS (SELECT player_sk FROM sess UNION SELECT player_sk FROM surv),
grid AS (SELECT p.player_sk, c.date_day, c.season_week, c.day_type FROM people p, cal c, lim
    WHERE c.date_day BETWEEN DATE '{START}' AND lim.last_day),
lastsurv AS (SELECT * FROM surv QUALIFY row_number() OVER (PARTITION BY player_sk, survey_date ORDER BY submitted_at DESC, bronze_id DESC) = 1),
byday AS (SELECT player_sk, session_date, sum(player_load) AS ld, sum(duration_min) AS mins, count(*) AS n, sum(total_distance_m) AS dist,
    sum(high_speed_distance_m) AS hsd, max(max_speed_ms) AS spd, sum(sprint_count) AS spr FROM sess GROUP BY ALL),
daily AS (SELECT g.*, coalesce(b.ld, 0.0) AS ext, coalesce(b.mins, 0) AS mins, coalesce(b.n, 0) AS n, b.dist, b.hsd, b.spd, b.spr, s.srpe,
    coalesce(s.srpe * b.mins, 0) AS internal FROM grid g
    LEFT JOIN byday b ON b.player_sk = g.player_sk AND b.session_date = g.date_day
    LEFT JOIN lastsurv s ON s.player_sk = g.player_sk AND s.survey_date = g.date_day)"""

LOAD = """roll AS (SELECT *, sum(ext) OVER w7 AS a7, sum(ext) OVER w28 / 4 AS c28, sum(internal) OVER w7 AS ia7, sum(internal) OVER w28 / 4 AS ic28,
    count(*) OVER w28 AS hist FROM daily
    WINDOW w7 AS (PARTITION BY player_sk ORDER BY date_day ROWS 6 PRECEDING), w28 AS (PARTITION BY player_sk ORDER BY date_day ROWS 27 PRECEDING)),
ew AS (SELECT d.player_sk, d.date_day,
    sum(p.ext * pow(0.75, date_diff('day', p.date_day, d.date_day))) / sum(pow(0.75, date_diff('day', p.date_day, d.date_day))) AS ea,
    sum(p.ext * pow(27.0 / 29, date_diff('day', p.date_day, d.date_day))) / sum(pow(27.0 / 29, date_diff('day', p.date_day, d.date_day))) AS ec
    FROM daily d JOIN daily p ON p.player_sk = d.player_sk AND p.date_day <= d.date_day AND p.date_day > d.date_day - 56 GROUP BY ALL),
ratio AS (SELECT roll.*, ea, ec, CASE WHEN hist >= 28 AND c28 <> 0 THEN a7 / c28 END AS acwr,
    CASE WHEN hist >= 28 AND ic28 <> 0 THEN ia7 / ic28 END AS iacwr, CASE WHEN hist >= 28 AND ec <> 0 THEN ea / ec END AS eacwr
    FROM roll JOIN ew USING (player_sk, date_day)),
tl AS (SELECT *, CASE WHEN acwr < 0.8 THEN 'low' WHEN acwr <= 1.3 THEN 'sweet' WHEN acwr <= 1.5 THEN 'elevated' WHEN acwr > 1.5 THEN 'high' END AS band
    FROM ratio)"""

WELL = """well AS (SELECT *, round(0.20 * sleep_quality + 0.15 * least(10, greatest(1, sleep_hours)) + 0.25 * (11 - soreness)
    + 0.20 * (11 - fatigue) + 0.10 * (11 - stress) + 0.10 * mood, 2) AS readiness FROM lastsurv)"""

STRENGTH = """str AS (SELECT *, CAST(test_ts AS DATE) AS test_date, avg(asymmetry_pct) OVER w4 AS asym4,
    avg(asymmetry_pct) OVER w4 - avg(asymmetry_pct) OVER w4p AS trend, max(jump_height_cm) OVER w4 AS jump4 FROM tests
    WINDOW w4 AS (PARTITION BY player_sk ORDER BY test_ts RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW),
    w4p AS (PARTITION BY player_sk ORDER BY test_ts RANGE BETWEEN INTERVAL 55 DAYS PRECEDING AND INTERVAL 28 DAYS PRECEDING))"""

NUTR = """nutr AS (SELECT *, CASE method WHEN 'DEXA' THEN 1 WHEN 'BIA' THEN 2 ELSE 3 END AS method_rank,
    row_number() OVER (PARTITION BY player_sk, measured_on ORDER BY CASE method WHEN 'DEXA' THEN 1 WHEN 'BIA' THEN 2 ELSE 3 END, bronze_id) = 1 AS is_preferred
    FROM meas)"""

# The body-part seed as SQL values (NULL side = unsided).
def _seed_sql() -> str:
    from squadlake.sources.seeds import body_part_rows
    rows = ", ".join(f"('{t}', '{p}', '{r}', {'NULL' if s is None else repr(s)})" for t, p, r, s in body_part_rows())
    return f"seed(raw_text, part, region, sside) AS (VALUES {rows})"


INJURY = _seed_sql() + """,
fp AS (SELECT u.injury_id, min(u.update_date) AS return_date FROM upd u JOIN inj i USING (injury_id)
    WHERE u.practice_status = 'FP' AND u.update_date >= i.event_date GROUP BY ALL),
nupd AS (SELECT injury_id, count(*) AS n FROM upd GROUP BY ALL),
asofday AS (SELECT greatest((SELECT max(update_date) FROM upd), (SELECT max(event_date) FROM inj)) AS d),
fi AS (SELECT i.bronze_id AS injury_sk, i.injury_id, i.player_sk, i.team, i.event_date, coalesce(s.part, i.body_part) AS body_part, s.region AS body_region,
    coalesce(i.side, s.sside) AS side, i.body_part_raw, i.severity, i.expected_rtp, fp.return_date, fp.return_date IS NULL AS is_open,
    date_diff('day', i.event_date, coalesce(fp.return_date, a.d)) AS days_out, coalesce(n.n, 0) AS status_updates
    FROM inj i LEFT JOIN seed s ON s.raw_text = lower(i.body_part_raw) LEFT JOIN fp USING (injury_id) LEFT JOIN nupd n USING (injury_id), asofday a)"""

STATUS = """idays AS (SELECT f.injury_id, f.player_sk, c.date_day, c.season_week, c.day_type, c.counted FROM fi f
    JOIN cal c ON c.date_day BETWEEN f.event_date AND coalesce(f.return_date, f.event_date + CAST(f.days_out AS INTEGER))),
fis AS (SELECT y.injury_id, y.player_sk, y.date_day, y.season_week, y.day_type, y.counted,
    coalesce(arg_max(u.practice_status, u.updated_at), 'DNP') AS practice_status, arg_max_null(u.game_status, u.updated_at) AS game_status
    FROM idays y LEFT JOIN upd u ON u.injury_id = y.injury_id AND u.update_date <= y.date_day GROUP BY ALL)"""

AVAIL = """avail AS (SELECT g.player_sk, g.season_week, count(*) AS scheduled, count(x.date_day) AS missed,
    round((count(*) - count(x.date_day)) / count(*), 3) AS pct
    FROM (SELECT grid.* FROM grid JOIN cal USING (date_day) WHERE cal.counted) g
    LEFT JOIN (SELECT DISTINCT player_sk, date_day FROM fis WHERE practice_status = 'DNP') x
      ON x.player_sk = g.player_sk AND x.date_day = g.date_day GROUP BY ALL)"""

# Means of readiness are exact in cents, rounded half up, as decimal arithmetic does.
DAY = f"""wm AS (SELECT *, CAST(round(readiness * 100) AS BIGINT) AS cents FROM well),
wmean AS (SELECT *, sum(cents) OVER w AS s28, count(*) OVER w AS n28 FROM wm WINDOW w AS (PARTITION BY player_sk ORDER BY survey_date
    RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
wday AS (SELECT *, CASE WHEN n28 >= 7 THEN (2 * s28 + n28) // (2 * n28) END AS mean_cents FROM wmean),
sday AS (SELECT * FROM str QUALIFY row_number() OVER (PARTITION BY player_sk, test_date ORDER BY test_ts DESC, bronze_id DESC) = 1),
iday AS (SELECT s.player_sk, s.date_day, count(DISTINCT s.injury_id) AS n_open, min({PRACTICE_RANK.format(c='s.practice_status')}) AS pr,
    min({GAME_RANK.format(c='s.game_status')}) AS gr, string_agg(DISTINCT coalesce(f.body_part, f.body_part_raw), ', ' ORDER BY coalesce(f.body_part, f.body_part_raw)) AS parts,
    min(f.expected_rtp) AS back, max(date_diff('day', f.event_date, s.date_day)) AS since FROM fis s JOIN fi f USING (injury_id) GROUP BY s.player_sk, s.date_day),
seen AS (SELECT t.*, w.readiness, w.cents, w.mean_cents, w.soreness, w.sleep_hours,
    max(w.survey_date) OVER c AS last_survey, max(s.test_date) OVER c AS last_test, max(n.measured_on) OVER c AS last_weigh,
    i.n_open, i.pr, i.gr, i.parts, i.back, i.since FROM tl t
    LEFT JOIN wday w ON w.player_sk = t.player_sk AND w.survey_date = t.date_day
    LEFT JOIN sday s ON s.player_sk = t.player_sk AND s.test_date = t.date_day
    LEFT JOIN (SELECT * FROM nutr WHERE is_preferred) n ON n.player_sk = t.player_sk AND n.measured_on = t.date_day
    LEFT JOIN iday i ON i.player_sk = t.player_sk AND i.date_day = t.date_day
    WINDOW c AS (PARTITION BY t.player_sk ORDER BY t.date_day ROWS UNBOUNDED PRECEDING)),
asm AS (SELECT e.*, s.asym4, s.jump4, n.weight_lbs, n.body_fat_pct, e.cents - e.mean_cents AS delta_cents,
    CASE e.pr WHEN 1 THEN 'Out' WHEN 2 THEN 'Limited' ELSE 'Available' END AS availability,
    CASE e.gr WHEN 1 THEN 'Out' WHEN 2 THEN 'Doubtful' WHEN 3 THEN 'Questionable' END AS game_status,
    CASE e.pr WHEN 1 THEN 'DNP' WHEN 2 THEN 'LP' WHEN 3 THEN 'FP' END AS practice_status,
    coalesce(date_diff('day', e.last_survey, e.date_day) >= 3, true) AS is_silent FROM seen e
    LEFT JOIN sday s ON s.player_sk = e.player_sk AND s.test_date = e.last_test
    LEFT JOIN (SELECT * FROM nutr WHERE is_preferred) n ON n.player_sk = e.player_sk AND n.measured_on = e.last_weigh),
why AS (SELECT *, list_filter([CASE WHEN availability = 'Out' THEN 'out (DNP)' END,
      CASE WHEN game_status IN ('Out', 'Doubtful') THEN 'game status ' || lower(game_status) END, CASE WHEN band = 'high' THEN 'ACWR high' END], lambda x: x IS NOT NULL) AS red,
    list_filter([CASE WHEN availability = 'Limited' THEN 'limited (LP)' END,
      CASE WHEN availability = 'Available' AND coalesce(n_open, 0) > 0 THEN 'open injury at full practice' END,
      CASE WHEN band = 'elevated' THEN 'ACWR elevated' END,
      CASE WHEN delta_cents <= -150 THEN 'readiness ' || format('{{:.2f}}', delta_cents / 100.0) || ' vs own 28-day mean' END,
      CASE WHEN abs(asym4) > 10 THEN 'asymmetry ' || format('{{:.1f}}', asym4) || '%' END,
      CASE WHEN is_silent THEN 'no wellness survey in 3 days' END], lambda x: x IS NOT NULL) AS amber FROM asm),
pd AS (SELECT *, CASE WHEN len(red) > 0 THEN 'red' WHEN len(amber) > 0 THEN 'amber' ELSE 'green' END AS flag,
    CASE WHEN len(red) > 0 THEN 1 WHEN len(amber) > 0 THEN 2 ELSE 3 END AS flag_rank,
    nullif(array_to_string(list_concat(red, amber), '; '), '') AS flag_reasons FROM why)"""

TO_LOAD = ",\n".join([EV, SESS, SURV, CAL, GRID, LOAD])
TO_INJURY = ",\n".join([INJ, UPD, INJURY])
TO_DAY = ",\n".join([TO_LOAD, WELL, TESTS, STRENGTH, MEAS, NUTR, TO_INJURY, STATUS, DAY])
