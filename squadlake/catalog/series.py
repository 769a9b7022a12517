"""Dense grids, rolling loads, as-of state and the facts built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from squadlake.catalog import shapes as s
from squadlake.catalog.registry import query, rnd, shaped, shared, shared_table, text
from squadlake.operators.dedup import flag_repeats, latest_per_key, latest_with_count
from squadlake.operators.timeseries import carry_forward, day_grid, own_mean, scalar
from squadlake.plans import analyses, dims, facts, mart, report
from squadlake.sources import seeds


@shared
def training_load(t):
    return facts.fact_training_load(s.sessions(t), s.surveys(t), s.calendar(t), s.START)


@shared_table
def load_table(t):
    """The training-load fact as a stored table, for queries that read it more than once."""
    return training_load(t)


@query("acwr_player_day", f"""WITH {s.TO_LOAD}
SELECT player_sk, CAST(date_day AS VARCHAR) AS date_day, season_week, day_type, CAST(n AS BIGINT) AS sessions, CAST(mins AS BIGINT) AS duration_min,
  srpe, CAST(spr AS BIGINT) AS sprint_count, hist AS history_days, band AS acwr_band, round(ext, 6) AS external_load, CAST(internal AS DOUBLE) AS internal_load,
  round(a7, 6) AS acute_7d, round(c28, 6) AS chronic_28d, round(acwr, 6) AS acwr_coupled, round(iacwr, 6) AS internal_acwr,
  round(dist, 6) AS total_distance_m, round(hsd, 6) AS high_speed_distance_m, round(spd, 6) AS max_speed_ms, md5(player_sk || '-' || date_day) AS training_load_sk FROM tl""")
def acwr_player_day(t):
    """Flagship: zero-filled player-day grid, rolling loads, workload ratio and band."""
    return shaped(training_load(t), dates=("date_day",), keep=(
        "player_sk", "season_week", "day_type", "sessions", "duration_min", "srpe", "sprint_count", "history_days", "acwr_band",
        "training_load_sk"), floats=("external_load", "internal_load", "acute_7d", "chronic_28d", "acwr_coupled", "internal_acwr",
                                     "total_distance_m", "high_speed_distance_m", "max_speed_ms"))


@query("ewma_load", f"""WITH {s.TO_LOAD}
SELECT player_sk, CAST(date_day AS VARCHAR) AS date_day, round(ea, 6) AS ewma_acute, round(ec, 6) AS ewma_chronic, round(eacwr, 6) AS acwr_ewma FROM tl""")
def ewma_load(t):
    """Normalised EWMA(7)/EWMA(28) over a bounded look-back; the oracle is the range self-join."""
    return shaped(training_load(t), keep=("player_sk",), dates=("date_day",), floats=("ewma_acute", "ewma_chronic", "acwr_ewma"))


@query("rolling_time_range", f"""WITH {s.EV}, {s.TESTS}, {s.STRENGTH}
SELECT bronze_id AS strength_sk, player_sk, CAST(test_date AS VARCHAR) AS test_date, round(asym4, 6) AS asymmetry_4w_avg,
  round(trend, 6) AS asymmetry_trend, round(jump4, 6) AS jump_height_4w_max FROM str""")
def rolling_time_range(t):
    """Time-range frames per test, computed from day slices instead of one window per player."""
    return shaped(facts.fact_strength(s.tests(t)), keep=("strength_sk", "player_sk"), dates=("test_date",),
                  floats=("asymmetry_4w_avg", "asymmetry_trend", "jump_height_4w_max"))


@query("rolling_order_range", """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, sqrt(o_totalprice) AS v FROM orders)
SELECT o_orderkey, o_custkey, count(v) OVER w AS n_recent, round(sum(v) OVER w, 6) AS sum_recent, round(min(v) OVER p, 6) AS min_earlier FROM o
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 360 DAYS PRECEDING AND CURRENT ROW),
p AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 720 DAYS PRECEDING AND INTERVAL 360 DAYS PRECEDING)""")
def rolling_order_range(t):
    """The same operator with a coarse slice over a long history."""
    from squadlake.operators.windows import sliding_stats
    day = 86_400
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.sqrt("o_totalprice").alias("v"))
    out = sliding_stats(rows, ["o_custkey"], "o_orderdate", slice_seconds=30 * day,
                        frames={"recent": (360 * day, 0), "earlier": (720 * day, 360 * day)},
                        stats={"n": ("v", "count"), "sum": ("v", "sum"), "min": ("v", "min")})
    return out.select("o_orderkey", "o_custkey", F.col("recent_n").alias("n_recent"), rnd("recent_sum").alias("sum_recent"),
                      rnd("earlier_min").alias("min_earlier"))


@query("own_mean_delta", f"""WITH {s.EV}, dv AS (SELECT user_id, d, sum(sqrt(value + 0.003)) AS v FROM ev GROUP BY ALL)
SELECT user_id, CAST(d AS VARCHAR) AS d, n_days, round(m, 6) AS own_mean, CASE WHEN n_days >= 7 THEN round(v - m, 6) END AS delta
FROM (SELECT *, avg(v) OVER w AS m, count(*) OVER w AS n_days FROM dv WINDOW w AS (PARTITION BY user_id ORDER BY d
  RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))""")
def own_mean_delta(t):
    """Each day against the entity's own mean over the 28 days before, today excluded."""
    daily = s.ev(t).groupBy("user_id", "d").agg(F.sum(s.measure()).alias("v"))
    out = own_mean(daily, ["user_id"], "d", "v", mean_as="m", count_as="n_days")
    return out.select("user_id", text("d").alias("d"), "n_days", rnd("m").alias("own_mean"),
                      rnd(F.when(F.col("n_days") >= 7, F.col("v") - F.col("m"))).alias("delta"))


@query("carry_forward_last_purchase", f"""WITH {s.EV}, b AS (SELECT min(d) AS lo, max(d) AS hi FROM ev),
grid AS (SELECT u.user_id, CAST(g AS DATE) AS day FROM (SELECT DISTINCT user_id FROM ev) u, b, generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY) AS x(g)),
p AS (SELECT user_id, d, max(value) AS top FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
f AS (SELECT g.*, max(p.d) OVER (PARTITION BY g.user_id ORDER BY g.day ROWS UNBOUNDED PRECEDING) AS last_day FROM grid g LEFT JOIN p ON p.user_id = g.user_id AND p.d = g.day)
SELECT f.user_id, CAST(f.day AS VARCHAR) AS day, CAST(f.last_day AS VARCHAR) AS last_day, date_diff('day', f.last_day, f.day) AS days_since, round(p.top, 6) AS last_top,
  coalesce(date_diff('day', f.last_day, f.day) >= 3, true) AS is_silent FROM f LEFT JOIN p ON p.user_id = f.user_id AND p.d = f.last_day""")
def carry_forward_last_purchase(t):
    """Date and value of the last purchase on or before each grid day; silent after three days."""
    e = s.ev(t)
    grid = day_grid(e.select("user_id").distinct(), scalar(e, F.min("d")), scalar(e, F.max("d")), "day")
    bought = (e.where("event_type = 'purchase'").groupBy("user_id", F.col("d").alias("day")).agg(F.max("value").alias("top"))
              .select("user_id", "day", F.struct(F.col("day").alias("d"), F.col("top").alias("v")).alias("hit")))
    rows = grid.join(bought, ["user_id", "day"], "left")
    rows = rows.withColumn("last", carry_forward(rows, ["user_id"], "day", F.col("hit")))
    since = F.datediff("day", "last.d")
    return rows.select("user_id", text("day").alias("day"), text("last.d").alias("last_day"), since.cast("bigint").alias("days_since"),
                       rnd("last.v").alias("last_top"), F.coalesce(since >= 3, F.lit(True)).alias("is_silent"))


@shared_table
def injury(t):
    types = dims.dim_injury_type(seeds.injury_body_parts(t.spark))
    return facts.fact_injury(s.injuries(t), s.updates(t), types)


@shared
def status(t):
    return facts.fact_injury_status(injury(t), s.updates(t), s.calendar(t))


@query("injury_facts", f"""WITH {s.EV}, {s.TO_INJURY}
SELECT injury_sk, injury_id, player_sk, team, CAST(event_date AS VARCHAR) AS event_date, body_part, body_region, side, body_part_raw, severity,
  CAST(expected_rtp AS VARCHAR) AS expected_rtp, CAST(return_date AS VARCHAR) AS return_date, is_open, days_out, status_updates FROM fi""")
def injury_facts(t):
    """One row per injury: seed lookup, first full-practice date, days out, update count."""
    return shaped(injury(t), dates=("event_date", "expected_rtp", "return_date"), keep=(
        "injury_sk", "injury_id", "player_sk", "team", "body_part", "body_region", "side", "body_part_raw", "severity", "is_open",
        "days_out", "status_updates"))


@shared_table
def status_table(t):
    return status(t)


@query("asof_status", f"""WITH {s.EV}, {s.CAL}, {s.TO_INJURY}, {s.STATUS}
SELECT injury_id, player_sk, CAST(date_day AS VARCHAR) AS date_day, season_week, day_type, counted AS counts_for_availability, practice_status, game_status,
  practice_status = 'DNP' AS is_unavailable FROM fis""")
def asof_status(t):
    """Open spans expanded to days, each with the last status on or before it."""
    return shaped(status(t), dates=("date_day",), keep=("injury_id", "player_sk", "season_week", "day_type", "counts_for_availability",
                                                        "practice_status", "game_status", "is_unavailable"))


@query("interval_availability", f"""WITH {s.TO_LOAD}, {s.TO_INJURY}, {s.STATUS}, {s.AVAIL}
SELECT player_sk, season_week, scheduled AS scheduled_sessions, scheduled - missed AS available_sessions, missed AS missed_sessions, round(pct, 6) AS availability_pct FROM avail""")
def interval_availability(t):
    """Scheduled days per week and the share not missed."""
    return shaped(facts.fact_availability(load_table(t), status(t), s.calendar(t)), floats=("availability_pct",), keep=(
        "player_sk", "season_week", "scheduled_sessions", "available_sessions", "missed_sessions"))


@query("weighted_composite", f"""WITH {s.EV}, {s.SURV}, lastsurv AS (SELECT * FROM surv QUALIFY row_number() OVER (PARTITION BY player_sk, survey_date ORDER BY submitted_at DESC, bronze_id DESC) = 1), {s.WELL}
SELECT bronze_id, player_sk, CAST(survey_date AS VARCHAR) AS survey_date, srpe, round(readiness, 6) AS readiness_score, md5(player_sk || '-' || survey_date) AS wellness_sk FROM well""")
def weighted_composite(t):
    """Latest survey of the day with its weighted readiness score."""
    return shaped(facts.fact_wellness(s.surveys(t)), keep=("bronze_id", "player_sk", "srpe", "wellness_sk"), dates=("survey_date",),
                  floats=("readiness_score",))


@query("preferred_method", f"""WITH {s.EV}, {s.MEAS}, {s.NUTR}
SELECT bronze_id AS nutrition_sk, player_sk, CAST(measured_on AS VARCHAR) AS measured_on, method, method_rank, is_preferred, round(weight_lbs, 6) AS weight_lbs FROM nutr""")
def preferred_method(t):
    """Method rank and the preferred measurement of the day."""
    return shaped(facts.fact_nutrition(s.measurements(t)), keep=("nutrition_sk", "player_sk", "method", "method_rank", "is_preferred"),
                  dates=("measured_on",), floats=("weight_lbs",))


@shared_table
def strength_table(t):
    """The strength fact as a stored table, for queries that read it beside the player-day fact."""
    return facts.fact_strength(s.tests(t))


@shared
def player_day(t):
    return facts.fact_player_day(training_load(t), facts.fact_wellness(s.surveys(t)), strength_table(t),
                                 facts.fact_nutrition(s.measurements(t)), status_table(t), injury(t))


@shared_table
def player_day_table(t):
    """The player-day fact as a stored table, as a report reads it."""
    return player_day(t)


@query("flag_reasons", f"""WITH {s.TO_DAY}
SELECT player_sk, CAST(date_day AS VARCHAR) AS date_day, band AS acwr_band, round(a7, 6) AS load_7d, round(readiness, 6) AS readiness_score,
  round(mean_cents / 100.0, 6) AS readiness_28d_mean, round(delta_cents / 100.0, 6) AS readiness_delta, CAST(last_survey AS VARCHAR) AS last_survey_date,
  date_diff('day', last_survey, date_day) AS days_since_survey, is_silent, CAST(last_test AS VARCHAR) AS last_test_date, round(asym4, 6) AS asymmetry_4w_avg,
  round(jump4, 6) AS jump_height_4w_max, CAST(last_weigh AS VARCHAR) AS last_weigh_in, round(weight_lbs, 6) AS weight_lbs, coalesce(n_open, 0) AS open_injuries,
  practice_status, availability, game_status, parts AS open_injury_body_parts, CAST(back AS VARCHAR) AS expected_return, since AS days_since_injury,
  flag, flag_rank, flag_reasons FROM pd""")
def flag_reasons(t):
    """The as-of reading per player and day with red/amber/green and its reasons."""
    return shaped(player_day(t), keep=("player_sk", "acwr_band", "days_since_survey", "is_silent", "open_injuries", "practice_status",
                                       "availability", "game_status", "open_injury_body_parts", "days_since_injury", "flag", "flag_rank", "flag_reasons"),
                  dates=("date_day", "last_survey_date", "last_test_date", "last_weigh_in", "expected_return"),
                  floats=("load_7d", "readiness_score", "readiness_28d_mean", "readiness_delta", "asymmetry_4w_avg", "jump_height_4w_max", "weight_lbs"))


@shared
def weekly(t):
    sessions_games = game_points(t)
    load, days = load_table(t), status_table(t)
    return mart.mart_player_week(
        load, facts.fact_wellness(s.surveys(t)), strength_table(t), facts.fact_nutrition(s.measurements(t)),
        facts.fact_availability(load, days, s.calendar(t)), injury(t), days, sessions_games, s.players(t), s.calendar(t))


def game_points(t):
    """Purchases as games: the mart's play side."""
    return s.ev(t).where("event_type = 'purchase'").select(
        F.col("user_id").alias("player_sk"), (F.floor(F.datediff("d", F.lit(s.START).cast("date")) / 7) + 1).cast("int").alias("season_week"),
        (F.col("k") % 9).alias("plays"), s.measure().alias("epa_total"), F.col("k").alias("offense_snaps"), (F.col("k") % 5).alias("defense_snaps"),
        (s.measure() / 30).alias("offense_pct"))


PLAY_SQL = f"""gp AS (SELECT user_id AS player_sk, CAST(date_diff('day', DATE '{s.START}', d) // 7 + 1 AS INTEGER) AS season_week, k % 9 AS plays,
  sqrt(value + 0.003) AS epa, k AS osn, k % 5 AS dsn, sqrt(value + 0.003) / 30 AS opct FROM ev WHERE event_type = 'purchase')"""

MART_SQL = f"""wk AS (SELECT season_week, min(date_day) AS week_start, max(date_day) AS week_end FROM tl GROUP BY ALL),
ml AS (SELECT player_sk, season_week, sum(ext) AS ext_week, sum(internal) AS int_week, sum(n) AS n_week, sum(dist) AS dist_week, max(acwr) AS acwr_max,
  count(*) FILTER (band = 'high') AS high_days FROM tl GROUP BY ALL),
me AS (SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY player_sk, season_week ORDER BY date_day DESC) = 1),
mw AS (SELECT w.player_sk, c.season_week, (2 * sum(cents) + count(*)) // (2 * count(*)) / 100.0 AS ready, (200 * CAST(sum(soreness) AS BIGINT) + count(*)) // (2 * count(*)) / 100.0 AS sore,
  (200 * CAST(sum(fatigue) AS BIGINT) + count(*)) // (2 * count(*)) / 100.0 AS tired, round(avg(sleep_hours), 2) AS slept, count(*) AS surveys FROM wm w JOIN cal c ON c.date_day = w.survey_date GROUP BY ALL),
ms AS (SELECT s.*, c.season_week FROM str s JOIN cal c ON c.date_day = s.test_date QUALIFY row_number() OVER (PARTITION BY s.player_sk, c.season_week ORDER BY test_ts DESC, bronze_id DESC) = 1),
mn AS (SELECT n.*, c.season_week FROM nutr n JOIN cal c ON c.date_day = n.measured_on WHERE is_preferred QUALIFY row_number() OVER (PARTITION BY n.player_sk, c.season_week ORDER BY measured_on DESC, method_rank, bronze_id DESC) = 1),
mi AS (SELECT f.player_sk, c.season_week, count(*) AS fresh, string_agg(coalesce(f.body_part, f.body_part_raw), ', ' ORDER BY f.event_date, f.injury_sk) AS parts FROM fi f JOIN cal c ON c.date_day = f.event_date GROUP BY ALL),
mx AS (SELECT x.player_sk, x.season_week, count(DISTINCT injury_id) AS n_open, min({s.PRACTICE_RANK.format(c='practice_status')}) AS worst FROM
  (SELECT * FROM fis QUALIFY date_day = max(date_day) OVER (PARTITION BY injury_id, season_week)) x JOIN wk ON wk.season_week = x.season_week AND x.date_day <= wk.week_end GROUP BY ALL),
mp AS (SELECT player_sk, season_week, sum(plays) AS plays, sum(epa) AS epa, sum(osn) AS osn, sum(dsn) AS dsn, avg(opct) AS opct, count(*) AS games FROM gp GROUP BY ALL),
pw AS (SELECT g.player_sk, g.season_week, wk.week_start, wk.week_end, who.full_name, who.team, who.position, ml.* EXCLUDE (player_sk, season_week), me.a7, me.c28, me.acwr, me.eacwr, me.iacwr, me.band,
  mw.* EXCLUDE (player_sk, season_week), ms.asymmetry_pct, ms.asym4, ms.trend, ms.jump4, ms.test_date, mn.weight_lbs, mn.body_fat_pct, mn.method, mn.measured_on,
  avail.pct, avail.scheduled, avail.missed, coalesce(mi.fresh, 0) AS fresh, mi.parts, coalesce(mx.n_open, 0) AS n_open, CASE mx.worst WHEN 1 THEN 'DNP' WHEN 2 THEN 'LP' ELSE 'FP' END AS practice,
  coalesce(mp.games, 0) AS games, mp.plays, mp.epa, mp.osn, mp.dsn, mp.opct
  FROM (SELECT DISTINCT player_sk, season_week FROM tl) g JOIN wk USING (season_week) LEFT JOIN who USING (player_sk) LEFT JOIN ml USING (player_sk, season_week) LEFT JOIN me USING (player_sk, season_week)
  LEFT JOIN mw USING (player_sk, season_week) LEFT JOIN ms USING (player_sk, season_week) LEFT JOIN mn USING (player_sk, season_week) LEFT JOIN avail USING (player_sk, season_week)
  LEFT JOIN mi USING (player_sk, season_week) LEFT JOIN mx USING (player_sk, season_week) LEFT JOIN mp USING (player_sk, season_week))"""

TO_WEEK = ",\n".join([s.TO_DAY, s.WHO, s.AVAIL, PLAY_SQL, MART_SQL])


@query("week_mart", f"""WITH {TO_WEEK}
SELECT player_sk, season_week, CAST(week_start AS VARCHAR) AS week_start, CAST(week_end AS VARCHAR) AS week_end, full_name, team, position, CAST(n_week AS BIGINT) AS sessions_week,
  round(ext_week, 6) AS external_load_week, CAST(int_week AS DOUBLE) AS internal_load_week, round(dist_week, 6) AS distance_m_week, round(a7, 1) AS acute_7d, round(c28, 1) AS chronic_28d,
  round(acwr, 3) AS acwr_coupled, round(eacwr, 3) AS acwr_ewma, round(iacwr, 3) AS internal_acwr, band AS acwr_band, round(acwr_max, 3) AS acwr_max_week, high_days AS days_acwr_high,
  round(ready, 6) AS readiness_avg, round(sore, 6) AS soreness_avg, round(tired, 6) AS fatigue_avg, slept AS sleep_hours_avg, surveys, round(asymmetry_pct, 6) AS asymmetry_pct, round(asym4, 2) AS asymmetry_4w_avg,
  round(trend, 2) AS asymmetry_trend, round(jump4, 6) AS jump_height_4w_max, CAST(test_date AS VARCHAR) AS last_test_date, round(weight_lbs, 6) AS weight_lbs, round(body_fat_pct, 6) AS body_fat_pct, method AS weight_method,
  CAST(measured_on AS VARCHAR) AS last_weigh_in, round(pct, 6) AS availability_pct, scheduled AS scheduled_sessions, missed AS missed_sessions, fresh AS new_injuries, parts AS new_injury_body_parts, n_open AS open_injuries,
  practice AS practice_status, games, CAST(plays AS BIGINT) AS plays, round(epa, 2) AS epa_total, CAST(osn AS BIGINT) AS offense_snaps, CAST(dsn AS BIGINT) AS defense_snaps, round(opct, 3) AS offense_pct FROM pw""")
def week_mart(t):
    """The weekly mart: eleven sides on (player, week)."""
    return shaped(weekly(t), dates=("week_start", "week_end", "last_test_date", "last_weigh_in"), keep=(
        "player_sk", "season_week", "full_name", "team", "position", "sessions_week", "acwr_band", "days_acwr_high", "surveys", "weight_method",
        "scheduled_sessions", "missed_sessions", "new_injuries", "new_injury_body_parts", "open_injuries", "practice_status", "games", "plays",
        "offense_snaps", "defense_snaps"), floats=(
        "external_load_week", "internal_load_week", "distance_m_week", "acute_7d", "chronic_28d", "acwr_coupled", "acwr_ewma", "internal_acwr",
        "acwr_max_week", "readiness_avg", "soreness_avg", "fatigue_avg", "sleep_hours_avg", "asymmetry_pct", "asymmetry_4w_avg", "asymmetry_trend",
        "jump_height_4w_max", "weight_lbs", "body_fat_pct", "availability_pct", "epa_total", "offense_pct"))


@query("latest_per_key", """SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_order(t):
    """Latest row per key, ties by id."""
    return shaped(latest_per_key(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]), keep=("o_custkey", "o_orderkey"), floats=("o_totalprice",), digits=2)


@query("latest_with_count", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS versions, count(*) > 1 AS is_correction FROM orders GROUP BY o_custkey""")
def latest_order_with_count(t):
    """Latest row per key and how many versions it had, in one aggregation."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    out = latest_with_count(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "versions", (F.col("versions") > 1).alias("is_correction"))


@query("distinct_on_keys", """SELECT l_suppkey, l_returnflag, max(l_shipdate)::DATE::VARCHAR AS last_ship, arg_max(l_orderkey, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS l_orderkey FROM lineitem GROUP BY ALL""")
def distinct_on_keys(t):
    """DISTINCT ON (supplier, flag) ordered by ship date."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    rows = latest_per_key(t.lineitem, ["l_suppkey", "l_returnflag"], order)
    return rows.select("l_suppkey", "l_returnflag", text(F.to_date("l_shipdate")).alias("last_ship"), "l_orderkey")


@query("resubmission_flag", f"""WITH {s.EV} SELECT event_id, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) > 1 AS is_resubmission FROM ev""")
def resubmission_flag(t):
    """Second and later submissions of a user's day."""
    return flag_repeats(s.ev(t), ["user_id", "d"], ["ts", "event_id"], "is_resubmission").select("event_id", "is_resubmission")


@query("next_period_rate", f"""WITH {TO_WEEK}, nx AS (SELECT *, lead(fresh) OVER (PARTITION BY player_sk ORDER BY season_week) AS nxt FROM pw)
SELECT band AS acwr_band, count(*) AS player_weeks, count(*) FILTER (nxt > 0) AS with_injury, round(100.0 * count(*) FILTER (nxt > 0) / count(*), 4) AS next_week_rate_pct
FROM nx WHERE band IS NOT NULL AND nxt IS NOT NULL GROUP BY band""")
def next_period_rate(t):
    """Next week's injury rate by this week's closing band."""
    return mart.ratio_bands(weekly(t))


@query("lagged_hazard", f"""WITH {s.TO_LOAD}, {s.TO_INJURY}, lg AS (SELECT *, lag(acwr, 1) OVER (PARTITION BY player_sk ORDER BY date_day) AS prev FROM tl),
e AS (SELECT player_sk, event_date, count(*) AS n FROM inj GROUP BY ALL)
SELECT prev > 1.15 AS above, count(*) AS player_days, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS injuries, round(1000.0 * coalesce(sum(e.n), 0) / count(*), 6) AS per_1000_days
FROM lg LEFT JOIN e ON e.player_sk = lg.player_sk AND e.event_date = lg.date_day WHERE prev IS NOT NULL GROUP BY ALL""")
def lagged_hazard(t):
    """Injuries per 1,000 player-days above and below a lagged workload ratio.  The given
    events span 30 days and a ratio needs 28, so the default lag of 3 leaves no day: 1 here."""
    out = analyses.hazard_by_lagged_ratio(training_load(t), s.injuries(t), lag=1)
    return out.select("above", "player_days", "injuries", rnd("per_1000_days").alias("per_1000_days"))


@query("weekly_load_spread", f"""WITH {s.TO_LOAD}, w AS (SELECT player_sk, season_week, sum(ext) AS x FROM tl GROUP BY ALL),
r AS (SELECT x / nullif(avg(x) OVER (PARTITION BY player_sk), 0) AS q FROM w)
SELECT round(quantile_disc(q, 0.95), 6) AS p95, round(max(q), 6) AS max_ratio, count(q) AS player_weeks FROM r""")
def weekly_load_spread(t):
    """Weekly load against the player's own mean: 95th percentile and maximum."""
    m = training_load(t).groupBy("player_sk", "season_week").agg(F.sum("external_load").alias("external_load_week"))
    out = analyses.weekly_load_spread(m)
    return out.select(rnd("p95").alias("p95"), rnd("max_ratio").alias("max_ratio"), "player_weeks")


@query("mean_after_kind", f"""WITH {s.TO_LOAD}, lg AS (SELECT *, lag(day_type) OVER (PARTITION BY player_sk ORDER BY date_day) AS pk FROM tl)
SELECT pk AS previous_kind, round(avg(ext), 6) AS mean_value, count(ext) AS n_days FROM lg WHERE pk IS NOT NULL GROUP BY pk""")
def mean_after_kind(t):
    """Mean load by the kind of the day before."""
    out = analyses.mean_after(training_load(t), ["player_sk"], "date_day", "day_type", "external_load")
    return out.select("previous_kind", rnd("mean_value").alias("mean_value"), "n_days")


@query("conditional_rates", f"""WITH {s.TO_DAY}, h AS (SELECT DISTINCT player_sk, event_date FROM inj),
lg AS (SELECT player_sk, date_day, day_type, lag(acwr, 3) OVER (PARTITION BY player_sk ORDER BY date_day) AS before FROM tl),
x AS (SELECT coalesce(before > 1.5, false) OR coalesce(abs(pd.asym4) > 10, false) AS flagged, h.event_date IS NOT NULL AS hit
  FROM pd JOIN lg ON lg.player_sk = pd.player_sk AND lg.date_day = pd.date_day AND lg.day_type IN ('practice', 'game')
  LEFT JOIN h ON h.player_sk = pd.player_sk AND h.event_date = pd.date_day)
SELECT count(*) FILTER (flagged) AS flagged_days, count(*) FILTER (NOT flagged) AS base_days,
  round(count(*) FILTER (flagged AND hit) / nullif(count(*) FILTER (flagged), 0), 6) AS flagged_rate,
  round(count(*) FILTER (NOT flagged AND hit) / nullif(count(*) FILTER (NOT flagged), 0), 6) AS base_rate FROM x""")
def conditional_rates(t):
    """Injury rate on practice and game days after a high ratio or with a marked asymmetry, and on the others."""
    hit = s.injuries(t).select("player_sk", F.col("event_date").alias("date_day")).distinct().withColumn("hit", F.lit(True))
    load = training_load(t).select("player_sk", "date_day", "day_type", "acwr_coupled")
    days = analyses.at_risk(player_day(t).select("player_sk", "date_day", "asymmetry_4w_avg"), load).join(hit, ["player_sk", "date_day"], "left")
    days = days.select("flagged", F.coalesce("hit", F.lit(False)).alias("hit"))
    out = analyses.rate_comparison(days, "flagged", "hit")
    return out.select("flagged_days", "base_days", rnd("flagged_rate").alias("flagged_rate"), rnd("base_rate").alias("base_rate"))
