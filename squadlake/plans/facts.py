"""Gold facts.

Raw rows are always aggregated to (player, day) with partial aggregation
before anything is windowed or joined by player, so no step depends on how
many raw rows one player has.  Day grids are expanded from the key with
``sequence``; bounds are scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.functions import units
from squadlake.functions.casts import surrogate_key
from squadlake.functions.units import flags
from squadlake.operators.asof import asof_day
from squadlake.operators.dedup import first_per_key, flag_first
from squadlake.operators.timeseries import carry_forward, day_grid, ewma, explode_days, own_mean, scalar, trailing
from squadlake.operators.windows import sliding_stats
from squadlake.plans.dims import SEASON_START, calendar_columns
from squadlake.session import materialise

DAY_S, HOUR_S = 86_400, 3_600
LAMBDA_ACUTE = 2.0 / 8
LAMBDA_CHRONIC = 2.0 / 29
EWMA_DAYS = 56
FULL_HISTORY = 28


def latest_survey(surveys: DataFrame) -> DataFrame:
    """The day's last submission per player."""
    return first_per_key(surveys, ["player_sk", "survey_date"],
                         [F.col("submitted_at").desc_nulls_first(), F.col("bronze_id").desc()])


def tracked_players(sessions: DataFrame, surveys: DataFrame) -> DataFrame:
    return sessions.select("player_sk").union(surveys.select("player_sk")).distinct()


def player_grid(sessions: DataFrame, surveys: DataFrame, calendar: DataFrame, start: str = SEASON_START) -> DataFrame:
    """Every tracked player on every calendar day up to the last day with data."""
    end = F.greatest(scalar(sessions, F.max("session_date")), scalar(surveys, F.max("survey_date")))
    last_known = scalar(calendar, F.max("date_day"))
    first = F.greatest(F.lit(start).cast("date"), scalar(calendar, F.min("date_day")))
    origin = scalar(calendar, F.min("date_day"))
    grid = day_grid(tracked_players(sessions, surveys), first, F.least(end, last_known))
    attrs = calendar_columns(F.col("date_day"), F.col("_origin"))
    return (grid.withColumn("_origin", origin)
            .select("player_sk", "date_day", attrs["season_week"].alias("season_week"), attrs["day_type"].alias("day_type")))


def fact_training_load(sessions: DataFrame, surveys: DataFrame, calendar: DataFrame, start: str = SEASON_START,
                       cuts: tuple[float, float, float] = units.ACWR_CUTS) -> DataFrame:
    grid = player_grid(sessions, surveys, calendar, start)
    external = sessions.groupBy("player_sk", F.col("session_date").alias("date_day")).agg(
        F.sum("player_load").alias("_load"), F.sum("duration_min").alias("_minutes"), F.count("*").alias("_sessions"),
        F.sum("total_distance_m").alias("total_distance_m"), F.sum("high_speed_distance_m").alias("high_speed_distance_m"),
        F.max("max_speed_ms").alias("max_speed_ms"), F.sum("sprint_count").alias("sprint_count"))
    exertion = latest_survey(surveys).select("player_sk", F.col("survey_date").alias("date_day"), "srpe")
    zero = F.lit(0)
    daily = (grid.join(external, ["player_sk", "date_day"], "left").join(exertion, ["player_sk", "date_day"], "left")
             .withColumns({
                 "external_load": F.coalesce("_load", F.lit(0.0)), "duration_min": F.coalesce("_minutes", zero),
                 "sessions": F.coalesce("_sessions", zero),
                 "internal_load": F.coalesce(F.col("srpe") * F.col("_minutes"), zero).cast("double")}))
    week, month = (trailing(["player_sk"], "date_day", n) for n in (7, 28))
    rolled = daily.withColumns({
        "acute_7d": F.sum("external_load").over(week), "chronic_28d": F.sum("external_load").over(month) / 4.0,
        "internal_acute_7d": F.sum("internal_load").over(week),
        "internal_chronic_28d": F.sum("internal_load").over(month) / 4.0,
        "history_days": F.count("*").over(month)})
    rolled = ewma(rolled, ["player_sk"], "date_day", "external_load", EWMA_DAYS, {"ewma_acute": LAMBDA_ACUTE, "ewma_chronic": LAMBDA_CHRONIC})
    ratio = lambda n, d: F.when(F.col("history_days") >= FULL_HISTORY, F.try_divide(F.col(n), F.col(d)))
    rolled = rolled.withColumns({"acwr_coupled": ratio("acute_7d", "chronic_28d"),
                                 "internal_acwr": ratio("internal_acute_7d", "internal_chronic_28d"),
                                 "acwr_ewma": ratio("ewma_acute", "ewma_chronic")})
    return rolled.select(
        surrogate_key(F.col("player_sk"), F.col("date_day")).alias("training_load_sk"), "player_sk", "date_day",
        "season_week", "day_type", "sessions", "duration_min", "external_load", "internal_load", "srpe", "total_distance_m",
        "high_speed_distance_m", "max_speed_ms", "sprint_count", "acute_7d", "chronic_28d", "acwr_coupled",
        "internal_acute_7d", "internal_chronic_28d", "internal_acwr", "ewma_acute", "ewma_chronic", "acwr_ewma",
        units.acwr_band(F.col("acwr_coupled"), cuts).alias("acwr_band"), "history_days")


def fact_wellness(surveys: DataFrame) -> DataFrame:
    answers = [F.col(c) for c in ("sleep_quality", "sleep_hours", "soreness", "fatigue", "stress", "mood")]
    return latest_survey(surveys).select(
        surrogate_key(F.col("player_sk"), F.col("survey_date")).alias("wellness_sk"), "player_sk", "survey_date",
        "submitted_at", "bronze_id", "sleep_hours", "sleep_quality", "soreness", "fatigue", "stress", "mood", "srpe",
        "scale_max", "scale_inferred", "tz_corrected", "is_resubmission", units.readiness(*answers).alias("readiness_score"))


def fact_strength(tests: DataFrame, slice_seconds: int = HOUR_S) -> DataFrame:
    """Trailing four-week mean and best, and the drift against the four weeks before.
    Hourly slices: the work unit of a player with very many tests is one hour's."""
    rolled = sliding_stats(
        tests, ["player_sk"], "test_ts", slice_seconds=slice_seconds,
        frames={"now": (27 * DAY_S, 0), "before": (55 * DAY_S, 28 * DAY_S)},
        stats={"sum": ("asymmetry_pct", "sum"), "n": ("asymmetry_pct", "count"), "jump": ("jump_height_cm", "max")})
    mean = lambda f: F.try_divide(F.col(f"{f}_sum"), F.col(f"{f}_n"))
    return rolled.select(
        F.col("bronze_id").alias("strength_sk"), "test_id", "player_sk", "test_ts", F.to_date("test_ts").alias("test_date"),
        "test_type", "rep", "jump_height_cm", "peak_force_n", "force_unit_inferred", "rfd", "asymmetry_pct", "device_id",
        mean("now").alias("asymmetry_4w_avg"), (mean("now") - mean("before")).alias("asymmetry_trend"),
        F.col("now_jump").alias("jump_height_4w_max"))


def fact_nutrition(measurements: DataFrame) -> DataFrame:
    """DEXA is preferred over BIA over scale when a day has several."""
    ranked = measurements.withColumn("method_rank", units.method_rank(F.col("method")))
    return flag_first(ranked, ["player_sk", "measured_on"], [F.col("method_rank")], "bronze_id", "is_preferred").select(
        F.col("bronze_id").alias("nutrition_sk"), "measurement_id", "player_sk", "measured_on", "method", "weight_lbs",
        "weight_mislabeled", "body_fat_pct", "lean_mass_lbs", "lean_mass_was_pct", "hydration_status", "method_rank",
        "is_preferred")


def fact_injury(injuries: DataFrame, updates: DataFrame, injury_types: DataFrame) -> DataFrame:
    per_day = (updates.groupBy("injury_id", "update_date", (F.col("practice_status") == "FP").alias("_fp"))
               .agg(F.count("*").alias("_n")))
    events = injuries.select(F.col("injury_id").alias("_i"), F.col("event_date").alias("_event"))
    back = F.when(F.col("_fp") & (F.col("update_date") >= F.col("_event")), F.col("update_date"))
    per_injury = (per_day.join(events, F.col("injury_id") == F.col("_i")).groupBy("_i")
                  .agg(F.min(back).alias("return_date"), F.sum("_n").alias("_updates")))
    last_seen = F.greatest(scalar(updates, F.max("update_date")), scalar(injuries, F.max("event_date")))
    types = injury_types.select(F.col("raw_text").alias("_raw"), F.col("body_part").alias("_part"), "body_region",
                                F.col("side").alias("_side"))
    return (injuries.join(types, F.lower("body_part_raw") == F.col("_raw"), "left")
            .join(per_injury, F.col("injury_id") == F.col("_i"), "left").withColumn("_as_of", last_seen)
            .select(F.col("bronze_id").alias("injury_sk"), "injury_id", "player_sk", "team", "event_ts", "event_date",
                    "opened_at", F.coalesce("_part", "body_part").alias("body_part"), "body_region",
                    F.coalesce("side", "_side").alias("side"), "body_part_raw", "injury_type", "severity", "expected_rtp",
                    "return_date", F.col("return_date").isNull().alias("is_open"),
                    F.datediff(F.coalesce("return_date", "_as_of"), F.col("event_date")).alias("days_out"),
                    F.coalesce("_updates", F.lit(0)).alias("status_updates"), "qc_flags"))


def fact_injury_status(injury: DataFrame, updates: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per injury and day, status carried from the last update on or before the day."""
    spans = injury.select("injury_id", "player_sk", "event_date",
                          F.coalesce("return_date", F.date_add("event_date", F.col("days_out"))).alias("_end"))
    spans = spans.withColumns({"_origin": scalar(calendar, F.min("date_day")), "_last": scalar(calendar, F.max("date_day"))})
    spans = spans.withColumns({"_from": F.greatest("event_date", "_origin"), "_to": F.least("_end", "_last")})
    attrs = calendar_columns(F.col("date_day"), F.col("_origin"))
    days = explode_days(spans, "_from", "_to").select(
        "injury_id", "player_sk", "date_day",
        *[attrs[c].alias(c) for c in ("season_week", "day_type", "counts_for_availability")])
    seen = asof_day(days, updates, ["injury_id"], day="date_day", update_day="update_date",
                    order=["updated_at", "bronze_id"], values=["practice_status", "game_status"])
    status = F.coalesce("practice_status", F.lit("DNP"))
    return seen.select(
        surrogate_key(F.col("injury_id"), F.col("date_day")).alias("injury_status_sk"), "injury_id", "player_sk", "date_day",
        "season_week", "day_type", "counts_for_availability", status.alias("practice_status"), "game_status",
        (status == "DNP").alias("is_unavailable"))


def fact_availability(training_load: DataFrame, injury_status: DataFrame, calendar: DataFrame) -> DataFrame:
    """Share of the week's practices and games a player was not held out of."""
    players = training_load.select("player_sk").distinct()
    grid = day_grid(players, scalar(training_load, F.min("date_day")), scalar(training_load, F.max("date_day")))
    attrs = calendar_columns(F.col("date_day"), F.col("_origin"))
    scheduled = (grid.withColumn("_origin", scalar(calendar, F.min("date_day")))
                 .where(attrs["counts_for_availability"])
                 .select("player_sk", "date_day", attrs["season_week"].alias("season_week")))
    missed = injury_status.where("is_unavailable").select("player_sk", "date_day").distinct().withColumn("_missed", F.lit(1))
    n, out = F.count("*"), F.count("_missed")
    return (scheduled.join(missed, ["player_sk", "date_day"], "left").groupBy("player_sk", "season_week")
            .agg(n.alias("scheduled_sessions"), (n - out).alias("available_sessions"), out.alias("missed_sessions"),
                 F.round((n - out) / n, 3).alias("availability_pct"))
            .select(surrogate_key(F.col("player_sk"), F.col("season_week")).alias("availability_sk"), "*"))


def fact_play(plays: DataFrame, snaps: DataFrame, master: DataFrame, calendar: DataFrame) -> DataFrame:
    """Expected points by role, next to snap counts, per player and game."""
    # Read for the roles and again for the games: unpacked and deduplicated once.
    plays = materialise(plays.select("game_id", "game_date", "nfl_week", "posteam", "epa", "success", "passer_player_id",
                                     "rusher_player_id", "receiver_player_id"))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{c}_player_id").alias("gsis"))
                      for r, c in (("pass", "passer"), ("rush", "rusher"), ("receive", "receiver"))])
    parts = (plays.select("game_id", "game_date", "nfl_week", F.col("posteam").alias("team"), "epa", "success",
                          F.explode(roles).alias("r"))
             .where("r.gsis is not null")
             .groupBy("game_id", "game_date", "nfl_week", "team", F.col("r.gsis").alias("gsis"))
             .agg(F.count("*").alias("plays"), F.sum("epa").alias("epa_total"),
                  *[F.sum(F.when(F.col("r.role") == r, F.col("epa"))).alias(f"epa_{r}") for r in ("pass", "rush", "receive")],
                  F.avg("success").alias("success_rate")))
    by_gsis = master.select("player_sk", F.col("gsis_id").alias("_g"))
    epa = parts.join(by_gsis, F.col("gsis") == F.col("_g")).drop("gsis", "_g")
    by_pfr = master.where("pfr_id is not null").select(F.col("player_sk").alias("s_sk"), F.col("pfr_id").alias("_p"))
    measures = ["offense_snaps", "offense_pct", "defense_snaps", "defense_pct", "st_snaps", "st_pct"]
    counted = snaps.join(by_pfr, F.col("pfr_player_id") == F.col("_p")).select(
        "s_sk", F.col("game_id").alias("s_game"), F.col("nfl_week").alias("s_week"), F.col("team").alias("s_team"), "opponent",
        *measures)
    games = plays.select(F.col("game_id").alias("_gid"), F.col("game_date").alias("_gd"),
                         F.col("nfl_week").alias("_gw")).distinct()
    both = epa.join(counted, (F.col("player_sk") == F.col("s_sk")) & (F.col("game_id") == F.col("s_game")), "full")
    both = both.withColumns({"_sk": F.coalesce("player_sk", "s_sk"), "_game": F.coalesce("game_id", "s_game")})
    placed = both.join(games, F.col("_game") == F.col("_gid"), "left")
    first = scalar(calendar, F.min("date_day"))
    last = scalar(calendar, F.max("date_day"))
    placed = placed.withColumns({"_first": first, "_last": last})
    week = F.when(F.col("_gd").between(F.col("_first"), F.col("_last")),
                  calendar_columns(F.col("_gd"), F.col("_first"))["season_week"])
    return placed.select(
        surrogate_key(F.col("_sk"), F.col("_game")).alias("play_sk"), F.col("_sk").alias("player_sk"),
        F.col("_game").alias("game_id"), F.col("_gd").alias("game_date"), week.alias("season_week"),
        F.coalesce("nfl_week", "s_week").alias("nfl_week"), F.coalesce("team", "s_team").alias("team"), "opponent",
        F.coalesce("plays", F.lit(0)).alias("plays"), "epa_total", "epa_pass", "epa_rush", "epa_receive", "success_rate",
        *measures)


def fact_game_weather(sessions: DataFrame, weather: DataFrame, teams: DataFrame, play: DataFrame,
                      calendar: DataFrame) -> DataFrame:
    """Game sessions with the forecast hour they started in at the one stadium with weather."""
    games = (sessions.where("session_type = 'game'")
             .withColumns({"_hour": F.date_trunc("hour", "session_ts"), "stadium_team": scalar(weather, F.max("team"))}))
    home = teams.select(F.col("team_sk").alias("_t"), "stadium", "is_dome")
    measures = ["temperature_c", "apparent_temperature_c", "relative_humidity_pct", "precipitation_mm", "wind_speed_kmh",
                "wind_gusts_kmh", "weather_code"]
    hours = weather.select(F.col("hour_utc").alias("_h"), F.col("team").alias("_wt"), *measures)
    points = (play.groupBy(F.col("player_sk").alias("_sk"), F.col("game_date").alias("_gd"))
              .agg(F.sum("epa_total").alias("epa_total"), F.sum("plays").alias("plays"),
                   F.sum("offense_snaps").alias("offense_snaps")))
    days = calendar.select(F.col("date_day").alias("_day"), "season_week")
    return (games.join(home, F.col("stadium_team") == F.col("_t"))
            .join(hours, (F.col("_hour") == F.col("_h")) & (F.col("stadium_team") == F.col("_wt")), "left")
            .join(days, F.col("session_date") == F.col("_day"), "left")
            .join(points, (F.col("player_sk") == F.col("_sk")) & (F.col("session_date") == F.col("_gd")), "left")
            .select(surrogate_key(F.col("session_id")).alias("game_weather_sk"), "player_sk", "session_id", "session_ts",
                    "session_date", "season_week", "stadium_team", "stadium", "is_dome", "duration_min", "total_distance_m",
                    "high_speed_distance_m", "max_speed_ms", "player_load", "epa_total", "plays", "offense_snaps", *measures,
                    F.col("temperature_c").isNotNull().alias("has_weather")))


def injury_day(injury_status: DataFrame, injury: DataFrame) -> DataFrame:
    """Per player and day: open injuries, worst statuses, parts, next return, oldest event."""
    facts = injury.select(F.col("injury_id").alias("_i"), F.coalesce("body_part", "body_part_raw").alias("_part"),
                          "expected_rtp", "event_date")
    return (injury_status.join(facts, F.col("injury_id") == F.col("_i")).groupBy("player_sk", "date_day").agg(
        F.count_distinct("injury_id").alias("_open"), F.min(units.practice_rank(F.col("practice_status"))).alias("_practice"),
        F.min(units.game_rank(F.col("game_status"))).alias("_game"),
        F.array_join(F.sort_array(F.collect_set("_part")), ", ").alias("open_injury_body_parts"),
        F.min("expected_rtp").alias("expected_return"),
        F.max(F.datediff("date_day", "event_date")).alias("days_since_injury")))


def flag_columns() -> dict[str, Column]:
    """Red and amber reasons of an assembled day (``_delta`` is the readiness difference as decimal)."""
    c = F.col
    one = lambda x: F.round(x, 1).cast("decimal(18,1)").cast("string")
    red = flags((c("availability") == "Out", "out (DNP)"),
                (c("game_status").isin("Out", "Doubtful"), F.concat(F.lit("game status "), F.lower("game_status"))),
                (c("acwr_band") == "high", "ACWR high"))
    amber = flags((c("availability") == "Limited", "limited (LP)"),
                  ((c("availability") == "Available") & (c("open_injuries") > 0), "open injury at full practice"),
                  (c("acwr_band") == "elevated", "ACWR elevated"),
                  (c("_delta") <= -1.5,
                   F.concat(F.lit("readiness "), c("_delta").cast("string"), F.lit(" vs own 28-day mean"))),
                  (F.abs("asymmetry_4w_avg") > 10, F.concat(F.lit("asymmetry "), one(c("asymmetry_4w_avg")), F.lit("%"))),
                  (c("is_silent"), "no wellness survey in 3 days"))
    return {"_red": red, "_amber": amber}


def rank_flag() -> dict[str, Column]:
    hot, warm = F.size("_red") > 0, F.size("_amber") > 0
    return {"flag": F.when(hot, "red").when(warm, "amber").otherwise("green"),
            "flag_rank": F.when(hot, 1).when(warm, 2).otherwise(3),
            "flag_reasons": F.nullif(F.array_join(F.concat("_red", "_amber"), "; "), F.lit(""))}


def fact_player_day(training_load: DataFrame, wellness: DataFrame, strength: DataFrame, nutrition: DataFrame,
                    injury_status: DataFrame, injury: DataFrame) -> DataFrame:
    """The as-of reading of every player on every day.

    Every side is one row per (player, day) before it meets the grid.  The
    carried values travel with their date in one window over the grid, so no
    side is joined twice.
    """
    day_key = ["player_sk", "date_day"]
    answers = ["readiness_score", "soreness", "fatigue", "sleep_hours", "stress", "mood"]
    # Scores have two decimals; decimal arithmetic keeps means and differences exact.
    exact = wellness.withColumn("_score", F.col("readiness_score").cast("decimal(6,2)"))
    well = own_mean(exact, ["player_sk"], "survey_date", "_score", mean_as="_mean", count_as="_surveys")
    well = well.select("player_sk", F.col("survey_date").alias("date_day"), *answers, "_score", "_mean",
                       "_surveys", F.col("survey_date").alias("_survey"))
    tests = first_per_key(strength, ["player_sk", "test_date"],
                          [F.col("test_ts").desc_nulls_first(), F.col("strength_sk").desc()])
    tests = tests.select("player_sk", F.col("test_date").alias("date_day"), F.struct(
        F.col("test_date").alias("d"), F.col("asymmetry_4w_avg").alias("a"), F.col("jump_height_4w_max").alias("j")).alias("_test"))
    weights = nutrition.where("is_preferred").select("player_sk", F.col("measured_on").alias("date_day"), F.struct(
        F.col("measured_on").alias("d"), F.col("weight_lbs").alias("w"), F.col("body_fat_pct").alias("b")).alias("_weigh"))
    day = (training_load.join(well, day_key, "left").join(tests, day_key, "left").join(weights, day_key, "left")
           .join(injury_day(injury_status, injury), day_key, "left"))
    carried = day.withColumns({n: carry_forward(day, ["player_sk"], "date_day", F.col(c)) for n, c in
                               (("last_survey_date", "_survey"), ("_t", "_test"), ("_w", "_weigh"))})
    mean = F.when(F.col("_surveys") >= 7, F.round("_mean", 2))
    since = F.datediff("date_day", "last_survey_date")
    read = carried.withColumns({
        "readiness_28d_mean": mean.cast("double"), "_delta": (F.col("_score") - mean).cast("decimal(6,2)"),
        "days_since_survey": since, "is_silent": F.coalesce(since >= 3, F.lit(True)),
        "last_test_date": F.col("_t.d"), "asymmetry_4w_avg": F.col("_t.a"), "jump_height_4w_max": F.col("_t.j"),
        "last_weigh_in": F.col("_w.d"), "weight_lbs": F.col("_w.w"), "body_fat_pct": F.col("_w.b"),
        "open_injuries": F.coalesce("_open", F.lit(0)), "practice_status": units.label_of(F.col("_practice"), units.PRACTICE),
        "availability": units.label_of(F.col("_practice"), ("Out", "Limited"), other="Available"),
        "game_status": units.label_of(F.col("_game"), units.GAME)})
    flagged = read.withColumns(flag_columns()).withColumns(rank_flag())
    return flagged.select(
        F.col("training_load_sk").alias("player_day_sk"), "player_sk", "date_day", "season_week", "day_type", "sessions",
        "external_load", "internal_load", F.col("acute_7d").alias("load_7d"),
        F.col("chronic_28d").alias("load_28d_avg_week"), "acwr_coupled", "acwr_ewma", "acwr_band", "history_days",
        "readiness_score", "readiness_28d_mean", F.col("_delta").cast("double").alias("readiness_delta"), "soreness", "fatigue", "sleep_hours", "stress", "mood",
        "last_survey_date", "days_since_survey", "is_silent", "last_test_date", "asymmetry_4w_avg", "jump_height_4w_max",
        "last_weigh_in", "weight_lbs", "body_fat_pct", "open_injuries", "practice_status", "availability", "game_status",
        "open_injury_body_parts", "expected_return", "days_since_injury", "flag", "flag_rank", "flag_reasons")
