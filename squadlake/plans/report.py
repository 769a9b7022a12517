"""Report measures and page queries.

The disconnected pickers of the report are plain parameters: ``days_back``
(0..60) and ``window_days`` (28, or 400 for the season).  The as-of day is
always taken from the unfiltered table, so team or position filters never
move it; it is a scalar subquery, so the day filter is applied at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.operators.timeseries import scalar

DAYS_BACK = range(0, 61)
WINDOWS = {"28 days": 28, "Season": 400}


def as_of(player_day: DataFrame, days_back: int = 0) -> Column:
    return F.date_sub(scalar(player_day, F.max("date_day")), days_back)


def on_day(df: DataFrame, player_day: DataFrame, days_back: int = 0) -> DataFrame:
    return df.where(F.col("date_day") == as_of(player_day, days_back))


def in_window(df: DataFrame, player_day: DataFrame, days_back: int = 0, window_days: int = 28, day: str = "date_day") -> DataFrame:
    d = as_of(player_day, days_back)
    return df.where((F.col(day) > F.date_sub(d, window_days)) & (F.col(day) <= d))


def with_player(df: DataFrame, players: DataFrame, *, team: str | None = None, position: str | None = None,
                player: str | None = None) -> DataFrame:
    """Many-to-one join to the player dimension; filters restrict the dimension side."""
    who = players.select(F.col("player_sk").alias("_sk"), "full_name", "team", "position")
    wanted = {"team": team, "position": position, "full_name": player}
    for c, v in wanted.items():
        if v is not None:
            who = who.where(F.col(c) == v)
    how = "inner" if any(v is not None for v in wanted.values()) else "left"
    mine = df.drop("full_name", "team", "position")
    return mine.join(who, F.col("player_sk") == F.col("_sk"), how).drop("_sk")


def _load_ratio(load: Column, norm: Column) -> Column:
    return F.try_divide(load - norm, norm)


def cards(player_day: DataFrame, injury_status: DataFrame, players: DataFrame | None = None, *, days_back: int = 0,
          team: str | None = None, position: str | None = None) -> DataFrame:
    """Every count and load card of a page, one row, one pass over the as-of day."""
    d = as_of(player_day, days_back)
    rows = on_day(player_day, player_day, days_back)
    hurt = on_day(injury_status, player_day, days_back)
    if players is not None and (team or position):
        rows = with_player(rows, players, team=team, position=position)
        hurt = with_player(hurt, players, team=team, position=position)
    n = lambda c, v: F.count_if(F.col(c) == v)
    load, norm = F.sum("load_7d"), F.sum("load_28d_avg_week")
    one = rows.agg(F.count_distinct("player_sk").alias("players"), n("flag", "red").alias("red"), n("flag", "amber").alias("amber"),
                   n("flag", "green").alias("green"), n("availability", "Out").alias("out"),
                   n("availability", "Limited").alias("limited"), F.count_if("is_silent").alias("silent"),
                   load.alias("load_7d"), norm.alias("load_norm"), _load_ratio(load, norm).alias("load_vs_norm"),
                   F.avg("acwr_coupled").alias("acwr"))
    return one.select(d.alias("as_of"), F.date_format(d, "EEE d MMM yyyy").alias("as_of_label"), "*",
                      scalar(hurt, F.count_distinct("injury_id")).alias("open_injuries"))


def selected(players: DataFrame) -> DataFrame:
    """Name, position and team when the filtered dimension holds exactly one value, else NULL."""
    only = lambda c, n: F.when(F.count_distinct(c) == 1, F.max(c)).alias(n)
    return players.agg(only("full_name", "selected_player"), only("position", "selected_position"),
                       only("team", "selected_team"))


def player_header(player_day: DataFrame, days_back: int = 0) -> DataFrame:
    """The as-of reading of each player as header values."""
    cols = {"flag": "flag", "availability": "availability", "game_status": "game_status", "readiness_score": "readiness",
            "acwr_band": "acwr_band", "weight_lbs": "weight_lb", "flag_reasons": "flag_reasons"}
    return on_day(player_day, player_day, days_back).groupBy("player_sk").agg(*[F.max(c).alias(n) for c, n in cols.items()])


def run_cards(dq_runs: DataFrame) -> DataFrame:
    """The data page's cards over the latest run."""
    latest = dq_runs.where("run_recency = 1")
    total = lambda c: F.sum(c)
    passed = total("expectations_run") - total("expectations_failed")
    return latest.agg(
        F.max("created_at").alias("last_run"), total("rows_in").alias("rows_in"), total("rows_in_silver").alias("rows_in_silver"),
        F.try_divide(total("rows_quarantined"), total("rows_in")).alias("quarantined_share"),
        F.when(F.count_if(~F.col("reconciles")) == 0, "All sources reconcile").otherwise("RECONCILIATION FAILED").alias("reconciles"),
        F.concat(passed.cast("bigint").cast("string"), F.lit(" / "),
                 total("expectations_run").cast("bigint").cast("string")).alias("expectations"))


def roster_board(player_day: DataFrame, players: DataFrame, *, days_back: int = 0, team: str | None = "NE",
                 position: str | None = None) -> DataFrame:
    rows = with_player(on_day(player_day, player_day, days_back), players, team=team, position=position)
    return rows.select(
        "flag", "full_name", "position", "availability", "game_status", "readiness_score", "readiness_delta", "acwr_coupled",
        "load_7d", "days_since_survey", "open_injury_body_parts", "expected_return", "flag_reasons", "flag_rank"
    ).orderBy("flag_rank", F.col("readiness_score").asc_nulls_last(), F.col("full_name").asc_nulls_last())


def load_vs_norm(player_day: DataFrame, players: DataFrame, *, days_back: int = 0, top: int | None = None,
                 team: str | None = None) -> DataFrame:
    """Seven-day load against each player's own norm, biggest excess first."""
    rows = with_player(on_day(player_day, player_day, days_back), players, team=team)
    load, norm = F.sum("load_7d"), F.sum("load_28d_avg_week")
    out = rows.groupBy("player_sk", "full_name").agg(load.alias("load_7d"), norm.alias("load_norm"),
                                                     _load_ratio(load, norm).alias("load_vs_norm"))
    out = out.orderBy(F.col("load_vs_norm").desc_nulls_last(), "player_sk")
    return out if top is None else out.limit(top)


def band_by_day(player_day: DataFrame, *, days_back: int = 0, window_days: int = 400) -> DataFrame:
    rows = in_window(player_day, player_day, days_back, window_days)
    return rows.groupBy("date_day", "acwr_band").agg(F.count("*").alias("players"))


def load_table(player_day: DataFrame, players: DataFrame, *, days_back: int = 0, team: str | None = None) -> DataFrame:
    rows = with_player(on_day(player_day, player_day, days_back), players, team=team)
    return rows.select("full_name", "load_7d", "load_28d_avg_week",
                       _load_ratio(F.col("load_7d"), F.col("load_28d_avg_week")).alias("load_vs_norm"), "acwr_coupled",
                       "acwr_band", "sessions").orderBy(F.col("load_vs_norm").desc_nulls_last(), F.col("full_name").asc_nulls_last())


def injury_report(injury_status: DataFrame, injury: DataFrame, players: DataFrame, player_day: DataFrame, *,
                  days_back: int = 0, team: str | None = None) -> DataFrame:
    """Open injuries on the as-of day, most restricted first."""
    facts = injury.select(F.col("injury_id").alias("_i"), "body_part", "side", "injury_type", "severity", "event_date",
                          "expected_rtp", "days_out")
    rows = on_day(injury_status, player_day, days_back).join(facts, F.col("injury_id") == F.col("_i"))
    rows = with_player(rows, players, team=team)
    rank = F.when(F.col("practice_status") == "DNP", 1).when(F.col("practice_status") == "LP", 2).otherwise(3)
    return rows.orderBy(rank, F.col("full_name").asc_nulls_last(), "injury_id").select(
        "injury_id", "full_name", "position", "body_part", "side", "injury_type", "severity", "practice_status", "game_status", "event_date",
        "expected_rtp", "days_out")


def injuries_by_region(injury: DataFrame) -> DataFrame:
    return injury.groupBy("body_region").agg(F.count("*").alias("injuries")).orderBy(F.desc("injuries"), "body_region")


# Severities and regions of the matrix.
SEVERITIES = ("minor", "moderate", "major")
REGIONS = ("lower_body", "upper_body", "head")


UNMAPPED = "unmapped"


def severity_matrix(injury: DataFrame) -> DataFrame:
    """Counts by severity (rows) and body region (columns).  The column list is fixed,
    so it is one pass; injuries of no or another region count as unmapped."""
    region = F.when(F.col("body_region").isin(*REGIONS), F.col("body_region")).otherwise(UNMAPPED)
    columns = [*REGIONS, UNMAPPED]
    return injury.withColumn("_region", region).groupBy("severity").pivot("_region", columns).agg(F.count(F.lit(1))).na.fill(0, columns)


def run_table(dq_runs: DataFrame) -> DataFrame:
    return dq_runs.where("run_recency = 1").select(
        "source", "rows_in", "duplicates_removed", "rows_quarantined", "rows_in_silver", "reconciles", "expectations_failed",
        "pct_units_inferred").orderBy("source")


def quarantine_trend(dq_runs: DataFrame, runs: int = 12) -> DataFrame:
    return dq_runs.where(F.col("run_recency") <= runs).groupBy("created_at", "source").agg(
        F.sum("rows_quarantined").alias("rows_quarantined"))


def player_trends(player_day: DataFrame, *, days_back: int = 0, window_days: int = 28) -> DataFrame:
    """Daily series of the player page, per player; filter by player_sk for one page."""
    rows = in_window(player_day, player_day, days_back, window_days)
    return rows.groupBy("player_sk", "date_day").agg(
        F.avg("acwr_coupled").alias("acwr_coupled"), F.avg("acwr_ewma").alias("acwr_ewma"),
        F.sum("external_load").alias("external_load"), F.avg("readiness_score").alias("readiness_score"),
        F.avg("readiness_28d_mean").alias("readiness_28d_mean"), F.avg("weight_lbs").alias("weight_lbs"))


def asymmetry_trend(strength: DataFrame, player_day: DataFrame, *, days_back: int = 0, window_days: int = 28) -> DataFrame:
    rows = in_window(strength, player_day, days_back, window_days, day="test_date")
    return rows.groupBy("player_sk", "test_date").agg(F.avg("asymmetry_pct").alias("asymmetry_pct"),
                                                      F.avg("asymmetry_4w_avg").alias("asymmetry_4w_avg"))


def player_injuries(injury: DataFrame, player_sk: int | Column | None = None) -> DataFrame:
    rows = injury if player_sk is None else injury.where(F.col("player_sk") == player_sk)
    return rows.select("player_sk", "body_part", "side", "severity", "event_date", "return_date", "days_out",
                       "expected_rtp").orderBy("event_date")
