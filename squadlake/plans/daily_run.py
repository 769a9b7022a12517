"""One full run: validate, resolve, rebuild Silver and Gold, publish the scorecard.

The steps are ordered by plain Python; each table is written once and read
back, so every later step starts from files and an executor lost along the way
costs a recompute of one step only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from squadlake.functions.casts import pct
from squadlake.operators import declared_tests, identity, quality
from squadlake.plans import dims, dq_views, facts, mart, silver, staging, suites
from squadlake.session import intermediates, materialise
from squadlake.sources import seeds
from squadlake.sources.bronze import schema_versions
from squadlake.sources.slices import SliceTable
from squadlake.sources.tables import TableStore

SUMMARY_SCHEMA = (
    "run_id string, source string, rows_in bigint, duplicates_removed bigint, rows_quarantined bigint, "
    "rows_quarantined_dq bigint, rows_quarantined_identity bigint, rows_in_silver bigint, reconciles boolean, "
    "resolved_by map<string,bigint>, pct_units_inferred double, pct_timestamps_reformatted double, "
    "schema_versions_seen map<string,bigint>, expectations_run bigint, expectations_failed bigint, created_at timestamp")


@dataclass
class RunReport:
    run_id: str
    failed_sources: dict[str, str] = field(default_factory=dict)


def result_slices(store: TableStore) -> SliceTable:
    """Every run's results; a repeated run replaces its own."""
    return SliceTable(store.spark, f"{store.root}/dq_expectation_results", quality.RESULT_SCHEMA + ", validated_at timestamp", ("run_id", "source"))


def quarantine_slices(store: TableStore) -> SliceTable:
    """Every run's quarantined records with expectation, observed value and reason, of both kinds."""
    schema = quality.QUARANTINE_SCHEMA + ", quarantined_at timestamp, source string, kind string"
    return SliceTable(store.spark, f"{store.root}/dq_quarantine", schema, ("run_id", "source", "kind"))


def validate_source(store: TableStore, bronze: DataFrame | staging.Unpacked, source: str, run_id: str) -> None:
    """Write the source's results and quarantine, then fail it if the damage is systemic."""
    checks = [quality.Validation(materialise(staging.STAGING[s.table](bronze)), s, run_id) for s in suites.suites_for(source)]
    results = reduce(DataFrame.unionByName, [c.results() for c in checks]).withColumn("validated_at", F.current_timestamp())
    held = reduce(DataFrame.unionByName, [c.quarantine() for c in checks]).withColumn("quarantined_at", F.current_timestamp())
    fresh = store.replace(f"results_{source}", results)
    store.replace(f"quarantine_dq_{source}", held)
    result_slices(store).replace(fresh, run_id=run_id, source=source)
    quarantine_slices(store).replace(held, run_id=run_id, source=source, kind="expectation")
    quality.raise_if_systemic(fresh, [c.suite for c in checks])


def _one(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def silver_source(store: TableStore, bronze: DataFrame | staging.Unpacked, source: str, run_id: str) -> DataFrame:
    """Rebuild a source's facts; returns its one-row count line."""
    players = store.read("dim_player_master")
    vendor_map = store.read("vendor_player_map", identity.PLAYER_MAP_SCHEMA)
    held = quality.quarantined_ids(store.read(f"quarantine_dq_{source}"))
    run = silver.BUILDERS[source](bronze, held, players, vendor_map, run_id)
    inferred = run.profile.get("pct_units_inferred")
    kept_rows, share = F.count(F.lit(1)).alias("rows"), F.max(F.lit(0.0)) if inferred is None else pct(F.count_if(inferred), F.count(F.lit(1)))
    seen_while_written = {name: Observation() for name in run.tables}
    for i, (name, df) in enumerate(run.tables.items()):  # the profile is that of the main table
        store.replace(name, df.observe(seen_while_written[name], kept_rows, *([share.alias("share")] if i == 0 else [])))
    out = [o.get for o in seen_while_written.values()]
    failed = store.replace(f"quarantine_identity_rows_{source}", run.failures.withColumn("quarantined_at", F.current_timestamp()))
    quarantine_slices(store).replace(failed, run_id=run_id, source=source, kind="identity")

    unknown = [identity.identity_quarantine(r, run.vendor) for r in run.resolved]
    store.replace(f"quarantine_identity_{source}", reduce(DataFrame.unionByName, unknown).dropDuplicates(
        ["vendor", "vendor_player_id", "reason"]))
    pins = reduce(DataFrame.unionByName, [identity.new_pins(r, vendor_map, run.vendor) for r in run.resolved])
    store.replace("vendor_player_map", identity.merge_pins(
        vendor_map, pins.dropDuplicates(["vendor", "vendor_player_id"]), F.current_timestamp()))

    feeds = silver.FACT_FEEDS[source]
    seen = reduce(DataFrame.unionByName, [staging.counts(bronze, f) for f in feeds]).agg(
        F.sum("rows_in").cast("bigint").alias("rows_in"), (F.sum("rows_in") - F.sum("rows_kept")).cast("bigint").alias("duplicates_removed"))
    methods = run.resolved[0].identifiers
    if source == "emr":
        methods = methods.select("resolved_by", "occurrences").unionByName(
            run.resolved[1].identifiers.select("resolved_by", "occurrences"))
    by_method = identity.as_map(identity.method_counts(methods), "resolved_by", "records", "resolved_by")
    versions = identity.as_map(schema_versions(reduce(DataFrame.unionByName, [staging.rows_of(bronze, f) for f in feeds])),
                               "schema_version", "records", "schema_versions_seen")
    if run.timestamp_profile is None:
        stamps = F.lit(100.0)
    else:
        kept = quality.without_quarantined(staging.current(bronze, feeds[0]), held)
        stamps = kept.agg(pct(F.count_if(run.timestamp_profile), F.count("*")).alias("v")).scalar()
    scored = store.read(f"results_{source}").agg(F.count("*").alias("expectations_run"),
                                                 F.count_if(~F.col("success")).alias("expectations_failed"))
    line = _one(seen, source).withColumns({
        "rows_quarantined_dq": held.agg(F.count("*").alias("v")).scalar(),
        "rows_quarantined_identity": failed.agg(F.count_distinct("bronze_id").alias("v")).scalar(),
        "rows_in_silver": F.lit(sum(o["rows"] for o in out)).cast("bigint"),
        "pct_units_inferred": F.lit(out[0]["share"]).cast("double"), "pct_timestamps_reformatted": stamps,
        "resolved_by": by_method.scalar(), "schema_versions_seen": versions.scalar(),
        "expectations_run": scored.select("expectations_run").scalar(),
        "expectations_failed": scored.select("expectations_failed").scalar()})
    return store.replace(f"counts_{source}", line)


def write_summary(store: TableStore, lines: list[DataFrame], run_id: str) -> DataFrame:
    """Upsert the run's scorecard and fail if a source does not reconcile."""
    fresh = quality.summarise(reduce(DataFrame.unionByName, lines), run_id, F.current_timestamp())
    fresh = store.replace("dq_run_summary_latest", fresh)
    history = store.read("dq_run_summary", SUMMARY_SCHEMA)
    keys = fresh.select(F.col("run_id").alias("_r"), F.col("source").alias("_s"))
    kept = history.join(keys, (F.col("run_id") == F.col("_r")) & (F.col("source") == F.col("_s")), "left_anti")
    table = store.replace("dq_run_summary", kept.unionByName(fresh.select(*kept.columns)))
    quality.raise_unless_reconciled(fresh)
    return table


def add_missing_tables(store: TableStore) -> None:
    """Empty fact tables for sources that never had a good run, so Gold can be built."""
    if all(store.has(name) for name in silver.TABLES):
        return
    players, vendor_map = store.read("dim_player_master"), store.read("vendor_player_map", identity.PLAYER_MAP_SCHEMA)
    for name, schema in silver.schemas(store.spark, players, vendor_map).items():
        if not store.has(name):
            store.replace(name, store.spark.createDataFrame([], schema))


def build_gold(spark: SparkSession, store: TableStore, bronze: DataFrame, *, start: str = dims.SEASON_START,
               end: str = dims.SEASON_END) -> dict[str, DataFrame]:
    """Dimensions, facts and the mart, each written once."""
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> DataFrame:
        out[name] = store.replace(name, df)
        return out[name]

    read = store.read
    master = read("dim_player_master")
    history = keep("dim_player_snapshot", dims.snapshot_players(
        read("dim_player_snapshot", dims.SNAPSHOT_SCHEMA), master, F.current_timestamp()))
    calendar = keep("dim_date", dims.dim_date(spark, start, end))
    teams = keep("dim_team", dims.dim_team(master, seeds.stadiums(spark)))
    types = keep("dim_injury_type", dims.dim_injury_type(seeds.injury_body_parts(spark)))
    players = keep("dim_player", dims.dim_player(history))
    keep("dim_player_current", dims.dim_player_current(players))
    sessions, surveys, updates = read("catapult_sessions"), read("wellness_surveys"), read("emr_status_updates")
    load = keep("fact_training_load", facts.fact_training_load(sessions, surveys, calendar, start))
    well = keep("fact_wellness", facts.fact_wellness(surveys))
    strength = keep("fact_strength", facts.fact_strength(read("forcedeck_tests")))
    weights = keep("fact_nutrition", facts.fact_nutrition(read("nutrition_measurements")))
    injury = keep("fact_injury", facts.fact_injury(read("emr_injuries"), updates, types))
    status = keep("fact_injury_status", facts.fact_injury_status(injury, updates, calendar))
    avail = keep("fact_availability", facts.fact_availability(load, status, calendar))
    play = keep("fact_play", facts.fact_play(staging.stg_pbp(bronze), staging.stg_snap_counts(bronze), master, calendar))
    keep("fact_game_weather", facts.fact_game_weather(sessions, staging.stg_open_meteo(bronze), teams, play, calendar))
    keep("fact_player_day", facts.fact_player_day(load, well, strength, weights, status, injury))
    keep("mart_player_week", mart.mart_player_week(load, well, strength, weights, avail, injury, status, play, players, calendar))
    return out


TABLE_TESTS = Path(__file__).parent / "table_tests.json"


def test_tables(store: TableStore, bronze: DataFrame) -> DataFrame:
    """Every declared test of the published tables, with the rows that fail it; kept as ``dq_table_tests``."""
    declared = declared_tests.read_declarations(TABLE_TESTS)
    tables = {"stg_pbp": staging.stg_pbp(bronze), "stg_snap_counts": staging.stg_snap_counts(bronze), "dq_quarantine": quarantine_view(store),
              "dq_resolution_by_method": dq_views.resolution_by_method(store.read("vendor_player_map", identity.PLAYER_MAP_SCHEMA)),
              "dq_run_summary": store.read("dq_run_summary", SUMMARY_SCHEMA)}
    return store.replace("dq_table_tests", declared_tests.results({**{n: store.read(n) for n in declared if n not in tables}, **tables}, declared))


def run(spark: SparkSession, bronze: DataFrame, store: TableStore, run_id: str, *, start: str = dims.SEASON_START,
        end: str = dims.SEASON_END) -> RunReport:
    """Master and validation first, then Silver for every source that is not
    systemically broken (a broken one keeps its last good tables), the
    scorecard, and Gold."""
    report = RunReport(run_id)
    with intermediates(spark):  # what is needed is written; nothing reads the intermediates afterwards
        prev = store.read("dim_player_master", dims.MASTER_SCHEMA)
        store.replace("dim_player_master", dims.build_player_master(bronze, prev, F.current_timestamp()))
        lines, feeds = [], staging.Unpacked(bronze)
        for source in silver.BUILDERS:
            try:
                validate_source(store, feeds, source, run_id)
                lines.append(silver_source(store, feeds, source, run_id))
            except quality.SystemicValidationFailure as broken:
                report.failed_sources[source] = str(broken)
            except PySparkException as broken:  # a source whose evaluation raises fails alone
                report.failed_sources[source] = f"evaluation raised: {str(broken).splitlines()[0]}"
        if lines:
            write_summary(store, lines, run_id)
        add_missing_tables(store)
        build_gold(spark, store, bronze, start=start, end=end)
        test_tables(store, bronze)
    return report


def quarantine_view(store: TableStore) -> DataFrame:
    """Current quarantine over every source, expectation and identity failures alike."""
    label = {"ams_wellness": "wellness"}
    parts = {}
    for source in silver.BUILDERS:
        frames = [store.read(n) for n in (f"quarantine_dq_{source}", f"quarantine_identity_rows_{source}") if store.has(n)]
        if frames:
            parts[label.get(source, source)] = reduce(DataFrame.unionByName, frames)
    return dq_views.quarantine_all(parts)
