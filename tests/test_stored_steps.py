"""Steps that several consumers read are done once, and stored rows hold only what is read of them."""

import json

import __spark_entry__ as entry
import conftest
from pyspark.sql import functions as F

from squadlake.operators import quality
from squadlake.plans import staging
from squadlake.sources.bronze import BronzeTable

BRONZE = "id bigint, payload string, _source string, _endpoint string, _ingested_at timestamp, _schema_version string"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def landed(spark, feed, *docs):
    rows = [(i, json.dumps(d), feed.source, feed.endpoint, None, None) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, BRONZE)


def test_unpacked_records_leave_the_payload_behind(spark):
    docs = [{"test_id": "a", "device_id": None}, {"test_id": "b"}, {"test_id": "c", "device_id": "d1"}, {"test_id": "b", "pad": "x" * 50}]
    feeds = staging.Unpacked(landed(spark, staging.FORCEDECK, *docs))
    rows = feeds.current(staging.FORCEDECK)
    assert "payload" not in rows.columns
    there = {r.test_id: r.there for r in rows.select("test_id", staging.has_key("device_id").alias("there")).collect()}
    assert there == {"a": True, "b": False, "c": True} and feeds.counts(staging.FORCEDECK) == {"rows_in": 4, "rows_kept": 3}


def test_status_updates_are_unpacked_once(spark):
    docs = [{"update_id": "u1", "injury_id": "i", "updated_at": "2024-01-01T10:00:00-05:00", "practice_status": p} for p in ("LP", "FP")]
    bronze = landed(spark, staging.STATUS_UPDATES, *docs)
    staged = staging.stg_emr_status_updates(staging.Unpacked(bronze))
    assert "from_json" not in plan(staged)
    assert staged.select("practice_status").collect() == staging.stg_emr_status_updates(bronze).select("practice_status").collect()


def test_silver_reads_stored_rows(spark):
    """Records, held ids, roster and vendor map of a build are read back; none is derived again for each reader."""
    query = entry.queries()["silver_emr_injuries"]
    assert "from_json" not in plan(query(spark, conftest.SF)) and "get_json_object" not in plan(query(spark, conftest.SF))


def test_trend_report_reads_a_stored_fact(spark):
    """The trailing frames are computed once, for the player-day fact and the report alike."""
    assert "Window" not in plan(entry.queries()["asymmetry_trend"](spark, conftest.SF))


def test_ids_of_a_quarantine_cost_no_texts(spark):
    frame = spark.createDataFrame([(1, None, 5.0), (2, "a", 0.25), (3, None, 0.5), (4, "a", 2.0)], "bronze_id bigint, kind string, size double")
    suite = quality.Suite("s", "src", "/e", "t", (quality.Expectation(quality.NOT_NULL, {"column": "kind"}),
                                                  quality.Expectation(quality.BETWEEN, {"column": "size", "min_value": 1, "max_value": 9})))
    held = quality.Validation(frame, suite, "r1").quarantine()
    assert "kind is null" not in plan(held.select("bronze_id").distinct())
    assert sorted((r.bronze_id, r.column_name, r.observed_value, r.reason) for r in held.collect()) == [
        (1, "kind", "kind=null", "kind is null: kind=null"), (2, "size", "size=0.25", "size outside 1..9: size=0.25"),
        (3, "kind", "kind=null", "kind is null: kind=null"), (3, "size", "size=0.5", "size outside 1..9: size=0.5")]


def test_a_batch_indexes_what_it_adds(spark, tmp_path):
    table = BronzeTable(spark, str(tmp_path / "bronze"))
    docs = lambda *ids: spark.createDataFrame([(json.dumps({"id": i}),) for i in ids], "payload string")
    for batch, ids, new in (("a", range(20), 20), ("b", range(10, 40), 20), ("again", range(40), 0), ("c", (5, 40, 40), 1)):
        assert table.land(docs(*ids), source="s", endpoint="/e", batch_id=batch).inserted == new
    assert table.index.names(table.index.hashes) == {"0000000", "0000001", "0000003"}
    held = [r.digest for n in (0, 1, 3) for r in spark.read.parquet(f"{table.index.hashes}/{n:07d}").collect()]
    assert sorted(held) == sorted(r[0] for r in table.read().select("_payload_hash").collect())
    assert table.index.missing(f"{table.path}_claims") == [] and table.read().agg(F.count("*").alias("n")).first().n == 41
