"""Suites, results, routing, reconciliation."""

import json

import pytest
from pyspark.sql import functions as F

from squadlake.operators import assertions as x
from squadlake.operators import quality as q
from squadlake.plans import staging, suites

SMALL = q.Suite("small", "src", "/v1/x", "stg_x", (
    q.Expectation(q.NOT_NULL, {"column": "id"}), q.Expectation(q.UNIQUE, {"column": "id"}), q.Expectation(q.IN_SET, {"column": "kind", "value_set": ["a", "b"]}),
    q.Expectation(q.BETWEEN, {"column": "v", "min_value": 5, "max_value": 90}), q.Expectation(q.REGEX, {"column": "code", "regex": r"^[A-Z]{2,3}$"}),
    q.Expectation(q.PAIR, {"column_A": "hi", "column_B": "lo", "or_equal": True})))
SCHEMA = "bronze_id bigint, id string, kind string, v double, code string, hi date, lo date"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.sql("""select * from values
        (1L, 'x', 'a', 10D, 'NE', date'2026-08-05', date'2026-08-05'), (2L, 'x', 'c', 113.8D, 'ne', date'2026-08-01', date'2026-08-05'),
        (3L, null, null, null, null, null, date'2026-08-05'), (4L, 'y', 'b', 5D, 'KC', date'2026-08-06', null)
        as t(bronze_id, id, kind, v, code, hi, lo)""")


def test_suites_are_complete():
    assert [len(s.expectations) for s in suites.ALL_SUITES] == [12, 10, 7, 11, 9, 12]
    kinds = [e.type for s in suites.ALL_SUITES for e in s.expectations]
    assert {k: kinds.count(k) for k in set(kinds)} == {q.NOT_NULL: 20, q.UNIQUE: 6, q.IN_SET: 9, q.BETWEEN: 16, q.REGEX: 4, q.PAIR: 6}
    assert [s.name for s in suites.suites_for("emr")] == ["emr_injuries", "emr_status_updates"] and suites.suites_for("nope") == []


def test_suite_columns_exist_in_their_staging_projection(spark):
    bronze = spark.createDataFrame([], "id bigint, payload string, _source string, _endpoint string, _ingested_at timestamp, _schema_version string")
    for s in suites.ALL_SUITES:
        have = set(staging.STAGING[s.table](bronze).columns)
        assert {c for e in s.expectations for c in e.columns} <= have, s.name


def test_results(frame):
    got = {(r.expectation_name, r.column_name): (r.element_count, r.unexpected_count, r.unexpected_percent, r.success, r.systemic)
           for r in q.Validation(frame, SMALL, "r1").results().collect()}
    assert got == {
        (q.NOT_NULL, "id"): (4, 1, 25.0, False, False), (q.UNIQUE, "id"): (4, 2, pytest.approx(200 / 3), False, True),
        (q.IN_SET, "kind"): (4, 1, pytest.approx(100 / 3), False, False), (q.BETWEEN, "v"): (4, 1, pytest.approx(100 / 3), False, False),
        (q.REGEX, "code"): (4, 1, pytest.approx(100 / 3), False, False), (q.PAIR, "lo"): (4, 1, 50.0, False, True)}


def test_quarantine_text(frame):
    v = q.Validation(frame, SMALL, "r1")
    got = {(r.bronze_id, r.expectation_name): r.reason for r in v.quarantine().collect()}
    assert got == {
        (3, q.NOT_NULL): "id is null: id=null", (1, q.UNIQUE): "id is duplicated: id=x", (2, q.UNIQUE): "id is duplicated: id=x",
        (2, q.IN_SET): "kind not in ['a', 'b']: kind=c", (2, q.BETWEEN): "v outside 5..90: v=113.8", (2, q.REGEX): "code does not match ^[A-Z]{2,3}$: code=ne",
        (2, q.PAIR): "hi < lo: hi=2026-08-01, lo=2026-08-05"}
    assert {r.bronze_id for r in v.failed_ids().collect()} == {1, 2, 3}


def test_systemic_and_missing_columns(frame):
    v = q.Validation(frame.drop("v"), SMALL, "r1")
    with pytest.raises(q.SystemicValidationFailure, match="small: v outside 5..90 - column is missing"):
        q.raise_if_systemic(v.results(), [SMALL])
    fine = q.Suite("ok", "src", "e", "t", (q.Expectation(q.NOT_NULL, {"column": "bronze_id"}),))
    q.raise_if_systemic(q.Validation(frame, fine, "r1").results(), [fine])


def test_json_suites_round_trip(tmp_path):
    doc = {"name": "small", "meta": {"source": "src", "endpoint": "/v1/x", "table": "stg_x"},
           "expectations": [{"type": e.type, "kwargs": dict(e.kwargs)} for e in SMALL.expectations]}
    (tmp_path / "small.json").write_text(json.dumps(doc))
    assert q.load_suites(tmp_path) == [SMALL] and q.load_suites(tmp_path, "other") == []


def test_history_upsert_replaces_the_same_run(frame):
    first = q.Validation(frame, SMALL, "r1").results()
    again = q.upsert_results(q.upsert_results(first, q.Validation(frame, SMALL, "r2").results()), q.Validation(frame, SMALL, "r1").results())
    assert again.count() == 12


def test_identity_failures_do_not_count_as_dq(spark, rows):
    qt = rows("bronze_id bigint, run_id string, expectation_name string", (1, "r", "x"), (1, "r", "y"), (2, "r", "player_resolved"), (3, "old", "x"))
    assert {r.bronze_id for r in q.quarantined_ids(qt, "r").collect()} == {1}


def test_reconciliation(rows):
    s = "source string, rows_in bigint, duplicates_removed bigint, rows_quarantined_dq bigint, rows_quarantined_identity bigint, rows_in_silver bigint"
    good = q.summarise(rows(s, ("a", 10, 1, 2, 3, 4)), "r", F.current_timestamp())
    q.raise_unless_reconciled(good)
    bad = q.summarise(rows(s, ("a", 10, 1, 2, 3, 4), ("b", 10, 1, 2, 3, 5)), "r", F.current_timestamp())
    with pytest.raises(q.ReconciliationError, match="b: 10 - 1 - 5 != 5"):
        q.raise_unless_reconciled(bad)


def test_assertions(rows):
    df = rows("k bigint, v bigint", (1, 5), (1, 50), (2, None), (None, 7))
    to = rows("pk bigint", (1,))
    failing = {r.assertion: r.failing_rows for r in x.failures({
        "nn": x.not_null(df, "k"), "u": x.unique(df, "k"), "av": x.accepted_values(df, "v", [5, 7]), "fk": x.relationships(df, "k", to, "pk"),
        "bt": x.is_between(df, "v", 0, 10), "ex": x.expression_is_true(df, "v < 10"), "uc": x.unique_combination(df, ["k", "v"])}).collect()}
    assert failing == {"nn": 1, "u": 1, "av": 1, "fk": 1, "bt": 1, "ex": 1, "uc": 0}
