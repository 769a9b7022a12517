"""The resolution cascade, rule by rule."""

import pytest
from pyspark.sql import functions as F

from squadlake.operators import identity as idn

PLAYERS = ("player_sk bigint, gsis_id string, nfl_id bigint, full_name string, clean_name string, first_name string, last_name string, "
           "football_name string, team string, valid_to timestamp")
ROSTER = [(1, "00-0033873", 44822, "Patrick Mahomes", None, None, None, None, "KC", None),
          (2, "00-0030506", 40011, "Travis Kelce", None, None, None, None, "KC", None),
          (3, "00-0000003", 3, "Josh Allen", None, None, None, None, "BUF", None),
          (4, "00-0000004", 4, "Joshua Allen", None, None, None, None, "JAX", None),
          (5, "00-0000005", None, "Odell Beckham Jr.", None, None, None, None, "LAR", None),
          (6, "00-0033949", None, "Joshua Dobbs", None, "Robert", "Dobbs", None, "DET", None)]
RECORD = "bronze_id bigint, gsis string, nfl string, vid string, name string, team string"


@pytest.fixture(scope="module")
def resolve(spark, rows):
    players = rows(PLAYERS, *ROSTER)

    def run(*records, vendor="v", pins=()):
        vmap = rows(idn.PLAYER_MAP_SCHEMA, *[(*p, None, None) for p in pins])
        df = rows(RECORD, *[(i, *r) for i, r in enumerate(records)])
        return idn.resolve(df, players, vmap, vendor, **{c: F.col(c) for c in ("gsis", "nfl", "vid", "name", "team")}), vmap

    return run


def answers(found):
    return [(r.player_sk, r.resolved_by, r.confidence, r.reason, r.n_candidates) for r in found.records.orderBy("bronze_id").collect()]


def test_rules_in_order(resolve):
    found, _ = resolve(
        ("00-0033873", None, None, "Nobody Real", None), (None, "40011", None, None, None), (None, "40011.0", None, None, None),
        (None, None, None, "Allen, Josh", "buf"), (None, None, None, "JOSHUA ALLEN", "JAX"), (None, None, None, "Travis Kelce", "DEN"),
        (None, None, None, "DOBBS, ROBERT", "DET"), (None, None, None, "Joshua Dobbs", "DET"), (None, None, "cat_1", "Beckham Jr., Odell", None),
        (None, None, "cat_2", "Josh Allen", None), (None, None, None, "Zed Nobody", "KC"), (None, "x", None, "", None))
    assert answers(found) == [
        (1, "gsis_id", 1.0, None, 0), (2, "nfl_id", 1.0, None, 0), (2, "nfl_id", 1.0, None, 0), (3, "name_team", 0.9, None, 0), (4, "name_team", 0.9, None, 0),
        (2, "name_unique", 0.75, None, 0), (6, "name_team", 0.9, None, 0), (6, "name_team", 0.9, None, 0), (5, "name_unique", 0.75, None, 0),
        (None, "unresolved", None, "ambiguous", 2), (None, "unresolved", None, "unresolved", 0), (None, "unresolved", None, "unresolved", 0)]
    counts = {r.resolved_by: r.records for r in idn.method_counts(found.identifiers).collect()}
    assert counts == {"gsis_id": 1, "nfl_id": 2, "name_team": 4, "name_unique": 2, "unresolved": 3}


def test_stored_map_beats_names_and_keeps_its_confidence(resolve):
    found, _ = resolve((None, None, "cat_deadbeef", "Patrick Mahomes", None), vendor="catapult", pins=[("catapult", "cat_deadbeef", 2, "name_unique", 0.75)])
    assert answers(found) == [(2, "vendor_map", 0.75, None, 0)]


def test_pins_are_learned_for_the_next_run_only(resolve):
    found, vmap = resolve((None, None, None, "MAHOMES, PATRICK", "KC"), ("00-0033873", None, None, None, None), vendor="nutrition")
    pins = idn.new_pins(found, vmap, "nutrition")
    assert [tuple(r) for r in pins.collect()] == [("nutrition", "MAHOMES, PATRICK", 1, "name_team", 0.9)]
    again, vmap = resolve((None, None, None, "MAHOMES, PATRICK", "KC"), vendor="nutrition", pins=[tuple(r) for r in pins.collect()])
    assert answers(again) == [(1, "vendor_map", 0.9, None, 0)]
    assert idn.new_pins(again, vmap, "nutrition").count() == 0


def test_quarantine_counts_each_identifier_once(resolve):
    found, _ = resolve(*[(None, None, None, "Zed Nobody", "KC")] * 3, (None, None, "cat_2", "Josh Allen", None), vendor="nutrition")
    q = {r.vendor_player_id: r for r in idn.identity_quarantine(found, "nutrition").collect()}
    assert (q["Zed Nobody"].occurrences, q["Zed Nobody"].reason, q["Zed Nobody"].example_bronze_id) == (3, "unresolved", 0)
    assert (q["cat_2"].reason, q["cat_2"].candidate_sks, q["cat_2"].raw_name) == ("ambiguous", [3, 4], "Josh Allen")


def test_one_identifier_on_most_rows_is_one_row_in_the_cascade(resolve):
    found, _ = resolve(*[(None, None, None, "Travis Kelce", "KC")] * 200, (None, None, None, "Josh Allen", "BUF"))
    assert found.identifiers.count() == 2
    assert found.records.where("player_sk = 2").count() == 200


def test_ambiguous_team_stops_before_the_league_wide_rule(spark, rows):
    twins = [(7, "g7", None, "Sam Lee", None, None, None, None, "NE", None), (8, "g8", None, "Sam Lee", None, None, None, None, "NE", None)]
    players = rows(PLAYERS, *ROSTER, *twins)
    df = rows(RECORD, (1, None, None, None, "Lee, Sam", "ne"))
    found = idn.resolve(df, players, rows(idn.PLAYER_MAP_SCHEMA), "v", name=F.col("name"), team=F.col("team"))
    assert answers(found) == [(None, "unresolved", None, "ambiguous", 2)]
    assert [r.candidate_sks for r in idn.candidate_arrays(found.identifiers, found.index).collect()] == [[7, 8]]
