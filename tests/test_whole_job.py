"""Queries that once read or returned a part of their input."""

import pytest
from conftest import SF

import __spark_entry__ as entry


def test_game_sessions_meet_plays_and_snaps(spark):
    got = entry.queries()["hourly_match_plays"](spark, SF).selectExpr("count(epa_total) AS e", "count(plays) AS p", "count(offense_snaps) AS s").first()
    assert got.e and got.p and got.s


@pytest.mark.parametrize("name", ["quarantine_union_rows", "reconcile_sources", "profile_percentages_sources"])
def test_all_five_sources_have_rows(spark, name):
    got = entry.queries()[name](spark, SF).select("source").distinct().collect()
    assert {r.source for r in got} == {"forcedeck", "catapult", "ams_wellness", "nutrition", "emr"}
