"""Whole runs over hand-written feeds: reconciliation, quarantine, history, gold assertions."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from squadlake.operators import declared_tests, quality
from squadlake.plans import daily_run, dims, report
from squadlake.sources.bronze import BronzeTable
from squadlake.sources.tables import TableStore

START = date(2026, 7, 20)
DAYS = 35
PEOPLE = [("00-0000001", "Josh Allen", "BUF", "QB"), ("00-0000002", "Joshua Allen", "JAX", "LB"), ("00-0000003", "José Ramírez", "NE", "WR"),
          ("00-0000004", "Joshua Dobbs", "NE", "QB"), ("00-0000005", "Odell Beckham Jr.", "LAR", "WR")]


def iso(day: date, hour: int, offset="-04:00") -> str:
    return f"{day.isoformat()}T{hour:02d}:00:00{offset}"


def roster(people, first="Robert"):
    out = []
    for i, (g, name, team, pos) in enumerate(people):
        given, last = name.split(" ", 1)
        out.append({"player_id": g, "player_name": name, "first_name": first if name == "Joshua Dobbs" else given, "last_name": last.replace(" Jr.", ""),
                    "football_name": given, "team": team, "position": pos, "weight": 200 + i, "height": 74, "espn_id": 100 + i, "pfr_id": f"Pfr{i}"})
    return out


def feeds():
    day = lambda n: START + timedelta(days=n)
    sessions, surveys, tests, weights, injuries, updates = [], [], [], [], [], []
    for p in (2, 3, 4):
        for n in range(DAYS):
            if day(n).isoweekday() < 3:
                continue
            ses = {"session_id": f"s{p}-{n}", "player_id": f"cat_0000000{p}", "session_ts": f"{day(n)}T18:00:00Z", "session_type": "game" if day(n).isoweekday() == 7 else "practice",
                   "duration_min": 60 + p, "total_distance": 5000.0 + n, "high_speed_distance": 400.0, "max_speed": 8.5, "player_load": 300.0 + 10 * n + p,
                   "sprint_count": 10, "accel_count": 1, "decel_count": 1, "distance_unit": "m", "speed_unit": "m/s"}
            if n == 3:
                ses.update(distance_unit="yd", max_speed=19.0)
            if n == 4:
                ses.update(distance_unit=None, speed_unit=None)
            if n == 9:
                ses.update(player_load=None)
            sessions.append(ses)
        for n in range(0, DAYS, 2):
            v2 = n >= 12
            who = {"athlete_id": 1000 + p, "first_name": "x", "last_name": "y", "scale_max": 10} if v2 else {"player_id": 1000 + p, "name": "x y"}
            top = 2 if v2 else 1
            surveys.append({"survey_id": f"w{p}-{n}", **who, "submitted_at": f"{day(n)} 07:15:00" + ("+00:00" if n == 2 else ""), "sleep_hours": 7.5, "sleep_quality": 4 * top,
                            "soreness": 2 * top, "fatigue": 2 * top, "stress": 2 * top, "mood": 4 * top, "srpe": 5})
    surveys.append({**surveys[0], "survey_id": "again", "submitted_at": f"{day(0)} 07:19:00", "mood": 5})
    for n, (force, unit) in enumerate([(562, "N"), (562, None), (562, "lbf"), (2500, None), (2500, "N")]):
        tests.append({"test_id": f"t{n}", "athlete_gsis_id": PEOPLE[2][0], "test_ts": int(datetime(2026, 8, 1 + n).timestamp()), "test_type": "CMJ", "rep": 1, "jump_height_cm": 40.5,
                      "peak_force": force, "force_unit": unit, "rfd": 5000.0, "asymmetry_pct": 12.5, **({"device_id": "d"} if n else {})})
    tests += [{**tests[4], "peak_force": 2501.0}, {**tests[4], "test_id": "aborted", "jump_height_cm": 113.8}, {**tests[4], "test_id": "stranger", "athlete_gsis_id": "00-0009999"}]
    for name, team, unit, lean in (("RAMIREZ, JOSE", "NE", "kg", 80.0), ("Robert Dobbs", "NE", None, 170.0), ("Josh Allen", "SEA", "lb", 170.0)):
        weights.append({"measurement_id": "m" + name, "player_name": name, "team": team, "measured_on": "08/05/2026", "method": "DEXA", "weight": 210.0, "weight_unit": unit,
                        "body_fat_pct": 12.0, "lean_mass": lean, "hydration_status": "mild"})
    injuries.append({"injury_id": "i1", "player": "Dobbs, Robert", "team": "NE", "event_date": iso(day(20), 16), "body_part": "L mcl", "side": None, "injury_type": "sprain",
                     "severity": "minor", "expected_rtp": str(day(20)), "opened_at": iso(day(20), 17)})
    injuries.append({**injuries[0], "injury_id": "i2", "player": "Allen, Josh", "team": "SEA"})
    for n, (uid, inj, status, at) in enumerate([("u1", "i1", "DNP", 21), ("u2", "i1", "LP", 23), ("u2", "i1", "DNP", 22), ("u3", "i1", "FP", 26), ("u4", "gone", "LP", 22), ("u5", "i2", "LP", 22)]):
        updates.append({"update_id": uid, "injury_id": inj, "player": "Ramírez, José" if inj == "gone" else "Dobbs, Robert", "practice_status": status,
                        "game_status": "Questionable" if status == "LP" else None, "note": None, "updated_at": iso(day(at), 16)})
    athletes = [{"athlete_id": f"cat_0000000{p}", "first_name": PEOPLE[p][1].split(" ")[0], "last_name": PEOPLE[p][1].split(" ", 1)[1]} for p in (2, 3, 4)]
    plays = [{"game_id": "g1", "play_id": float(n), "season": 2026, "week": 1, "game_date": str(day(6)), "posteam": "NE", "defteam": "KC", "play_type": "pass",
              "passer_player_id": PEOPLE[3][0], "rusher_player_id": None, "receiver_player_id": PEOPLE[2][0], "epa": 0.5, "qb_epa": 0.5, "success": 1.0, "yards_gained": 5.0, "touchdown": 0.0} for n in range(4)]
    snaps = [{"game_id": "g1", "pfr_game_id": "p1", "season": 2026, "week": 1, "game_type": "REG", "player": "x", "pfr_player_id": f"Pfr{i}", "position": "WR", "team": "NE", "opponent": "KC",
              "offense_snaps": 40.0, "offense_pct": 0.8, "defense_snaps": 0.0, "defense_pct": 0.0, "st_snaps": 2.0, "st_pct": 0.1} for i in (2, 4)]
    weather = [{"stadium": "Gillette Stadium", "team": "NE", "timezone": "America/New_York", "time": f"{day(6)}T{h:02d}:00", "temperature_2m": 20.5 + h, "apparent_temperature": 19.0,
                "relative_humidity_2m": 50, "precipitation": 0.0, "wind_speed_10m": 9.0, "wind_gusts_10m": 15.0, "weather_code": 3, "units": {"temperature_2m": "C"}} for h in (13, 14, 15)]
    return {("nflverse", "rosters"): roster(PEOPLE), ("nflverse", "ids"): [{"gsis_id": g, "nfl_id": 1000.0 + i, "espn_id": None, "pfr_id": None} for i, (g, *_) in enumerate(PEOPLE)],
            ("catapult", "/v1/sessions"): sessions, ("catapult", "/v1/athletes"): athletes, ("ams_wellness", "/v1/surveys"): surveys, ("forcedeck", "/v1/tests"): tests,
            ("nutrition", "/v1/measurements"): weights, ("emr", "/v1/injuries"): injuries, ("emr", "/v1/status_updates"): updates, ("nflverse", "pbp"): plays,
            ("nflverse", "snap_counts"): snaps, ("open_meteo", "forecast"): weather}


def land(spark, table, data, batch):
    for (source, endpoint), docs in data.items():
        df = spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)], "payload string, seq int")
        table.land(df, source=source, endpoint=endpoint, batch_id=f"{batch}{endpoint}", schema_version="v1", order=["seq"])


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("lake")
    table, store = BronzeTable(spark, str(root / "bronze")), TableStore(spark, str(root / "tables"))
    land(spark, table, feeds(), "one")
    first = daily_run.run(spark, table.read(), store, "run-1")
    before = {n: {tuple(map(str, r)) for r in store.read(n).drop("resolved_by", "bronze_id").collect()} for n in ("forcedeck_tests", "catapult_sessions", "emr_status_updates")}
    keys = {r.gsis_id: r.player_sk for r in store.read("dim_player_master").collect()}
    # A traded player, one gone from the roster; a broken forceplate batch.
    moved = [(g, n, "MIA" if g == PEOPLE[2][0] else t, p) for g, n, t, p in PEOPLE if g != PEOPLE[4][0]]
    fresh = BronzeTable(spark, str(root / "bronze2"))
    kept = {k: v for k, v in feeds().items() if k != ("nflverse", "rosters")}
    bad = [{"test_id": f"b{n}", "athlete_gsis_id": PEOPLE[2][0], "test_ts": 1785600000 + n, "test_type": "CMJ", "rep": 1, "jump_height_cm": 120.0, "peak_force": 2500, "force_unit": "N",
            "rfd": 5000.0, "asymmetry_pct": 1.0, "device_id": "d"} for n in range(20)]
    kept[("forcedeck", "/v1/tests")] = kept[("forcedeck", "/v1/tests")] + bad
    land(spark, fresh, {**kept, ("nflverse", "rosters"): roster(moved)}, "two")
    second = daily_run.run(spark, fresh.read(), store, "run-2")
    return {"store": store, "first": first, "second": second, "before": before, "keys": keys}


def changed(key, change):
    """The feeds with one of them changed, or left out if ``change`` gives nothing."""
    data = feeds()
    docs = change(data.pop(key))
    return {**data, **({key: docs} if docs else {})}


@pytest.mark.parametrize("case", ["bad number", "all bad", "missing"])
def test_a_broken_feed_does_not_stop_the_others(spark, tmp_path, case):
    change = {"bad number": lambda docs: [{**d, "rep": "two"} if d["test_id"] == "t0" else d for d in docs],
              "all bad": lambda docs: [{**d, "jump_height_cm": 150.0} for d in docs], "missing": lambda docs: []}[case]
    table, store = BronzeTable(spark, str(tmp_path / "bronze")), TableStore(spark, str(tmp_path / "tables"))
    land(spark, table, changed(("forcedeck", "/v1/tests"), change), "one")
    done = daily_run.run(spark, table.read(), store, "first")
    assert set(done.failed_sources) == ({"forcedeck"} if case == "all bad" else set())
    summary = {r.source: r.reconciles for r in store.read("dq_run_summary").collect()}
    assert {"catapult", "ams_wellness", "nutrition", "emr"} <= set(summary) and all(summary.values())
    assert store.read("mart_player_week").count() > 0 and store.read("fact_strength").count() == (4 if case == "bad number" else 0)
    if case == "bad number":
        held = [r.reason for r in store.read("quarantine_dq_forcedeck").where(F.col("column_name") == quality.UNPARSABLE).collect()]
        assert held == ["unparsable text: unparsable=rep=two"]


def test_first_run_reconciles_every_source(world):
    runs = {r.source: r for r in world["store"].read("dq_run_summary").where("run_id = 'run-1'").collect()}
    assert set(runs) == {"forcedeck", "catapult", "ams_wellness", "nutrition", "emr"} and all(r.reconciles for r in runs.values())
    f = runs["forcedeck"]
    assert (f.rows_in, f.duplicates_removed, f.rows_quarantined_dq, f.rows_quarantined_identity, f.rows_in_silver) == (8, 1, 1, 1, 5)
    assert f.resolved_by == {"gsis_id": 5, "unresolved": 1} and f.schema_versions_seen == {"v1": 8} and (f.expectations_run, f.expectations_failed) == (11, 1)
    assert runs["catapult"].rows_quarantined_dq == 3 and 0 < runs["catapult"].pct_units_inferred < 100
    assert (runs["nutrition"].rows_quarantined_identity, runs["emr"].rows_quarantined_identity) == (1, 2)


def test_readable_quarantine(world):
    reasons = {r.reason for r in world["store"].read("quarantine_identity_rows_nutrition").collect()}
    assert reasons == {f"player ambiguous: 'Josh Allen' (SEA) candidates=[{', '.join(map(str, sorted((world['keys'][PEOPLE[0][0]], world['keys'][PEOPLE[1][0]]))))}]"}
    view = daily_run.quarantine_view(world["store"])
    assert {r.source for r in view.select("source").distinct().collect()} <= {"forcedeck", "catapult", "wellness", "nutrition", "emr"}


def test_force_and_flags(world):
    got = {r.test_id: (r.peak_force_n, r.force_unit_inferred, r.qc_flags) for r in world["store"].read("forcedeck_tests").collect()}
    assert got["t0"] == (2499.9, True, ["force_unit_inferred", "missing_device"]) and got["t2"] == (2499.9, False, []) and got["t4"][0] == 2501.0


def test_wellness_scale_zone_and_resubmission(world):
    rows = {r.survey_id: r for r in world["store"].read("wellness_surveys").collect()}
    first, v2 = rows["w2-0"], rows["w2-12"]
    assert (first.scale_max, first.scale_inferred, first.soreness, first.schema_shape) == (5, True, 3.25, "v1")
    assert (v2.scale_max, v2.scale_inferred, v2.soreness, v2.schema_shape) == (10, False, 4.0, "v2")
    assert rows["w2-2"].tz_corrected and rows["again"].is_resubmission and "resubmission" in rows["again"].qc_flags


def test_injuries_and_updates(world):
    inj = world["store"].read("emr_injuries").collect()
    assert [(r.injury_id, r.body_part, r.side, r.side_source, r.qc_flags) for r in inj] == [
        ("i1", "knee", "L", "text", ["side_from_text", "body_part_free_text", "stale_expected_rtp"])]
    upd = {r.update_id: (r.practice_status, r.is_correction, r.qc_flags) for r in world["store"].read("emr_status_updates").collect()}
    assert upd == {"u1": ("DNP", False, []), "u2": ("LP", True, ["correction_overwrite"]), "u3": ("FP", False, []), "u4": ("LP", False, ["orphan_update"])}
    fact = world["store"].read("fact_injury").first()
    assert (str(fact.return_date), fact.days_out, fact.is_open, fact.body_region, fact.status_updates) == (str(START + timedelta(days=26)), 6, False, "lower_body", 3)
    status = {r.date_day: (r.practice_status, r.game_status) for r in world["store"].read("fact_injury_status").collect()}
    want = {20: ("DNP", None), 21: ("DNP", None), 22: ("DNP", None), 23: ("LP", "Questionable"), 25: ("LP", "Questionable"), 26: ("FP", None)}
    assert len(status) == 7 and all(status[START + timedelta(days=d)] == v for d, v in want.items())


def test_player_day_reads_like_the_rules(world):
    store = world["store"]
    dobbs = world["keys"][PEOPLE[3][0]]
    day = {r.date_day: r for r in store.read("fact_player_day").where(F.col("player_sk") == dobbs).collect()}
    assert len(day) == DAYS
    hurt, back = day[START + timedelta(days=22)], day[START + timedelta(days=26)]
    assert (hurt.flag, hurt.availability, hurt.open_injury_body_parts) == ("red", "Out", "knee") and hurt.flag_reasons.startswith("out (DNP)")
    assert (back.flag, back.availability) == ("amber", "Available") and "open injury at full practice" in back.flag_reasons
    assert day[START].acwr_coupled is None and day[START + timedelta(days=27)].acwr_coupled > 0
    rami = store.read("fact_player_day").where((F.col("player_sk") == world["keys"][PEOPLE[2][0]]) & (F.col("date_day") == str(START + timedelta(days=30)))).first()
    assert "asymmetry 12.5%" in rami.flag_reasons and rami.weight_lbs == 210.0


def test_declared_tests_hold(world):
    found = world["store"].read("dq_table_tests").collect()
    assert len(found) == declared_tests.count(declared_tests.read_declarations(daily_run.TABLE_TESTS)) == 114
    assert {(r.table_name, r.test, r.subject): r.failing_rows for r in found if r.failing_rows} == {}


def test_runs_keep_their_own_slices(world):
    store = world["store"]
    results, held = (slices(store).read() for slices in (daily_run.result_slices, daily_run.quarantine_slices))
    assert {(r.run_id, r.source) for r in results.select("run_id", "source").distinct().collect()} == {(run, s) for run in ("run-1", "run-2") for s in daily_run.silver.BUILDERS}
    kinds = {(r.kind, r.expectation_name) for r in held.where("kind = 'identity'").select("kind", "expectation_name").distinct().collect()}
    assert kinds == {("identity", "player_resolved")} and held.where("reason is null").count() == 0
    view = {(r.bronze_id, r.expectation_name, r.reason) for r in daily_run.quarantine_view(store).where("source = 'nutrition'").collect()}
    last = {(r.bronze_id, r.expectation_name, r.reason) for r in held.where("source = 'nutrition' and run_id = 'run-2'").collect()}
    assert view == last and last


def test_plays_and_weather(world):
    play = {r.player_sk: r for r in world["store"].read("fact_play").collect()}
    k = world["keys"]
    assert (play[k[PEOPLE[3][0]]].epa_pass, play[k[PEOPLE[3][0]]].offense_snaps) == (2.0, None)
    assert (play[k[PEOPLE[2][0]]].epa_receive, play[k[PEOPLE[2][0]]].offense_snaps, play[k[PEOPLE[2][0]]].season_week) == (2.0, 40, 1)
    assert (play[k[PEOPLE[4][0]]].plays, play[k[PEOPLE[4][0]]].epa_total) == (0, None)
    games = world["store"].read("fact_game_weather").where("has_weather").collect()
    assert {(r.stadium, r.temperature_c) for r in games} == {("Gillette Stadium", 34.5)}   # 18:00 UTC is 14:00 local


def test_second_run_fails_only_the_broken_source(world):
    assert list(world["second"].failed_sources) == ["forcedeck"] and world["first"].failed_sources == {}
    assert "jump_height_cm outside 5..90" in world["second"].failed_sources["forcedeck"]
    store = world["store"]
    assert {r.source for r in store.read("dq_run_summary").where("run_id = 'run-2'").collect()} == {"catapult", "ams_wellness", "nutrition", "emr"}
    now = {n: {tuple(map(str, r)) for r in store.read(n).drop("resolved_by", "bronze_id").collect()} for n in ("forcedeck_tests", "emr_status_updates")}
    assert now == {n: world["before"][n] for n in now}      # last good table, and a pure function of Bronze
    assert store.read("results_forcedeck").where("systemic").count() >= 1


def test_keys_are_stable_and_changes_become_versions(world):
    store = world["store"]
    assert {r.gsis_id: r.player_sk for r in store.read("dim_player_master").collect()} == world["keys"]
    versions = store.read("dim_player").groupBy("gsis_id").agg(F.count("*").alias("n"), F.max_by("team", "valid_from").alias("team"), F.max_by("on_roster", "valid_from").alias("on")).collect()
    got = {r.gsis_id: (r.n, r.team, r.on) for r in versions}
    assert got[PEOPLE[2][0]] == (2, "MIA", True) and got[PEOPLE[4][0]] == (2, "LAR", False) and got[PEOPLE[0][0]] == (1, "BUF", True)
    methods = {(r.vendor, r.resolved_by) for r in store.read("vendor_player_map").collect()}
    assert ("catapult", "name_unique") in methods and ("nutrition", "name_team") in methods
    sessions = {r.resolved_by for r in store.read("catapult_sessions").select("resolved_by").distinct().collect()}
    assert sessions == {"vendor_map"}     # pinned by the first run


def test_report_over_gold(world):
    store = world["store"]
    pd, players = store.read("fact_player_day"), store.read("dim_player_current")
    cards = report.cards(pd, store.read("fact_injury_status"), days_back=12).first()
    assert cards.players == cards.red + cards.amber + cards.green == 3 and cards.open_injuries == 1 and cards.limited == 0 and cards.out == 1
    board = report.roster_board(pd, players, days_back=12, team=None).collect()
    assert [r.flag_rank for r in board] == sorted(r.flag_rank for r in board)
    assert report.roster_board(pd, players, days_back=12).count() == 1
    runs = daily_run.dq_views.run_summary(store.read("dq_run_summary"))
    assert report.run_cards(runs).first().reconciles == "All sources reconcile"


def test_mismatch_fails_the_run(world, spark):
    lines = world["store"].read("counts_nutrition").withColumn("rows_in", F.lit(99).cast("bigint"))
    with pytest.raises(quality.ReconciliationError, match="nutrition"):
        daily_run.write_summary(world["store"], [lines], "run-bad")
