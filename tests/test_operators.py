"""Dedup, windows, grids, as-of, numbering and slowly changing tables against brute force."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from squadlake.operators import declared_tests as dt
from squadlake.operators.asof import asof_day
from squadlake.operators.dedup import attach_group, dedup_counts, first_per_key, flag_first, flag_repeats, last_wins, latest_per_key, latest_with_count
from squadlake.operators.numbering import number_new_keys
from squadlake.operators.scd import advance, scd2_merge, upsert_retire, version_history, versions
from squadlake.operators.timeseries import day_grid, ewma, explode_days
from squadlake.operators.windows import sliding_stats
from squadlake.sources.slices import SliceTable

T0 = datetime(2026, 8, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def skewed(rows):
    """One key holds most rows, many at the same instant and on slice edges."""
    rnd = random.Random(7)
    data = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{i % 17}"
        at = T0 + timedelta(hours=rnd.randrange(24 * 90)) if i % 5 else T0 + timedelta(days=rnd.randrange(90))
        data.append((i, key, at, None if i % 11 == 0 else round(rnd.uniform(-20, 20), 3)))
    return data, rows("id bigint, k string, ts timestamp, v double", *data)


@pytest.mark.parametrize("slice_days", [1, 9])
def test_sliding_stats_match_brute_force(skewed, slice_days):
    data, df = skewed
    day = 86_400
    frames = {"now": (27 * day, 0), "before": (54 * day, 27 * day)}
    got = {r.id: r for r in sliding_stats(df, ["k"], "ts", frames=frames, slice_seconds=slice_days * day,
                                          stats={"s": ("v", "sum"), "n": ("v", "count"), "hi": ("v", "max"), "lo": ("v", "min")}).collect()}
    assert len(got) == len(data)
    for i, k, at, _ in data:
        for name, (far, near) in frames.items():
            vs = [v for _, k2, at2, v in data if k2 == k and at - timedelta(seconds=far) <= at2 <= at - timedelta(seconds=near) and v is not None]
            r = got[i]
            assert r[f"{name}_n"] == len(vs)
            assert (r[f"{name}_hi"], r[f"{name}_lo"]) == ((max(vs), min(vs)) if vs else (None, None))
            assert r[f"{name}_s"] == (pytest.approx(sum(vs), abs=1e-9) if vs else None)


def test_sliding_stats_never_partitions_by_the_key_alone(skewed):
    _, df = skewed
    out = sliding_stats(df, ["k"], "ts", frames={"w": (27 * 86_400, 0)}, stats={"n": ("v", "count")})
    raw_windows = [line for line in plan(out).split("== Physical Plan ==")[1].splitlines() if "Window [" in line and "_off" in line]
    assert raw_windows and all("_slice" in line for line in raw_windows)


def test_sliding_stats_rejects_uneven_frames(skewed):
    with pytest.raises(ValueError):
        sliding_stats(skewed[1], ["k"], "ts", frames={"w": (100, 0)}, stats={"n": ("v", "count")})


def test_latest_per_key_collapses_before_the_shuffle(skewed):
    data, df = skewed
    out = latest_per_key(df, ["k"], ["ts", "id"])
    assert plan(out).split("== Physical Plan ==")[1].count("WindowGroupLimit") == 2
    want = {k: max((at, i) for i, k2, at, _ in data if k2 == k)[1] for k in {d[1] for d in data}}
    assert {r.k: r.id for r in out.collect()} == want
    assert {r.k: r.id for r in latest_per_key(df.orderBy(F.rand(3)), ["k"], ["ts", "id"]).collect()} == want
    both = {r.k: (r.id, r.versions) for r in latest_with_count(df, ["k"], ["ts", "id"]).collect()}
    assert both == {k: (i, sum(d[1] == k for d in data)) for k, i in want.items()}
    assert tuple(dedup_counts(df, ["k"]).first()) == (900, len(want), 900 - len(want))


def test_group_flags(rows):
    df = rows("id bigint, k string, m int", (1, "a", 3), (2, "a", 1), (3, "a", 1), (4, None, 2), (5, None, 1))
    assert {r.id: r.f for r in flag_first(df, ["k"], [F.col("m")], "id", "f").collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}
    assert {r.id: r.is_repeat for r in flag_repeats(df, ["k"], ["m", "id"]).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}
    assert {r.id: r.n for r in attach_group(df, ["k"], n=F.count("*")).collect()} == {1: 3, 2: 3, 3: 3, 4: 2, 5: 2}
    x = rows("g string, _ingested_at int, id int", (None, 1, 1), ("", 1, 2), ("a", 1, 3), ("a", 2, 4))
    assert [r.id for r in last_wins(x, "g").collect()] == [4]
    assert [r.id for r in first_per_key(df, ["k"], [F.col("m").asc(), F.col("id").desc()]).orderBy("id").collect()] == [3, 5]


def test_grid_and_backward_spans(rows):
    g = day_grid(rows("k string", ("a",), ("b",)), F.lit(date(2026, 8, 1)), F.lit(date(2026, 8, 3)))
    assert g.count() == 6
    spans = rows("k string, s date, e date", ("a", date(2026, 8, 3), date(2026, 8, 1)), ("b", date(2026, 8, 1), date(2026, 8, 1)))
    assert [(r.k, r.date_day) for r in explode_days(spans, "s", "e").collect()] == [("b", date(2026, 8, 1))]


@pytest.mark.parametrize("look_back", [1, 3, 7, 56])
def test_ewma_weights(rows, look_back):
    rnd = random.Random(look_back)
    loads = {k: [rnd.choice([0.0, 0.0, 1e-3, 37.25, 1e4]) for _ in range(n)] for k, n in (("a", 1), ("b", 5), ("c", 130), ("d", 57))}
    starts = {"a": date(2026, 8, 1), "b": date(1969, 12, 30), "c": date(2026, 2, 11), "d": date(2026, 3, 1)}
    grid = rows("k string, d date, x double", *[(k, starts[k] + timedelta(i), x) for k, xs in loads.items() for i, x in enumerate(xs)])
    out = ewma(grid, ["k"], "d", "x", look_back, {"fast": 0.25, "slow": 2 / 29})
    assert out.columns == ["k", "d", "x", "fast", "slow"]
    got = {(r.k, (r.d - starts[r.k]).days): r for r in out.collect()}
    assert len(got) == sum(map(len, loads.values()))
    for (k, i), r in got.items():
        own = loads[k][max(0, i - look_back + 1):i + 1][::-1]
        for name, decay in (("fast", 0.25), ("slow", 2 / 29)):
            w = [(1 - decay) ** j for j in range(len(own))]
            assert r[name] == pytest.approx(sum(a * b for a, b in zip(w, own)) / sum(w), rel=1e-12, abs=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_asof_sees_updates_before_the_grid_and_late_corrections(rows):
    grid = rows("i string, d date", *[("x", date(2026, 8, d)) for d in (3, 4, 5, 6)], ("y", date(2026, 8, 3)))
    upd = rows("i string, ud date, at timestamp, bronze_id bigint, s string",
               ("x", date(2026, 8, 1), datetime(2026, 8, 1, 9), 1, "DNP"), ("x", date(2026, 8, 5), datetime(2026, 8, 5, 9), 2, "LP"),
               ("x", date(2026, 8, 5), datetime(2026, 8, 5, 8), 3, "FP"), ("z", date(2026, 8, 1), datetime(2026, 8, 1, 9), 4, "FP"))
    out = asof_day(grid, upd, ["i"], day="d", update_day="ud", order=["at", "bronze_id"], values=["s"])
    assert sorted((r.i, r.d.day, r.s) for r in out.collect()) == [("x", 3, "DNP"), ("x", 4, "DNP"), ("x", 5, "LP"), ("x", 6, "LP"), ("y", 3, None)]


def test_numbers_are_dense_repeatable_and_order_free(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    one = {r.k: r.n for r in number_new_keys(keys, "k", F.lit(10), "n").collect()}
    two = {r.k: r.n for r in number_new_keys(keys.orderBy(F.rand(1)), "k", F.lit(10), "n").collect()}
    assert one == two and sorted(one.values()) == list(range(11, 5011))


MASTER = "sk bigint, k string, team string, note string, valid_from timestamp, valid_to timestamp, updated_at timestamp"


def test_upsert_keeps_retires_and_revives(rows):
    t = [T0 + timedelta(days=d) for d in range(4)]
    lit = lambda d: F.lit(t[d])
    up = lambda prev, d, *snap: upsert_retire(prev, rows("k string, team string, note string", *snap), key="k", sk="sk", compare=["team"], now=lit(d))
    one = up(rows(MASTER), 0, ("a", "NE", "x"), ("b", "KC", "x"), ("c", None, "x"))
    by = {r.k: r for r in one.collect()}
    assert sorted(r.sk for r in by.values()) == [1, 2, 3]
    two = up(one, 1, ("a", "SF", "y"), ("b", "KC", "y"), ("d", "NE", "y"))
    now = {r.k: r for r in two.collect()}
    assert (now["a"].sk, now["a"].team, now["a"].note, now["a"].updated_at) == (by["a"].sk, "SF", "y", t[1])
    assert (now["b"].note, now["b"].updated_at) == ("x", t[0])         # only compared columns trigger
    assert (now["c"].valid_to, now["c"].sk) == (t[1], by["c"].sk)       # retired once
    assert now["d"].sk == 4
    three = {r.k: r for r in up(two, 2, ("c", None, "z"), ("b", "KC", "z")).collect()}
    assert (three["c"].valid_to, three["c"].sk, three["c"].updated_at, three["c"].valid_from) == (None, by["c"].sk, t[2], t[0])
    assert three["a"].valid_to == t[2]


def test_scd2_only_tracked_columns_open_versions(rows):
    hist = rows("k bigint, team string, nfl bigint, valid_from timestamp, valid_to timestamp")
    snap = lambda *r: rows("k bigint, team string, nfl bigint", *r)
    at = [F.lit(T0 + timedelta(days=d)) for d in range(3)]
    h = scd2_merge(hist, snap((1, "NE", 1), (2, None, 1), (3, "KC", 1)), key="k", check=["team"], now=at[0])
    h = scd2_merge(h, snap((1, "NE", 9), (2, "SF", 1)), key="k", check=["team"], now=at[1])
    h = scd2_merge(h, snap((1, "NE", 9), (2, None, 1), (4, "LA", 1)), key="k", check=["team"], now=at[2])
    got = sorted((r.k, r.team or "", r.nfl, (r.valid_from - T0).days, None if r.valid_to is None else (r.valid_to - T0).days) for r in h.collect())
    assert got == sorted([(1, "NE", 1, 0, None), (2, "", 1, 0, 1), (2, "SF", 1, 1, 2), (2, "", 1, 2, None), (3, "KC", 1, 0, None), (4, "LA", 1, 2, None)])


def test_declared_tests_count_what_fails(spark, rows):
    a = rows("id int, code string, n int, g string, top boolean", (1, "x", 5, "g", True), (1, "y", 11, "g", False), (None, None, None, "h", True), (None, "z", 3, "h", True), (2, "z", 9, None, None))
    declared = {"a": {"keys": [["id"], ["code"], ["g", "top"]], "filled": ["id", "g"], "refers": {"code": "b.code"}, "one_of": {"code": ["x", "y"]}, "within": {"n": [4, 10]},
                      "holds": ["n > 3", "top"], "least": [["top", "n", ["g"]]]}}
    found = dt.results({"a": a, "b": rows("code string", ("x",), ("x",), ("y",), (None,))}, declared)
    assert [c.name for c in found.schema] == [c.split()[0] for c in dt.RESULT_SCHEMA.split(", ")]
    got = {(r.test, r.subject): r.failing_rows for r in found.collect()}
    assert got == {("keys", "id"): 1, ("keys", "code"): 1, ("keys", "g, top"): 1, ("filled", "id"): 2, ("filled", "g"): 1, ("refers", "code to b.code"): 2, ("one_of", "code"): 2,
                   ("within", "n"): 2, ("holds", "n > 3"): 1, ("holds", "top"): 1, ("least", "n where top"): 0}
    assert len(got) == dt.count(declared)
    empty = {r.failing_rows for r in dt.results({"a": a.where("false"), "b": a.where("false")}, declared).collect()}
    assert empty == {0}


def test_versions_of_many_snapshots_like_merging_them_in_turn(spark, rows, tmp_path):
    rnd = random.Random(4)
    schema = "k bigint, team string, w int"
    snaps = [[(k, rnd.choice(["NE", "KC", None]), rnd.randint(1, 3)) for k in range(12) if rnd.random() < 0.7] for _ in range(9)]
    times = [T0 + timedelta(days=i) for i in range(9)]
    history = rows(schema + ", valid_from timestamp, valid_to timestamp")
    for at, snap in zip(times, snaps):
        history = scd2_merge(spark.createDataFrame(history.collect(), history.schema), rows(schema, *snap), key="k", check=["team"], now=F.lit(at))
    want = sorted(map(str, map(tuple, history.collect())))
    every = rows(schema + ", at timestamp", *[(*r, at) for at, snap in zip(times, snaps) for r in snap])
    whole = versions(every, key="k", check=["team"], at="at")
    assert sorted(str(tuple(r)) for r in whole.select(*history.columns).collect()) == want
    assert plan(whole).split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1

    table = SliceTable(spark, str(tmp_path / "versions"), schema + ", valid_from timestamp, valid_to timestamp, slice string", ("slice",))
    files = {}
    for run, after, low, high in (("a", None, 0, 4), ("b", "a", 4, 5), ("b", "a", 4, 5), ("c", "b", 5, 9)):  # the second run is repeated
        part = every.where((F.col("at") >= F.lit(times[low])) & (F.col("at") <= F.lit(times[high - 1])))
        advance(table, part, run, after, key="k", check=["team"], at="at")
        now = {p.name for p in (tmp_path / "versions" / "slice=closed by a").glob("*.parquet")}
        assert files.setdefault("first", now) == now
    assert sorted(str(tuple(r)) for r in version_history(table, "c").select(*history.columns).collect()) == want


def test_a_slice_is_replaced_and_the_others_stay(rows, spark, tmp_path):
    table = SliceTable(spark, str(tmp_path / "t"), "n int, run string, source string", ("run", "source"))
    assert table.read().count() == 0
    frame = rows("n int", (1,), (2,), (3,))
    for run in ("r 1", "r:2"):
        for source in ("a", "b/c"):
            assert table.replace(frame, run=run, source=source) == 3
    names = lambda: {f.name for f in tmp_path.glob("t/run=r 1/*/*.parquet")}
    before = names()
    assert table.replace(frame.where("n > 2"), run="r:2", source="a") == 1 and table.replace(frame.where("false"), run="r:2", source="b/c") == 0
    assert names() == before and sorted(map(tuple, table.read().collect())) == [
        *[(n, "r 1", s) for n in (1, 2, 3) for s in ("a", "b/c")], (3, "r:2", "a")]
    with pytest.raises(ValueError):
        table.replace(frame, run="r")
