"""Scalar rules on hand-written examples."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from squadlake.functions import casts, units
from squadlake.functions.text import body_part, clean_name, split_name

# Invented people: (name, key, key without nickname mapping)
NAMES = [
    ("Zebulon Quill", "zebulon quill", "zebulon quill"), ("Mike Oxenford", "michael oxenford", "mike oxenford"), ("Oxenford, Mike", "michael oxenford", "mike oxenford"),
    ("Quill Sr., Zebulon", "zebulon quill", "zebulon quill"), ("Tarn V", "tarn", "tarn"), ("V Tarn", "v tarn", "v tarn"), ("II Vane III", "ii vane", "ii vane"),
    ("Jr Jr", "jr", "jr"), ("Lark-Moss, Danny, Jr", "danny, lark-moss", "danny, lark-moss"), ("Will Will", "william will", "will will"),
    ("D`Arc O’Wynn", "darc owynn", "darc owynn"), ("e.f.g. hoop", "efg hoop", "efg hoop"), ("Zoe\u0308 Mu\u0308ll", "zoe mull", "zoe mull"),
    ("Zo\u00eb M\u00fcll", "zoe mull", "zoe mull"), ("\ufb02oor ma\u00df", "floor ma", "floor ma"), ("\t Una \x1c Bray  iv", "una bray", "una bray"),
    ("\uff35\uff4e\uff41 Bray", "una bray", "una bray"), ("\u6771\u4eac", "", ""), (None, "", ""), (" \n", "", ""), (",", "", ""), ("Bray,", "bray", "bray"),
]


def column(rows, values, fn, schema="v string"):
    return [r[0] for r in rows(schema, *[(v,) for v in values]).select(fn(F.col("v")).alias("o")).collect()]


def test_name_keys(rows):
    names = [n for n, _, _ in NAMES]
    assert column(rows, names, clean_name) == [k for _, k, _ in NAMES]
    assert column(rows, names, lambda c: clean_name(c, nicknames=False)) == [k for _, _, k in NAMES]


def test_first_token_and_rest(rows):
    df = rows("v string", ("una bray",), ("una de la bray",), ("una",), ("",))
    assert [tuple(r) for r in df.select(*split_name(F.col("v"))).collect()] == [("una", "bray"), ("una", "de la bray"), ("una", ""), ("", "")]


# At the edges of the rule: value, label, result, whether the unit was inferred.
FORCE = [(1499.99, "lbf", 1499.99 * units.N_PER_LBF, False), (1500.0, "N", 1500.0, False), (1500.0, "lbf", 1500.0, True), (1499.99, "N", 1499.99 * units.N_PER_LBF, True),
         (0.0, "", 0.0, True), (1e6, None, 1e6, True)]
SPEED = [(12.0, "m/s", 12.0, False), (12.01, "mph", 12.01 / units.MPH_PER_MS, False), (12.0, "mph", 12.0, True), (12.01, "m/s", 12.01 / units.MPH_PER_MS, True),
         (0.0, None, 0.0, True), (None, "mph", None, False)]
DISTANCE = [(1.0, "yd", units.M_PER_YD, False), (1.0, "m", 1.0, False), (1.0, None, 1.0, True), (1.0, "km", 1.0, False), (None, None, None, False)]


@pytest.mark.parametrize("rule,cases", [(units.normalise_force, FORCE), (units.normalise_speed, SPEED), (units.normalise_distance, DISTANCE)])
def test_units_at_their_edges(rows, rule, cases):
    df = rows("v double, u string", *[c[:2] for c in cases])
    for got, (value, label, want, inferred) in zip(df.select(*rule(F.col("v"), F.col("u"))).collect(), cases):
        assert got[1] is inferred, (value, label)
        assert got[0] == (want if want is None else pytest.approx(want))


def test_answers_keep_their_place_on_the_longer_scale(rows):
    answers = [(v / 2, k) for k in (5, 7, 10) for v in range(2, 2 * k + 1)]
    got = [r[0] for r in rows("v double, s int", *answers).select(units.rescale(F.col("v"), F.col("s"))).collect()]
    assert got == [pytest.approx(v if k == 10 else round(1 + (v - 1) * 9 / (k - 1) + 1e-9, 2)) for v, k in answers]


def test_bands_and_readiness(rows):
    got = [r[0] for r in rows("r double", (0.79,), (0.8,), (1.3,), (1.31,), (1.5,), (1.51,), (None,)).select(units.acwr_band(F.col("r"))).collect()]
    assert got == ["low", "sweet", "sweet", "elevated", "elevated", "high", None]
    df = rows("q double, h double, s double, f double, t double, m double", (8.0, 8.0, 3.0, 4.0, 2.0, 7.0), (8.0, None, 3.0, 4.0, 2.0, 7.0), (None, 8.0, 3.0, 4.0, 2.0, 7.0))
    got = [r[0] for r in df.select(units.readiness(*[F.col(c) for c in "qhsftm"])).collect()]
    assert got == [7.8, 6.75, None]  # missing sleep hours count as 1, a missing answer leaves no score


def test_facility_local(rows):
    cases = [("2026-09-10 07:15:00", datetime(2026, 9, 10, 11, 15), False), ("2026-09-10 07:15:00+00:00", datetime(2026, 9, 10, 11, 15), True),
             ("2026-12-10 07:15:00", datetime(2026, 12, 10, 12, 15), False), ("2026-12-10 07:15:00-08:00", datetime(2026, 12, 10, 15, 15), False)]
    at, fixed = casts.facility_local(F.col("v"))
    got = rows("v string", *[(c[0],) for c in cases]).select(F.date_format(at, "yyyy-MM-dd HH:mm"), fixed).collect()
    assert [tuple(g) for g in got] == [(d.strftime("%Y-%m-%d %H:%M"), f) for _, d, f in cases]


@pytest.mark.parametrize("raw,side,want", [
    ("tight ham", "R", ("hamstring", "R", "field")), ("sham", None, (None, None, None)), ("meniscus (l) (R)", "", ("knee", "L", "text")),
    ("r ACL and hamstring", "x", ("hamstring", "R", "text")), ("Achilles, right or left", None, ("ankle", "R", "text")), ("labrum LEFT", None, ("shoulder", "L", "text")),
    ("Protocol", "", ("concussion", None, None)), ("forehead", "L", (None, "L", "field")), ("", "R", (None, "R", "field")), (None, None, (None, None, None))])
def test_parts_and_sides(rows, raw, side, want):
    got = rows("r string, s string", (raw, side)).select(*body_part(F.col("r"), F.col("s"))).first()
    assert tuple(got) == want


def test_number_text_is_c_general_format(rows):
    values = [113.8, 96.2, 0.0, 1234567.0, 1.234e-05, 100000.0, 12.0, -3.5, 999999.4, 0.12345678, 1e-4, 1.5e6, 10.0]
    assert column(rows, values, casts.general_number, "v double") == ["%g" % v for v in values]


def test_lenient_numbers(rows):
    assert column(rows, ["40011", "40011.0", "x", None, "-3.7", "1e30"], casts.whole) == [40011, 40011, None, None, -3, None]
    assert [str(d) for d in column(rows, ["02/29/2024", "13/40/2024", "2024-01-01", None], casts.us_date)] == ["2024-02-29", "None", "None", "None"]


def test_body_part_seed_is_consistent_with_the_patterns(spark):
    from squadlake.sources.seeds import injury_body_parts
    seed = injury_body_parts(spark)
    part, side, _ = body_part(F.col("raw_text"), F.lit(None).cast("string"))
    assert seed.count() == 54
    assert seed.where(~part.eqNullSafe(F.col("body_part")) | ~side.eqNullSafe(F.col("side"))).count() == 0
