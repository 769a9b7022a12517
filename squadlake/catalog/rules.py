"""Scalar rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from squadlake.catalog.registry import query, rnd, stamp, text
from squadlake.catalog.shapes import EV, PARTS, ev, measure, pick, sql_pick
from squadlake.functions import casts, units
from squadlake.functions.text import body_part
from squadlake.operators.dedup import attach_group

UNIT_SQL = "CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'R' THEN 'lbf' END"


@query("unit_by_magnitude", f"""WITH b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 20 AS v, l_quantity / 2 AS q, {UNIT_SQL} AS fu, CASE l_returnflag WHEN 'A' THEN 'm/s' WHEN 'R' THEN 'mph' END AS su,
  CASE l_returnflag WHEN 'A' THEN 'yd' WHEN 'R' THEN 'm' END AS du FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN v < 1500 THEN v * 4.4482216152605::DOUBLE ELSE v END, 4) AS newtons, fu IS DISTINCT FROM CASE WHEN v < 1500 THEN 'lbf' ELSE 'N' END AS force_inferred,
  round(CASE WHEN q > 12 THEN q / 2.2369362920544::DOUBLE ELSE q END, 6) AS ms, su IS DISTINCT FROM CASE WHEN q > 12 THEN 'mph' ELSE 'm/s' END AS speed_inferred,
  round(CASE WHEN du = 'yd' THEN q * 0.9144::DOUBLE ELSE q END, 6) AS metres, du IS NULL AS distance_inferred FROM b""")
def unit_by_magnitude(t):
    """Force and speed by size, distance by label, each with its inferred flag."""
    flag = F.col("l_returnflag")
    label = lambda a, r: F.when(flag == "A", a).when(flag == "R", r)
    v, q = F.col("l_extendedprice") / 20, F.col("l_quantity") / 2
    n, ni = units.normalise_force(v, label("N", "lbf"))
    s, si = units.normalise_speed(q, label("m/s", "mph"))
    d, di = units.normalise_distance(q, label("yd", "m"))
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(n, 4).alias("newtons"), ni.alias("force_inferred"), rnd(s).alias("ms"),
                             si.alias("speed_inferred"), rnd(d).alias("metres"), di.alias("distance_inferred"))


@query("lean_mass_and_labels", """WITH b AS (SELECT l_orderkey, l_linenumber, sqrt(l_extendedprice) AS w, CASE WHEN l_quantity > 5 THEN l_quantity * 3 + 0.001 * l_linenumber END AS lean, CASE l_returnflag WHEN 'A' THEN 'kg' WHEN 'R' THEN 'lb' END AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(u = 'kg', false) AS mislabeled, coalesce(lean < 100, false) AS was_pct, round(CASE WHEN lean < 100 THEN w * lean / 100 ELSE lean END, 2) AS lean_lbs FROM b""")
def lean_mass_and_labels(t):
    """Weight labels are ignored but flagged; small lean mass is a percentage."""
    w = F.sqrt("l_extendedprice")
    lean = F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 3 + 0.001 * F.col("l_linenumber"))
    unit = F.when(F.col("l_returnflag") == "A", "kg").when(F.col("l_returnflag") == "R", "lb")
    lbs, was_pct = units.lean_mass(lean, w)
    return t.lineitem.select("l_orderkey", "l_linenumber", units.weight_mislabeled(unit).alias("mislabeled"), was_pct.alias("was_pct"), rnd(lbs).alias("lean_lbs"))


@query("cohort_scale", f"""WITH {EV}, a AS (SELECT event_id, d, event_type, 1 + k % CASE WHEN d >= DATE '2024-01-15' THEN 10 ELSE 5 END AS answer FROM ev),
s AS (SELECT *, CASE WHEN max(answer) OVER (PARTITION BY d) > 5 THEN 10 ELSE 5 END AS scale FROM a)
SELECT event_id, scale, round(CASE WHEN scale = 10 THEN answer ELSE 1 + (answer - 1) * 9 / (scale - 1) END, 2) AS answer10 FROM s""")
def cohort_scale(t):
    """A day's answers decide its scale; answers are mapped onto 1..10."""
    top = F.when(F.col("d") >= F.lit("2024-01-15").cast("date"), 10).otherwise(5)
    rows = ev(t).select("event_id", "d", (1 + F.col("k") % top).cast("double").alias("answer"))
    rows = attach_group(rows, ["d"], top=F.max("answer")).withColumn("scale", units.day_scale(F.col("top")))
    return rows.select("event_id", "scale", rnd(units.rescale(F.col("answer"), F.col("scale"))).alias("answer10"))


@query("acwr_bands", """SELECT l_orderkey, l_linenumber, CASE WHEN r < 0.8 THEN 'low' WHEN r <= 1.3 THEN 'sweet' WHEN r <= 1.5 THEN 'elevated' ELSE 'high' END AS band
FROM (SELECT *, l_quantity / 20 AS r FROM lineitem)""")
def acwr_bands(t):
    """Band edges: 0.8, 1.3 and 1.5, the upper edges included below."""
    return t.lineitem.select("l_orderkey", "l_linenumber", units.acwr_band(F.col("l_quantity") / 20).alias("band"))


@query("status_ranks", f"""WITH {EV} SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS practice_rank, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 END AS game_rank,
  CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS method_rank FROM ev""")
def status_ranks(t):
    """Practice, game and method ranks."""
    kind = F.col("event_type")
    practice = F.when(kind == "error", "DNP").when(kind == "view", "LP").otherwise("FP")
    game = F.when(kind == "click", "Out").when(kind == "signup", "Doubtful").when(kind == "purchase", "Questionable")
    method = F.when(kind == "view", "DEXA").when(kind == "click", "BIA").otherwise("scale")
    return ev(t).select("event_id", units.practice_rank(practice).alias("practice_rank"), units.game_rank(game).alias("game_rank"),
                        units.method_rank(method).alias("method_rank"))


@query("local_time_dates", """WITH o AS (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS w, o_orderkey % 3 AS kind FROM orders),
back AS (SELECT *, timezone('America/New_York', timezone('UTC', w + INTERVAL 4 HOUR)) = w AS summer FROM o),
-- An hour that comes twice takes the earlier (summer) instant; one that is skipped counts from the offset before it and so moves forward.
z AS (SELECT *, CASE WHEN kind = 2 THEN w + INTERVAL 2 HOUR WHEN summer THEN w + INTERVAL 4 HOUR ELSE w + INTERVAL 5 HOUR END AS u FROM back)
SELECT o_orderkey, strftime(u, '%Y-%m-%d %H:%M:%S') AS utc, kind = 1 AS corrected,
  CAST(CAST(timezone('America/New_York', timezone('UTC', u)) AS DATE) AS VARCHAR) AS local_day FROM z""")
def local_time_dates(t):
    """Facility-local text: bogus UTC suffix corrected, other offsets trusted, local date back.
    A wall time that comes twice is its first instant, one that is skipped moves forward."""
    wall = F.date_format(F.expr("o_orderdate + make_dt_interval(0, 0, o_orderkey % 1440, 0)"), "yyyy-MM-dd HH:mm:ss")
    kind = F.col("o_orderkey") % 3
    rows = t.orders.select("o_orderkey", F.concat(wall, F.when(kind == 1, "+00:00").when(kind == 2, "-02:00").otherwise("")).alias("s"))
    instant, corrected = casts.facility_local(F.col("s"))
    rows = rows.withColumns({"u": instant, "corrected": corrected})
    return rows.select("o_orderkey", stamp("u").alias("utc"), "corrected", text(casts.local_date(F.col("u"))).alias("local_day"))


@query("lenient_parsing", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_custkey END AS whole, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS us_date,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_epoch, strftime(o_orderdate + INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS from_offset FROM orders""")
def lenient_parsing(t):
    """Bad text becomes NULL; whole numbers pass through floats; US, ISO and epoch stamps."""
    d, s = F.col("o_orderdate"), F.col("o_orderstatus")
    number = F.when(s == "F", F.lit("n/a")).otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    us = F.when(s == "P", F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    iso = F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-04:00"))
    return t.orders.select("o_orderkey", casts.whole(number).alias("whole"), text(casts.us_date(us)).alias("us_date"),
                           text(casts.iso_date(iso)).alias("iso_date"), stamp(casts.epoch_utc(F.unix_seconds(d).cast("string"))).alias("from_epoch"),
                           stamp(casts.iso_utc(iso)).alias("from_offset"))


@query("body_part_regex_class", f"""SELECT event_id, list_extract(['hamstring', 'hamstring', 'knee', 'ankle', 'shoulder', 'concussion', NULL, 'knee'], CAST(k % 8 AS INTEGER) + 1) AS part,
  CASE WHEN k % 5 = 0 THEN 'R' ELSE list_extract([NULL, NULL, 'L', 'R', 'L', NULL, NULL, 'R'], CAST(k % 8 AS INTEGER) + 1) END AS side,
  CASE WHEN k % 5 = 0 THEN 'field' WHEN k % 8 IN (2, 3, 4, 7) THEN 'text' END AS side_source
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def body_part_regex_class(t):
    """Free text to canonical body part and side by ordered patterns."""
    k = F.col("k")
    part, side, source = body_part(pick(PARTS, k % 8), F.when(k % 5 == 0, "R"))
    return ev(t).select("event_id", part.alias("part"), side.alias("side"), source.alias("side_source"))


@query("part_name_patterns", """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\b(hot|red)\\b') THEN 'warm' WHEN regexp_matches(p_name, '\\b(blue|cold)\\b') THEN 'cool' END AS class,
  nullif(regexp_extract(p_brand, '#(\\d)', 1), '') AS digit FROM part""")
def part_name_patterns(t):
    """Ordered regex classes and group extraction on catalogue text."""
    n = F.col("p_name")
    return t.part.select("p_partkey", F.when(n.rlike(r"\b(hot|red)\b"), "warm").when(n.rlike(r"\b(blue|cold)\b"), "cool").alias("class"),
                         F.nullif(F.regexp_extract("p_brand", r"#(\d)", 1), F.lit("")).alias("digit"))


@query("json_unpack", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events""")
def json_unpack(t):
    """Typed fields out of a JSON column; key presence is not the same as a null value."""
    keys = F.json_object_keys("props")
    return t.events.select("event_id", F.from_json("props", "k string")["k"].cast("int").alias("k"), F.array_contains(keys, "k").alias("has_k"),
                           F.array_contains(keys, "z").alias("has_z"))


@query("surrogate_keys", """SELECT o_orderkey, md5(o_custkey || '-' || CAST(o_orderdate AS DATE) || '-' || CASE WHEN o_orderstatus = 'P' THEN '_dbt_utils_surrogate_key_null_' ELSE o_orderstatus END) AS sk FROM orders""")
def surrogate_keys(t):
    """Digest of the natural key with a placeholder for NULL."""
    s = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", casts.surrogate_key(F.col("o_custkey"), F.to_date("o_orderdate"), s).alias("sk"))


@query("qc_flags_and_pct", """WITH f AS (SELECT l_returnflag, concat_ws(',', CASE WHEN l_discount > 0.05 THEN 'deep' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS fl FROM lineitem)
SELECT l_returnflag, fl AS flags, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 2) AS share FROM f GROUP BY ALL""")
def qc_flags_and_pct(t):
    """Conditional label arrays and rounded percentages."""
    fl = F.array_join(units.flags((F.col("l_discount") > 0.05, "deep"), (F.col("l_tax") == 0, "untaxed")), ",")
    total = t.lineitem.agg(F.count("*").alias("v")).scalar()
    counted = t.lineitem.groupBy("l_returnflag", fl.alias("flags")).agg(F.count("*").alias("n"))
    return counted.select("*", casts.pct(F.col("n"), total).alias("share"))


@query("number_text", """SELECT o_orderkey, format('{:g}', o_totalprice + 0.0031) AS price, format('{:g}', o_orderkey / 7.0) AS seventh FROM orders""")
def number_text(t):
    """Six significant digits without trailing zeros, exponent outside 1e-4..1e6."""
    return t.orders.select("o_orderkey", casts.general_number(F.col("o_totalprice") + 0.0031).alias("price"),
                           casts.general_number(F.col("o_orderkey") / F.lit(7.0)).alias("seventh"))
