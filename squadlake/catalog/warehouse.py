"""Dimensions, slowly changing tables, seeds, assertions and report queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.catalog import series
from squadlake.catalog import shapes as s
from squadlake.catalog.registry import query, rnd, shared, stamp, text
from squadlake.operators import assertions as x
from squadlake.operators import declared_tests
from squadlake.operators.numbering import number_new_keys
from squadlake.operators.scd import advance, scd2_merge, upsert_retire, upsert_stats, version_history
from squadlake.plans import dims, dq_views, report
from squadlake.session import materialise, work_folder
from squadlake.sources import roster, seeds
from squadlake.sources.slices import SliceTable

# ---------------------------------------------------------------- dimensions


@query("date_spine", f"""WITH b AS (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM orders)
SELECT CAST(CAST(g AS DATE) AS VARCHAR) AS date_day, CAST(isodow(g) AS INTEGER) AS iso_dow, strftime(g, '%a') AS day_name, CAST(date_diff('day', b.lo, CAST(g AS DATE)) // 7 + 1 AS INTEGER) AS season_week,
  {s.sql_pick(dims.DAY_TYPES, 'isodow(g) - 1')} AS day_type, isodow(g) BETWEEN 3 AND 7 AS is_scheduled, isodow(g) IN (3, 4, 5, 7) AS counts_for_availability, CAST(year(g) AS INTEGER) AS year, CAST(month(g) AS INTEGER) AS month,
  (SELECT count(*) FROM orders o WHERE CAST(o.o_orderdate AS DATE) = CAST(g AS DATE)) AS orders FROM b, generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 DAY) AS t(g)""")
def date_spine(t):
    """Calendar attributes for every day the orders span, with the day's orders."""
    from squadlake.operators.timeseries import explode_days
    span = t.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    days = explode_days(span, "lo", "hi")
    n = t.orders.groupBy(F.to_date("o_orderdate").alias("_d")).agg(F.count("*").alias("n"))
    cols = dims.calendar_columns(F.col("date_day"), F.col("lo"))
    return (days.join(n, F.col("date_day") == F.col("_d"), "left")
            .select(text("date_day").alias("date_day"), *[c.alias(k) for k, c in cols.items()], F.coalesce("n", F.lit(0)).alias("orders")))


def team_members(t):
    """Customers as a roster: a team per nation, some retired."""
    code = s.pick(tuple(s.TEAMS) + ("KC2",), F.col("c_nationkey") % 5)
    return t.customer.select("c_custkey", code.alias("team"), F.when(F.col("c_acctbal") < 0, F.lit("2024-01-01").cast("timestamp")).alias("valid_to"))


@query("dim_with_counts", f"""WITH m AS (SELECT {s.sql_pick(tuple(s.TEAMS) + ('KC2',), 'c_nationkey % 5')} AS team, c_acctbal FROM customer)
SELECT team AS team_sk, CASE team WHEN 'NE' THEN 'Gillette Stadium' WHEN 'KC' THEN 'GEHA Field at Arrowhead Stadium' WHEN 'BUF' THEN 'Highmark Stadium' WHEN 'SF' THEN 'Levi''s Stadium' END AS stadium, false AS is_dome, count(*) FILTER (c_acctbal >= 0) AS active_players FROM m GROUP BY ALL""")
def dim_with_counts(t):
    """Distinct teams with the stadium seed and the number of active members."""
    return dims.dim_team(team_members(t), seeds.stadiums(t.spark)).select("team_sk", "stadium", "is_dome", "active_players")


@query("injury_type_lookup", f"""WITH {s.EV}, {s._seed_sql()} SELECT lower({s.sql_pick(s.PARTS, 'k % 8')}) AS raw_text, part AS body_part, region AS body_region, sside AS side, count(*) AS n, md5(raw_text) AS injury_type_sk
FROM ev LEFT JOIN seed ON seed.raw_text = lower({s.sql_pick(s.PARTS, 'k % 8')}) GROUP BY ALL""")
def injury_type_lookup(t):
    """The body-part seed as a dimension, looked up from free text."""
    dim = dims.dim_injury_type(seeds.injury_body_parts(t.spark)).withColumnRenamed("raw_text", "_raw")
    raw = s.ev(t).groupBy(F.lower(s.pick(s.PARTS, F.col("k") % 8)).alias("raw_text")).agg(F.count("*").alias("n"))
    return raw.join(dim, F.col("raw_text") == F.col("_raw"), "left").select("raw_text", "body_part", "body_region", "side", "n", "injury_type_sk")


def early_master(t):
    """Customers up to a balance as the previous state; numbers in key order."""
    stamp_ = F.lit("2024-01-01").cast("timestamp")
    return t.customer.where("c_acctbal < 6000").select(
        (F.col("c_custkey") + 1).alias("sk"), F.col("c_name").alias("k"), F.col("c_mktsegment").alias("seg"), F.lit(1).alias("nfl_id"),
        stamp_.alias("valid_from"), F.when(F.col("c_acctbal") < -500, stamp_).cast("timestamp").alias("valid_to"), stamp_.alias("updated_at"))


def late_snapshot(t):
    """Customers from a balance up as the new snapshot; some changed segment."""
    seg = F.when(F.col("c_acctbal") > 5000, "MOVED").otherwise(F.col("c_mktsegment"))
    return t.customer.where("c_acctbal > 1000 OR c_acctbal < -800").select(F.col("c_name").alias("k"), seg.alias("seg"), F.lit(1).alias("nfl_id"))


@query("upsert_retire", """WITH p AS (SELECT c_custkey + 1 AS sk, c_name AS k, c_mktsegment AS seg, c_acctbal AS b FROM customer WHERE c_acctbal < 6000),
n AS (SELECT c_name AS k, CASE WHEN c_acctbal > 5000 THEN 'MOVED' ELSE c_mktsegment END AS seg FROM customer WHERE c_acctbal > 1000 OR c_acctbal < -800),
j AS (SELECT p.sk, coalesce(p.k, n.k) AS k, p.k IS NOT NULL AS had, n.k IS NOT NULL AS has, p.seg AS ps, n.seg AS ns, coalesce(p.b < -500, false) AS was_retired FROM p FULL JOIN n ON n.k = p.k),
new_sk AS (SELECT k, (SELECT max(sk) FROM p) + row_number() OVER (ORDER BY substr(md5(k), 1, 3), k) AS sk FROM j WHERE NOT had)
SELECT coalesce(j.sk, new_sk.sk) AS sk, j.k, CASE WHEN has THEN ns ELSE ps END AS seg, CASE WHEN had THEN '2024-01-01' ELSE '2024-02-01' END AS valid_from,
  CASE WHEN has THEN NULL WHEN was_retired THEN '2024-01-01' ELSE '2024-02-01' END AS valid_to,
  CASE WHEN NOT had OR (has AND (ps <> ns OR was_retired)) OR (NOT has AND NOT was_retired) THEN '2024-02-01' ELSE '2024-01-01' END AS updated_at FROM j LEFT JOIN new_sk USING (k)""")
def upsert_retire_query(t):
    """Insert, change, keep, retire and revive against a full snapshot; keys keep their number."""
    out = upsert_retire(early_master(t), late_snapshot(t), key="k", sk="sk", compare=["seg"], now=F.lit("2024-02-01").cast("timestamp"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("sk", "k", "seg", day("valid_from"), day("valid_to"), day("updated_at"))


@query("upsert_counts", """SELECT count(*) AS total, count(*) FILTER (c_acctbal > 1000 OR c_acctbal < -800) AS active, count(*) FILTER (c_acctbal <= 1000 AND c_acctbal >= -500) AS retired_this_run, CAST(0 AS BIGINT) AS active_without_nfl_id FROM customer""")
def upsert_counts(t):
    """Totals after the upsert."""
    now = F.lit("2024-02-01").cast("timestamp")
    return upsert_stats(upsert_retire(early_master(t), late_snapshot(t), key="k", sk="sk", compare=["seg"], now=now), now)


@query("new_surrogate_numbers", """SELECT o_custkey, 100 + row_number() OVER (ORDER BY substr(md5(CAST(o_custkey AS VARCHAR)), 1, 3), o_custkey) AS sk FROM (SELECT DISTINCT o_custkey FROM orders)""")
def new_surrogate_numbers(t):
    """Dense, repeatable numbers for new keys without a global sort."""
    return number_new_keys(t.orders.select("o_custkey").distinct(), "o_custkey", F.lit(100), "sk")


def order_state(t, until: str):
    """Each customer's latest order attributes as of a day."""
    from squadlake.operators.dedup import latest_per_key
    rows = t.orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    return latest_per_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(
        F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))


@shared
def history(t):
    """Two snapshots folded into versions."""
    empty = t.spark.createDataFrame([], "k bigint, priority string, status string, valid_from timestamp, valid_to timestamp")
    one = scd2_merge(empty, order_state(t, "1998-01-01"), key="k", check=["priority"], now=F.lit("1998-01-01").cast("timestamp"))
    return scd2_merge(one, order_state(t, "2000-01-01"), key="k", check=["priority"], now=F.lit("2000-01-01").cast("timestamp"))


SCD_SQL = """a AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
b AS (SELECT o_custkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
v AS (SELECT a.k, a.p, a.s, '1998-01-01' AS f, CASE WHEN b.p <> a.p THEN '2000-01-01' END AS e FROM a JOIN b USING (k) UNION ALL SELECT b.k, b.p, b.s, '2000-01-01', NULL FROM b LEFT JOIN a USING (k) WHERE a.k IS NULL OR a.p <> b.p)"""


@query("scd2_two_snapshots", f"""WITH {SCD_SQL} SELECT k, p AS priority, s AS status, f AS valid_from, e AS valid_to, e IS NULL AS is_current, count(*) OVER (PARTITION BY k) AS versions FROM v""")
def scd2_two_snapshots(t):
    """Version history over two snapshots: only the tracked column opens a version."""
    from squadlake.operators.dedup import attach_group
    rows = attach_group(history(t), ["k"], versions=F.count("*"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("k", "priority", "status", day("valid_from"), day("valid_to"), F.col("valid_to").isNull().alias("is_current"), "versions")


MONTHS_SQL = """m AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS mon, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s
  FROM orders GROUP BY ALL),
c AS (SELECT *, lag(p) OVER (PARTITION BY k ORDER BY mon) AS b, row_number() OVER (PARTITION BY k ORDER BY mon) AS n FROM m),
v AS (SELECT * FROM c WHERE n = 1 OR p IS DISTINCT FROM b)"""


@query("scd2_many_snapshots", f"""WITH {MONTHS_SQL} SELECT k, p AS priority, s AS status, strftime(mon, '%Y-%m-%d') AS valid_from,
  strftime(lead(mon) OVER (PARTITION BY k ORDER BY mon), '%Y-%m-%d') AS valid_to FROM v""")
def scd2_many_snapshots(t):
    """Every order month as a snapshot, in three runs: each reads the open versions only and
    folds all its months in one pass."""
    month = F.date_trunc("month", "o_orderdate")
    latest = lambda c: F.max_by(c, F.struct("o_orderdate", "o_orderkey")).alias(c)
    months = materialise(t.orders.groupBy(F.col("o_custkey").alias("k"), month.alias("at")).agg(latest("o_orderpriority"), latest("o_orderstatus")))
    months = months.select("k", "at", F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    table = SliceTable(t.spark, work_folder(t.spark), "k bigint, priority string, status string, valid_from timestamp, valid_to timestamp, slice string", ("slice",))
    for run, after, low, high in (("first", None, "1900", "1994"), ("second", "first", "1994", "1996"), ("third", "second", "1996", "9999")):
        part = months.where((F.col("at") >= F.lit(f"{low}-01-01").cast("timestamp")) & (F.col("at") < F.lit(f"{high}-01-01").cast("timestamp")))
        advance(table, part, run, after, key="k", check=["priority"], at="at")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return version_history(table, "third").select("k", "priority", "status", day("valid_from"), day("valid_to"))


@query("dim_player_versions", """WITH u AS (SELECT c_custkey AS sk, c_name, c_nationkey, c_acctbal FROM customer)
SELECT sk AS player_sk, c_name AS full_name, 'T' || CASE WHEN i = 1 AND c_acctbal > 5000 THEN 'X' ELSE CAST(c_nationkey AS VARCHAR) END AS team, c_acctbal >= 0 AS on_roster, i = 1 OR c_acctbal <= 5000 AS is_current, CAST(CASE WHEN c_acctbal > 5000 THEN 2 ELSE 1 END AS BIGINT) AS versions
FROM u, (VALUES (0), (1)) g(i) WHERE i = 0 OR c_acctbal > 5000""")
def dim_player_versions(t):
    """The player dimension after two runs: a team change is a version, retirement is a tracked column."""
    none = F.lit(None)
    base = t.customer.select(
        F.col("c_custkey").alias("player_sk"), F.col("c_name").alias("gsis_id"), none.cast("bigint").alias("nfl_id"), none.cast("bigint").alias("espn_id"),
        none.cast("string").alias("pfr_id"), F.col("c_name").alias("full_name"), F.lower("c_name").alias("clean_name"), none.cast("string").alias("first_name"),
        none.cast("string").alias("last_name"), none.cast("string").alias("football_name"), F.concat(F.lit("T"), "c_nationkey").alias("team"),
        F.lit("QB").alias("position"), F.lit(200.0).alias("weight_lbs"), F.lit(75.0).alias("height_in"),
        F.when(F.col("c_acctbal") < 0, F.lit("2023-01-01").cast("timestamp")).alias("valid_to"), F.col("c_acctbal").alias("_b"))
    moved = base.withColumn("team", F.when(F.col("_b") > 5000, "TX").otherwise(F.col("team"))).drop("_b")
    at = lambda d: F.lit(d).cast("timestamp")
    empty = t.spark.createDataFrame([], dims.SNAPSHOT_SCHEMA)
    first = dims.snapshot_players(empty, base.drop("_b"), at("2024-01-01"))
    dim = dims.dim_player(dims.snapshot_players(first, moved, at("2024-02-01")))
    return dim.select("player_sk", "full_name", "team", "on_roster", "is_current", "versions")


@query("current_players", """SELECT c_custkey AS player_sk, c_name AS full_name, true AS on_roster FROM customer""")
def current_players(t):
    """The current version of every player, one row each."""
    none = F.lit(None)
    frame = t.customer.select(F.col("c_custkey").alias("player_sk"), *[none.cast("string").alias(c) for c in ("gsis_id", "pfr_id", "first_name", "last_name", "football_name", "team", "position")],
                              none.cast("bigint").alias("nfl_id"), none.cast("bigint").alias("espn_id"), F.col("c_name").alias("full_name"), F.lit(1.0).alias("weight_lbs"),
                              F.lit(1.0).alias("height_in"), F.lit(True).alias("on_roster"), F.current_timestamp().alias("valid_from"))
    versions = frame.withColumn("is_current", F.explode(F.array(F.lit(True), F.lit(False))))
    return dims.dim_player_current(versions).select("player_sk", "full_name", "on_roster")


# ---------------------------------------------------------------- roster preparation

@query("prepare_roster", """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'id-' || (c_custkey // 2) END AS gsis, c_name, c_acctbal, c_nationkey, c_mktsegment, ['QB', 'WR', 'K'][c_nationkey % 3 + 1] AS pos FROM customer),
f AS (SELECT * FROM r WHERE c_mktsegment <> 'MACHINERY' AND pos <> 'K' AND gsis IS NOT NULL QUALIFY row_number() OVER (PARTITION BY gsis ORDER BY c_custkey) = 1),
w AS (SELECT 'id-' || (s_suppkey // 2) AS g, s_suppkey, s_nationkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_suppkey // 2 ORDER BY s_suppkey DESC) = 1)
SELECT gsis AS gsis_id, coalesce(w.s_suppkey, 90000000 + (c_custkey // 2 * 31 + 1) % 9000000) AS nfl_id, coalesce(w.s_nationkey, 90000000 + (c_custkey // 2 * 31 + 2) % 9000000) AS espn_id, pos AS position,
  CAST(CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 2) WHEN pos = 'QB' THEN 220.0 ELSE 200.0 END AS DOUBLE) AS weight_lbs, CAST(CASE pos WHEN 'QB' THEN 75.0 ELSE 73.0 END AS DOUBLE) AS height_in FROM f LEFT JOIN w ON w.g = f.gsis""")
def prepare_roster(t):
    """Active tracked players, first row per id, crosswalk last row, defaults and stand-in ids."""
    k = F.col("c_custkey")
    rows = t.customer.select(
        k.alias("seq"), F.when(k % 4 != 0, F.concat(F.lit("id-"), F.floor(k / 2))).alias("player_id"), F.col("c_name").alias("player_name"),
        F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("NE").alias("team"), s.pick(("QB", "WR", "K"), F.col("c_nationkey") % 3).alias("position"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "RET").otherwise("ACT").alias("status"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise("n/a").alias("weight"), F.lit(None).cast("string").alias("height"),
        F.lit(None).cast("string").alias("espn_id"))
    ids = t.supplier.select(F.col("s_suppkey").alias("seq"), F.concat(F.lit("id-"), F.floor(F.col("s_suppkey") / 2)).alias("gsis_id"),
                            F.col("s_suppkey").alias("nfl_id"), F.col("s_nationkey").cast("string").alias("espn_id"))
    out = roster.prepare_roster(rows, ids, ["seq"])
    return out.select("gsis_id", "nfl_id", "espn_id", "position", rnd("weight_lbs").alias("weight_lbs"), rnd("height_in").alias("height_in"))


# ---------------------------------------------------------------- joins and sets

@query("full_outer_two_keys", """WITH c AS (SELECT c_nationkey, CAST(floor(c_acctbal / 1000) AS INTEGER) AS b, count(*) AS customers FROM customer GROUP BY ALL), u AS (SELECT s_nationkey, CAST(floor(s_acctbal / 1000) AS INTEGER) AS b, count(*) AS suppliers FROM supplier GROUP BY ALL)
SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, coalesce(c.b, u.b) AS band, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN u ON c_nationkey = s_nationkey AND c.b = u.b""")
def full_outer_two_keys(t):
    """Full outer join on two keys, both sides aggregated first."""
    band = lambda c: F.floor(F.col(c) / 1000).cast("int")
    c = t.customer.groupBy("c_nationkey", band("c_acctbal").alias("cb")).agg(F.count("*").alias("customers"))
    u = t.supplier.groupBy("s_nationkey", band("s_acctbal").alias("sb")).agg(F.count("*").alias("suppliers"))
    j = c.join(u, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("cb") == F.col("sb")), "full")
    zero = F.lit(0)
    return j.select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), F.coalesce("cb", "sb").alias("band"),
                    F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"))


@query("union_sources", """SELECT 'orders' AS source, CAST(o_orderdate AS DATE)::VARCHAR AS day, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'events', CAST(ts AS DATE)::VARCHAR, count(*) FROM events GROUP BY ALL""")
def union_sources(t):
    """UNION ALL of two sources under a literal label."""
    frames = {"orders": t.orders.select(F.to_date("o_orderdate").alias("day")), "events": t.events.select(F.to_date("ts").alias("day"))}
    return dq_views.quarantine_all(frames).groupBy("source", text("day").alias("day")).agg(F.count("*").alias("n"))


@query("tracked_entities", """SELECT nationkey FROM (SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier)""")
def tracked_entities(t):
    """UNION (distinct) of two sources' keys."""
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query("recency_rank", """SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderdate DESC) AS recency FROM orders""")
def recency_rank(t):
    """dense_rank over the whole table: only the distinct days are ranked in one place."""
    return dq_views.with_recency(t.orders, "o_orderdate", "recency").select("o_orderkey", F.col("recency").cast("bigint").alias("recency"))


# ---------------------------------------------------------------- assertions

@query("assertions", """SELECT 'unique o_orderkey' AS assertion, (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS failing_rows
UNION ALL SELECT 'not_null o_custkey', (SELECT count(*) FROM orders WHERE o_custkey IS NULL)
UNION ALL SELECT 'accepted_values l_returnflag', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'R'))
UNION ALL SELECT 'relationships o_custkey', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0))
UNION ALL SELECT 'is_between l_discount', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 0.08)
UNION ALL SELECT 'expression_is_true price', (SELECT count(*) FROM lineitem WHERE NOT (l_extendedprice >= l_quantity * 900))
UNION ALL SELECT 'unique_combination line', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))""")
def assertion_counts(t):
    """Every table test with the number of rows that fail it."""
    return x.failures({
        "unique o_orderkey": x.unique(t.orders, "o_orderkey"), "not_null o_custkey": x.not_null(t.orders, "o_custkey"),
        "accepted_values l_returnflag": x.accepted_values(t.lineitem, "l_returnflag", ["A", "R"]),
        "relationships o_custkey": x.relationships(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey"),
        "is_between l_discount": x.is_between(t.lineitem, "l_discount", 0, 0.08),
        "expression_is_true price": x.expression_is_true(t.lineitem, "l_extendedprice >= l_quantity * 900"),
        "unique_combination line": x.unique_combination(t.lineitem, ["l_orderkey", "l_linenumber"])})


@query("gold_assertions", f"""WITH {s.TO_DAY} SELECT 'green iff no reason' AS assertion, count(*) FILTER ((flag = 'green') <> (flag_reasons IS NULL)) AS failing_rows FROM pd
UNION ALL SELECT 'out is red', count(*) FILTER (availability = 'Out' AND flag <> 'red') FROM pd UNION ALL SELECT 'limited is not green', count(*) FILTER (availability = 'Limited' AND flag = 'green') FROM pd
UNION ALL SELECT 'one row per player day', (SELECT count(*) FROM (SELECT player_sk, date_day FROM pd GROUP BY ALL HAVING count(*) > 1))""")
def gold_assertions(t):
    """The flag's consistency rules over the player-day fact."""
    pd = series.player_day_table(t)
    return x.failures({
        "green iff no reason": x.expression_is_true(pd, "(flag = 'green') = (flag_reasons is null)"),
        "out is red": x.expression_is_true(pd, "not (availability = 'Out' and flag <> 'red')"),
        "limited is not green": x.expression_is_true(pd, "not (availability = 'Limited' and flag = 'green')"),
        "one row per player day": x.unique_combination(pd, ["player_sk", "date_day"])})


DECLARED = {
    "orders": {"keys": [["o_orderkey"], ["o_custkey", "o_orderdate"]], "filled": ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"],
               "refers": {"o_custkey": "solvent.c_custkey"}, "one_of": {"o_orderstatus": ["O", "F"]}, "within": {"o_totalprice": [1000, 300000]},
               "holds": ["o_orderdate >= '1993-01-01'", "o_orderstatus <> 'F' OR o_totalprice > 5000"],
               "least": [["o_orderstatus = 'O'", "o_orderpriority", ["o_custkey"]]]},
    "lineitem": {"keys": [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"]], "filled": ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity"],
                 "refers": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "solid.s_suppkey"},
                 "one_of": {"l_returnflag": ["A", "R"], "l_linestatus": ["O", "F"]}, "within": {"l_discount": [0, 0.08], "l_quantity": [2, 50]},
                 "holds": ["l_extendedprice >= l_quantity * 900"]},
    "customer": {"keys": [["c_custkey"], ["c_nationkey", "c_mktsegment"]], "filled": ["c_name"], "refers": {"c_nationkey": "nation.n_nationkey"},
                 "one_of": {"c_mktsegment": ["BUILDING", "MACHINERY"]}, "within": {"c_acctbal": [0, 9000]}},
    "events": {"keys": [["event_id"], ["user_id", "ts"]], "filled": ["ts", "value"], "one_of": {"event_type": ["click", "view", "purchase"]},
               "within": {"value": [0.5, 90]}, "holds": ["event_type <> 'error' OR value > 1"]},
}
TARGETS = {"solvent": "(SELECT * FROM customer WHERE c_acctbal > 0)", "solid": "(SELECT * FROM supplier WHERE s_acctbal > 0)"}


def _declared_sql() -> str:
    """Each declared test as a query of its own, by the book."""
    def quoted(values) -> str:
        return ", ".join(f"'{v}'" for v in values)

    rows = []
    for name, declared in DECLARED.items():
        for columns in declared.get("keys", []):
            whole = f"WHERE {columns[0]} IS NOT NULL" if len(columns) == 1 else ""
            rows.append((name, "keys", ", ".join(columns), f"SELECT count(*) FROM (SELECT 1 FROM {name} {whole} GROUP BY {', '.join(columns)} HAVING count(*) > 1)"))
        rows += [(name, "filled", c, f"SELECT count(*) FROM {name} WHERE {c} IS NULL") for c in declared.get("filled", [])]
        rows += [(name, "refers", f"{c} to {to}", f"SELECT count(*) FROM {name} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {to.split('.')[1]} FROM {TARGETS.get(to.split('.')[0], to.split('.')[0])} x)")
                 for c, to in declared.get("refers", {}).items()]
        rows += [(name, "one_of", c, f"SELECT count(*) FROM {name} WHERE {c} NOT IN ({quoted(v)})") for c, v in declared.get("one_of", {}).items()]
        rows += [(name, "within", c, f"SELECT count(*) FROM {name} WHERE {c} < {low} OR {c} > {high}") for c, (low, high) in declared.get("within", {}).items()]
        rows += [(name, "holds", e, f"SELECT count(*) FROM {name} WHERE NOT ({e})") for e in declared.get("holds", [])]
        rows += [(name, "least", f"{v} where {e}", f"SELECT count(*) FROM {name} a WHERE {e} AND {v} > (SELECT min({v}) FROM {name} b WHERE {' AND '.join(f'a.{c} = b.{c}' for c in by)})")
                 for e, v, by in declared.get("least", [])]
    text_of = lambda v: v.replace("'", "''")
    return "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, '{test}' AS test, '{text_of(subject)}' AS subject, ({sql}) AS failing_rows" for n, test, subject, sql in rows)


@query("declared_tests", _declared_sql())
def declared_test_counts(t):
    """Declared tests of four tables, compiled to one aggregate a table, a grouping a key and a join a reference."""
    tables = {name: getattr(t, name) for name in (*DECLARED, "part", "nation")}
    return declared_tests.results({**tables, "solvent": t.customer.where("c_acctbal > 0"), "solid": t.supplier.where("s_acctbal > 0")}, DECLARED)


# ---------------------------------------------------------------- reports

def with_sql(select: str) -> str:
    return f"WITH {s.TO_DAY}, {s.WHO}, upto AS (SELECT max(date_day) - 2 AS d FROM pd) {select}"


BACK = 2


@query("asof_cards", with_sql("""SELECT CAST(a.d AS VARCHAR) AS as_of, strftime(a.d, '%a %-d %b %Y') AS as_of_label, count(DISTINCT player_sk) AS players, count(*) FILTER (flag = 'red') AS red, count(*) FILTER (flag = 'amber') AS amber,
  count(*) FILTER (flag = 'green') AS green, count(*) FILTER (availability = 'Out') AS "out", count(*) FILTER (availability = 'Limited') AS limited, count(*) FILTER (is_silent) AS silent, round(sum(a7), 6) AS load_7d, round(sum(c28), 6) AS load_norm,
  round((sum(a7) - sum(c28)) / sum(c28), 6) AS load_vs_norm, round(avg(acwr), 6) AS acwr, (SELECT count(DISTINCT injury_id) FROM fis WHERE date_day = (SELECT d FROM upto)) AS open_injuries FROM pd, upto a WHERE date_day = a.d GROUP BY a.d"""))
def asof_cards(t):
    """All cards of a page for the as-of day."""
    out = report.cards(series.player_day_table(t), series.status_table(t), days_back=BACK)
    return out.select(text("as_of").alias("as_of"), "as_of_label", "players", "red", "amber", "green", "out", "limited", "silent", "open_injuries",
                      *[rnd(c).alias(c) for c in ("load_7d", "load_norm", "load_vs_norm", "acwr")])


@query("asof_cards_team", with_sql("""SELECT count(DISTINCT player_sk) AS players, count(*) FILTER (flag = 'red') AS red, round(sum(a7), 6) AS load_7d, (SELECT count(DISTINCT injury_id) FROM fis JOIN who USING (player_sk) WHERE team = 'KC' AND date_day = (SELECT d FROM upto)) AS open_injuries
FROM pd JOIN who USING (player_sk), upto a WHERE date_day = a.d AND who.team = 'KC'"""))
def asof_cards_team(t):
    """Cards under a team filter: the as-of day still comes from all players."""
    out = report.cards(series.player_day_table(t), series.status_table(t), s.players(t), days_back=BACK, team="KC")
    return out.select("players", "red", rnd("load_7d").alias("load_7d"), "open_injuries")


@query("roster_board", with_sql("""SELECT flag, full_name, position, availability, game_status, round(readiness, 6) AS readiness_score, round(delta_cents / 100.0, 6) AS readiness_delta, round(acwr, 6) AS acwr_coupled, round(a7, 6) AS load_7d,
  date_diff('day', last_survey, date_day) AS days_since_survey, parts AS open_injury_body_parts, CAST(back AS VARCHAR) AS expected_return, flag_reasons, flag_rank FROM pd JOIN who USING (player_sk), upto a WHERE date_day = a.d AND team = 'NE'"""))
def roster_board(t):
    """The landing table: one team's players on the as-of day."""
    out = report.roster_board(series.player_day_table(t), s.players(t), days_back=BACK)
    return out.select("flag", "full_name", "position", "availability", "game_status", "days_since_survey", "open_injury_body_parts", text("expected_return").alias("expected_return"),
                      "flag_reasons", "flag_rank", *[rnd(c).alias(c) for c in ("readiness_score", "readiness_delta", "acwr_coupled", "load_7d")])


@query("top_n_vs_norm", with_sql("""SELECT player_sk, full_name, round(a7, 6) AS load_7d, round(c28, 6) AS load_norm, round((a7 - c28) / nullif(c28, 0), 6) AS load_vs_norm FROM pd JOIN who USING (player_sk), upto a WHERE date_day = a.d
ORDER BY (a7 - c28) / nullif(c28, 0) DESC NULLS LAST, player_sk LIMIT 20"""))
def top_n_vs_norm(t):
    """The twenty players furthest above their own norm."""
    out = report.load_vs_norm(series.player_day_table(t), s.players(t), days_back=BACK, top=20)
    return out.select("player_sk", "full_name", *[rnd(c).alias(c) for c in ("load_7d", "load_norm", "load_vs_norm")])


@query("band_by_day", with_sql("""SELECT CAST(date_day AS VARCHAR) AS date_day, band AS acwr_band, count(*) AS players FROM pd, upto a WHERE date_day > a.d - 400 AND date_day <= a.d GROUP BY ALL"""))
def band_by_day(t):
    """Players per band and day in the window."""
    out = report.band_by_day(series.player_day_table(t), days_back=BACK)
    return out.select(text("date_day").alias("date_day"), "acwr_band", "players")


@query("load_table", with_sql("""SELECT full_name, round(a7, 6) AS load_7d, round(c28, 6) AS load_28d_avg_week, round((a7 - c28) / nullif(c28, 0), 6) AS load_vs_norm, round(acwr, 6) AS acwr_coupled, band AS acwr_band, CAST(n AS BIGINT) AS sessions
FROM pd JOIN who USING (player_sk), upto a WHERE date_day = a.d"""))
def load_table_query(t):
    """The load page's table."""
    out = report.load_table(series.player_day_table(t), s.players(t), days_back=BACK)
    return out.select("full_name", "acwr_band", "sessions", *[rnd(c).alias(c) for c in ("load_7d", "load_28d_avg_week", "load_vs_norm", "acwr_coupled")])


@query("injury_report", with_sql("""SELECT fis.injury_id, full_name, position, body_part, side, severity, fis.practice_status, fis.game_status, CAST(event_date AS VARCHAR) AS event_date, CAST(expected_rtp AS VARCHAR) AS expected_rtp, days_out
FROM fis JOIN fi USING (injury_id) JOIN who ON who.player_sk = fis.player_sk, upto a WHERE fis.date_day = a.d"""))
def injury_report(t):
    """Open injuries on the as-of day."""
    out = report.injury_report(series.status_table(t), series.injury(t), s.players(t), series.player_day_table(t), days_back=BACK)
    return out.select("injury_id", "full_name", "position", "body_part", "side", "severity", "practice_status", "game_status", text("event_date").alias("event_date"),
                      text("expected_rtp").alias("expected_rtp"), "days_out")


@query("injuries_by_region", f"""WITH {s.EV}, {s.TO_INJURY} SELECT body_region, count(*) AS injuries FROM fi GROUP BY ALL""")
def injuries_by_region(t):
    """Injuries per body region."""
    return report.injuries_by_region(series.injury(t))


@query("severity_matrix", f"""WITH {s.EV}, {s.TO_INJURY} SELECT severity, count(*) FILTER (body_region = 'lower_body') AS lower_body, count(*) FILTER (body_region = 'upper_body') AS upper_body, count(*) FILTER (body_region = 'head') AS head,
  count(*) FILTER (body_region IS NULL OR body_region NOT IN ('lower_body', 'upper_body', 'head')) AS unmapped FROM fi GROUP BY ALL""")
def severity_matrix(t):
    """Severity by region."""
    return report.severity_matrix(series.injury(t))


@query("player_trends", with_sql("""SELECT player_sk, CAST(date_day AS VARCHAR) AS date_day, round(acwr, 6) AS acwr_coupled, round(eacwr, 6) AS acwr_ewma, round(ext, 6) AS external_load, round(readiness, 6) AS readiness_score, round(mean_cents / 100.0, 6) AS readiness_28d_mean, round(weight_lbs, 6) AS weight_lbs
FROM pd, upto a WHERE date_day > a.d - 28 AND date_day <= a.d"""))
def player_trends(t):
    """Daily series of every player in the window."""
    out = report.player_trends(series.player_day_table(t), days_back=BACK)
    return out.select("player_sk", text("date_day").alias("date_day"), *[rnd(c).alias(c) for c in (
        "acwr_coupled", "acwr_ewma", "external_load", "readiness_score", "readiness_28d_mean", "weight_lbs")])


@query("asymmetry_trend", with_sql("""SELECT player_sk, CAST(test_date AS VARCHAR) AS test_date, round(avg(asymmetry_pct), 6) AS asymmetry_pct, round(avg(asym4), 6) AS asymmetry_4w_avg FROM str, upto a WHERE test_date > a.d - 28 AND test_date <= a.d GROUP BY ALL"""))
def asymmetry_trend(t):
    """Asymmetry per test day in the window."""
    out = report.asymmetry_trend(series.strength_table(t), series.player_day_table(t), days_back=BACK)
    return out.select("player_sk", text("test_date").alias("test_date"), rnd("asymmetry_pct").alias("asymmetry_pct"), rnd("asymmetry_4w_avg").alias("asymmetry_4w_avg"))


@query("player_header", with_sql("""SELECT player_sk, flag, availability, game_status, round(readiness, 6) AS readiness, band AS acwr_band, round(weight_lbs, 6) AS weight_lb, flag_reasons FROM pd, upto a WHERE date_day = a.d"""))
def player_header(t):
    """Header values of every player page."""
    out = report.player_header(series.player_day_table(t), BACK)
    return out.select("player_sk", "flag", "availability", "game_status", rnd("readiness").alias("readiness"), "acwr_band", rnd("weight_lb").alias("weight_lb"), "flag_reasons")


@query("player_injuries", f"""WITH {s.EV}, {s.TO_INJURY} SELECT player_sk, body_part, side, severity, CAST(event_date AS VARCHAR) AS event_date, CAST(return_date AS VARCHAR) AS return_date, days_out, CAST(expected_rtp AS VARCHAR) AS expected_rtp
FROM fi WHERE player_sk = (SELECT min(player_sk) FROM fi)""")
def player_injuries(t):
    """One player's injuries by event date."""
    inj = series.injury(t)
    out = report.player_injuries(inj, inj.agg(F.min("player_sk").alias("v")).scalar())
    return out.select("player_sk", "body_part", "side", "severity", "days_out", *[text(c).alias(c) for c in ("event_date", "return_date", "expected_rtp")])


@query("selected_player", f"""WITH {s.WHO} SELECT CASE WHEN count(DISTINCT full_name) = 1 THEN max(full_name) END AS selected_player, CASE WHEN count(DISTINCT position) = 1 THEN max(position) END AS selected_position,
  CASE WHEN count(DISTINCT team) = 1 THEN max(team) END AS selected_team FROM who WHERE team = 'SF'""")
def selected_player(t):
    """Single-value-or-null of the filtered player dimension."""
    return report.selected(s.players(t).where("team = 'SF'"))


@shared
def dq_runs(t):
    """Order months as runs and order status as source: a scorecard table."""
    rows = t.orders.groupBy(F.trunc("o_orderdate", "month").alias("m"), F.col("o_orderstatus").alias("source")).agg(
        F.count("*").alias("rows_in"), F.count_if(F.col("o_totalprice") > 400000).alias("rows_quarantined"))
    return dq_views.run_summary(rows.select(
        F.col("m").cast("timestamp").alias("created_at"), "source", "rows_in", F.lit(0).alias("duplicates_removed"), "rows_quarantined",
        (F.col("rows_in") - F.col("rows_quarantined")).alias("rows_in_silver"), (F.col("source") != "P").alias("reconciles"), F.lit(11).alias("expectations_run"),
        F.length("source").alias("expectations_failed"), (F.col("rows_quarantined") * 1.0).alias("pct_units_inferred")))


RUNS_SQL = """runs AS (SELECT date_trunc('month', o_orderdate) AS m, o_orderstatus AS source, count(*) AS rows_in, count(*) FILTER (o_totalprice > 400000) AS q FROM orders GROUP BY ALL),
rk AS (SELECT *, dense_rank() OVER (ORDER BY m DESC) AS recency FROM runs)"""


@query("run_cards", f"""WITH {RUNS_SQL} SELECT strftime(max(m), '%Y-%m-%d') AS last_run, CAST(sum(rows_in) AS BIGINT) AS rows_in, CAST(sum(rows_in) - sum(q) AS BIGINT) AS rows_in_silver, round(sum(q) / sum(rows_in), 6) AS quarantined_share,
  CASE WHEN count(*) FILTER (source = 'P') = 0 THEN 'All sources reconcile' ELSE 'RECONCILIATION FAILED' END AS reconciles, CAST(sum(11 - length(source)) AS VARCHAR) || ' / ' || CAST(sum(11) AS VARCHAR) AS expectations FROM rk WHERE recency = 1""")
def run_cards(t):
    """The data page's cards for the latest run."""
    out = report.run_cards(dq_runs(t))
    return out.select(F.date_format("last_run", "yyyy-MM-dd").alias("last_run"), "rows_in", "rows_in_silver", rnd("quarantined_share").alias("quarantined_share"), "reconciles", "expectations")


@query("run_table", f"""WITH {RUNS_SQL} SELECT source, rows_in, 0 AS duplicates_removed, q AS rows_quarantined, rows_in - q AS rows_in_silver, source <> 'P' AS reconciles, length(source) AS expectations_failed, CAST(q AS DOUBLE) AS pct_units_inferred FROM rk WHERE recency = 1""")
def run_table(t):
    """The latest run per source."""
    return report.run_table(dq_runs(t)).withColumn("pct_units_inferred", rnd("pct_units_inferred"))


@query("quarantine_trend", f"""WITH {RUNS_SQL} SELECT strftime(m, '%Y-%m-%d') AS created_at, source, CAST(q AS BIGINT) AS rows_quarantined FROM rk WHERE recency <= 12""")
def quarantine_trend(t):
    """Quarantined rows by run and source over the last twelve runs."""
    return report.quarantine_trend(dq_runs(t)).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))
