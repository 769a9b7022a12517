"""Resolve differing vendor identifiers to one surrogate key, set at a time.

Records are first reduced to their distinct identifiers (a partial aggregate,
so one identifier on a third of the rows is one row per map task), the rule
cascade runs on those, and the answer is joined back.  First matching rule
wins:

    1 league id   2 numeric id   3 stored vendor map   4 name + team
    5 name alone if unique       6 unresolved (or ambiguous)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squadlake.functions.casts import whole
from squadlake.functions.text import clean_name
from squadlake.session import materialise

# Method names in the order they are tried, and their confidence.
METHODS = ("gsis_id", "nfl_id", "vendor_map", "name_team", "name_unique", "unresolved")
CONFIDENCE = {"gsis_id": 1.0, "nfl_id": 1.0, "name_team": 0.9, "name_unique": 0.75}

IDENTIFIER = ("gsis", "nfl", "vid", "name", "team")
PLAYER_MAP_SCHEMA = ("vendor string, vendor_player_id string, player_sk bigint, resolved_by string, "
                     "confidence double, first_seen timestamp, last_seen timestamp")


def _text(c: Column | None) -> Column:
    return F.lit(None).cast("string") if c is None else c.cast("string")


def identifier_columns(*, gsis: Column | None = None, nfl: Column | None = None, vid: Column | None = None,
                       name: Column | None = None, team: Column | None = None) -> dict[str, Column]:
    """The five identifier columns.  Name-only vendors are identified by the raw name."""
    return {"gsis": _text(gsis), "nfl": _text(nfl), "vid": F.coalesce(_text(vid), _text(name)),
            "name": _text(name), "team": _text(team)}


def identifier_key(ids: dict[str, Column]) -> Column:
    """One digest over the identifier columns, its bytes; NULL and '' stay apart."""
    parts = [F.coalesce(F.concat(F.lit("="), ids[i]), F.lit("-")) for i in IDENTIFIER]
    return F.unhex(F.sha2(F.concat_ws("\u001f", *parts), 256))


def alias_index(players: DataFrame) -> DataFrame:
    """(player_sk, clean, team) for every name an active player answers to."""
    has = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    other = lambda first: F.when(has(first) & has("last_name"), F.concat_ws(" ", first, "last_name"))
    known = F.nullif(F.col("clean_name"), F.lit(""))
    names = F.array(F.struct(F.col("full_name").alias("raw"), known.alias("clean")),
                    *[F.struct(other(f).alias("raw"), F.lit(None).cast("string").alias("clean"))
                      for f in ("first_name", "football_name")])
    return (players.where("valid_to is null")
            .select("player_sk", F.upper("team").alias("team"), F.explode(names).alias("n"))
            .select("player_sk", F.coalesce("n.clean", clean_name(F.col("n.raw"))).alias("clean"), "team")
            .where("clean <> ''").distinct())


@dataclass
class Resolved:
    """Outcome of one vendor's run."""

    records: DataFrame      # input columns + player_sk, resolved_by, confidence, reason, n_candidates
    identifiers: DataFrame  # one row per distinct identifier, with occurrences
    index: DataFrame        # alias index the run used


def resolve_identifiers(identifiers: DataFrame, players: DataFrame, vendor_map: DataFrame, vendor: str,
                        index: DataFrame | None = None) -> DataFrame:
    """Run the cascade on rows holding the identifier columns."""
    active = players.where("valid_to is null")
    index = alias_index(players) if index is None else index
    by_gsis = active.where("gsis_id <> ''").groupBy(F.col("gsis_id").alias("_gsis")).agg(F.max("player_sk").alias("_sk1"))
    by_nfl = active.where("nfl_id is not null").groupBy(F.col("nfl_id").alias("_nfl")).agg(F.max("player_sk").alias("_sk2"))
    by_map = (vendor_map.where(F.col("vendor") == vendor)
              .select(F.col("vendor_player_id").alias("_vid"), F.col("player_sk").alias("_sk3"),
                      F.col("confidence").alias("_conf3")))
    size = [F.count("*").alias("n"), F.min("player_sk").alias("sk")]
    name_team = (index.where("team <> ''").select("player_sk", "clean", "team").distinct()
                 .groupBy(F.col("clean").alias("_c4"), F.col("team").alias("_t4")).agg(*size)
                 .withColumnsRenamed({"n": "_n4", "sk": "_sk4"}))
    name_only = (index.select("player_sk", "clean").distinct()
                 .groupBy(F.col("clean").alias("_c5")).agg(*size)
                 .withColumnsRenamed({"n": "_n5", "sk": "_sk5"}))

    probe = identifiers.withColumns({"clean": clean_name(F.col("name")), "_team": F.upper("team"),
                                     "_num": whole(F.col("nfl"))})
    j = (probe.join(by_gsis, F.col("gsis") == F.col("_gsis"), "left")
              .join(by_nfl, F.col("_num") == F.col("_nfl"), "left")
              .join(by_map, F.col("vid") == F.col("_vid"), "left")
              .join(name_team, (F.col("clean") == F.col("_c4")) & (F.col("_team") == F.col("_t4")), "left")
              .join(name_only, F.col("clean") == F.col("_c5"), "left"))

    rule = (F.when(F.col("_sk1").isNotNull(), 1).when(F.col("_sk2").isNotNull(), 2)
             .when(F.col("_sk3").isNotNull(), 3).when(F.col("clean") == "", 6)
             .when(F.col("_n4") == 1, 4).when(F.col("_n4") > 1, 7)
             .when(F.col("_n5") == 1, 5).when(F.col("_n5") > 1, 8).otherwise(6))
    j = j.withColumn("_rule", rule)
    r = F.col("_rule")
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.least(r, F.lit(6)))
    conf = (F.when(r == 3, F.col("_conf3")).when(r == 4, CONFIDENCE["name_team"])
             .when(r == 5, CONFIDENCE["name_unique"]).when(r <= 2, 1.0))
    out = {
        "player_sk": F.when(r <= 5, F.element_at(F.array(*[F.col(f"_sk{i}") for i in range(1, 6)]), F.least(r, F.lit(5)))),
        "resolved_by": method,
        "confidence": conf,
        "reason": F.when(r >= 7, "ambiguous").when(r == 6, "unresolved"),
        "n_candidates": F.when(r == 7, F.col("_n4")).when(r == 8, F.col("_n5")).otherwise(F.lit(0)).cast("bigint"),
        "candidate_team": F.when(r == 7, F.col("_team")),
    }
    return j.select(*identifiers.columns, "clean", *[c.alias(n) for n, c in out.items()])


def resolve(records: DataFrame, players: DataFrame, vendor_map: DataFrame, vendor: str, *,
            id_col: str = "bronze_id", **ids: Column) -> Resolved:
    """Resolve every record; ``ids`` are the columns accepted by ``identifier_columns``."""
    cols = identifier_columns(**ids)
    keyed = records.withColumn("_ident", identifier_key(cols))
    distinct = (keyed.groupBy("_ident")
                .agg(*[F.first(cols[i]).alias(i) for i in IDENTIFIER],
                     F.count("*").alias("occurrences"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")))
    index = alias_index(players)
    # Read by the record join, the pins, the quarantine and the counts: written once.
    found = materialise(resolve_identifiers(distinct, players, vendor_map, vendor, index))
    answer = found.select(F.col("_ident").alias("_i"), "player_sk", "resolved_by", "confidence", "reason",
                          "n_candidates", "candidate_team", F.col("clean").alias("candidate_name"))
    joined = keyed.join(answer, F.col("_ident") == F.col("_i"), "left").drop("_i", "_ident")
    return Resolved(joined, found, index)


def candidates(identifiers: DataFrame, index: DataFrame) -> DataFrame:
    """One row per (ambiguous identifier's name and team, tied player)."""
    tied = (identifiers.where("reason = 'ambiguous'")
            .select(F.col("clean").alias("_n"), F.col("candidate_team").alias("_t")).distinct())
    pairs = index.select("player_sk", "clean", "team").distinct()
    return (tied.join(pairs, F.col("_n") == F.col("clean"))
            .where(F.col("_t").isNull() | (F.col("_t") == F.col("team")))
            .select(F.col("_n").alias("candidate_name"), F.col("_t").alias("candidate_team"), "player_sk").distinct())


def candidate_arrays(identifiers: DataFrame, index: DataFrame) -> DataFrame:
    """The tied players of each ambiguous name as a sorted array.

    An array is as long as the number of rostered people who share one full
    name; it is built from the roster, never from event rows.
    """
    return (candidates(identifiers, index).groupBy("candidate_name", "candidate_team")
            .agg(F.sort_array(F.collect_set("player_sk")).alias("candidate_sks")))


def method_counts(identifiers: DataFrame) -> DataFrame:
    """Records per method."""
    return identifiers.groupBy("resolved_by").agg(F.sum("occurrences").cast("bigint").alias("records"))


def as_map(counts: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A short key -> count table as one map-valued row."""
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def new_pins(found: Resolved, vendor_map: DataFrame, vendor: str) -> DataFrame:
    """Vendor ids resolved by a rule other than the map and not in it yet; the latest record's answer counts."""
    known = vendor_map.where(F.col("vendor") == vendor).select(F.col("vendor_player_id").alias("_k"))
    learned = (found.identifiers.where("player_sk is not null and vid is not null and resolved_by <> 'vendor_map'")
               .join(known, F.col("vid") == F.col("_k"), "left_anti"))
    best = F.max_by(F.struct("player_sk", "resolved_by", "confidence"), "last_id")
    return (learned.groupBy(F.col("vid").alias("vendor_player_id")).agg(best.alias("_b"))
            .select(F.lit(vendor).alias("vendor"), "vendor_player_id", "_b.*"))


def merge_pins(vendor_map: DataFrame, pins: DataFrame, now: Column) -> DataFrame:
    """Insert new pins; a pin that exists keeps its mapping and gets a new ``last_seen``."""
    old = vendor_map.select([F.col(c).alias(f"o_{c}") for c in vendor_map.columns])
    j = old.join(pins, (F.col("o_vendor") == F.col("vendor"))
                 & (F.col("o_vendor_player_id") == F.col("vendor_player_id")), "full")
    had, has = F.col("o_vendor").isNotNull(), F.col("vendor").isNotNull()
    keep = lambda c: F.when(had, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    return j.select(keep("vendor"), keep("vendor_player_id"), keep("player_sk"), keep("resolved_by"), keep("confidence"),
                    F.when(had, F.col("o_first_seen")).otherwise(now).alias("first_seen"),
                    F.when(has, now).otherwise(F.col("o_last_seen")).alias("last_seen"))


def identity_quarantine(found: Resolved, vendor: str, with_candidates: bool = True) -> DataFrame:
    """One row per (vendor, identifier, reason) that could not be pinned."""
    head = F.min_by(F.struct("name", "team", "clean", "candidate_team", "n_candidates"), "first_id")
    q = (found.identifiers.where("player_sk is null")
         .groupBy(F.coalesce("vid", F.lit("")).alias("vendor_player_id"), "reason")
         .agg(head.alias("_h"), F.sum("occurrences").cast("bigint").alias("occurrences"),
              F.min("first_id").alias("example_bronze_id"))
         .select(F.lit(vendor).alias("vendor"), "vendor_player_id", F.col("_h.name").alias("raw_name"),
                 F.col("_h.team").alias("raw_team"), "reason", "occurrences", "example_bronze_id",
                 F.col("_h.n_candidates").alias("n_candidates"), F.col("_h.clean").alias("_cn"),
                 F.col("_h.candidate_team").alias("_ct")))
    if with_candidates:
        arrays = candidate_arrays(found.identifiers, found.index)
        q = q.join(arrays, (F.col("reason") == "ambiguous") & (F.col("_cn") == F.col("candidate_name"))
                   & F.col("_ct").eqNullSafe(F.col("candidate_team")), "left").drop("candidate_name", "candidate_team")
    return q.drop("_cn", "_ct")
