"""Roster cache: the prepared player list feeds are keyed against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squadlake.functions.casts import num
from squadlake.operators.dedup import first_per_key

COLUMNS = ["gsis_id", "nfl_id", "espn_id", "full_name", "first_name", "last_name", "team", "position", "weight_lbs",
           "height_in"]

# Tracked positions with their default (weight in lb, height in inches), and active statuses.
POSITION_DEFAULTS = {
    "QB": (220, 75), "RB": (212, 71), "FB": (245, 73), "WR": (200, 73), "TE": (250, 77),
    "T": (315, 78), "G": (315, 76), "C": (305, 75), "OL": (312, 77), "OT": (315, 78), "OG": (315, 76),
    "DE": (270, 76), "DT": (305, 75), "NT": (330, 74), "DL": (295, 76), "EDGE": (255, 76),
    "LB": (240, 74), "ILB": (240, 74), "OLB": (245, 74), "MLB": (240, 74),
    "CB": (192, 71), "S": (205, 72), "FS": (200, 72), "SS": (210, 72), "DB": (198, 71),
}
ACTIVE = ("ACT", "Active")


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def synthetic_id(gsis: Column, offset: int) -> Column:
    """A stable stand-in id in a range no real id uses.

    Only the digits' remainder matters, so a digit string of any length is
    folded without leaving 64 bits.
    """
    digits = F.regexp_replace(F.coalesce(gsis, F.lit("")), "[^0-9]", "")
    remainder = F.aggregate(F.filter(F.split(digits, ""), lambda d: d != ""), F.lit(0).cast("bigint"),
                            lambda acc, d: (acc * 10 + d.cast("bigint")) % 9_000_000)
    return F.lit(90_000_000) + (remainder * 31 + offset) % 9_000_000


def prepare_roster(rosters: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """Active, tracked players with every id filled in.

    ``order`` says which of several rows of a player comes first; the crosswalk
    keeps its last row in the same order.
    """
    xwalk = first_per_key(ids.where("gsis_id is not null"), ["gsis_id"], [F.col(c).desc_nulls_first() for c in order]).select(
        F.col("gsis_id").alias("_g"), F.col("nfl_id").alias("_nfl"), F.col("espn_id").alias("_espn"))
    rows = rosters.withColumnsRenamed({"player_id": "gsis_id", "player_name": "full_name"})
    if "status" in rows.columns:
        rows = rows.where(F.col("status").isin(*ACTIVE))
    rows = rows.where(F.col("position").isin(*POSITION_DEFAULTS)).dropna(subset=["gsis_id", "full_name", "team"])
    rows = first_per_key(rows, ["gsis_id"], [F.col(c).asc_nulls_last() for c in order])
    rows = rows.join(xwalk, F.col("gsis_id") == F.col("_g"), "left")
    espn = F.coalesce("espn_id", "_espn") if "espn_id" in rows.columns else F.col("_espn")
    default = lambda i: F.create_map(
        *[F.lit(x) for p, v in POSITION_DEFAULTS.items() for x in (p, float(v[i]))])[F.col("position")]
    as_id = lambda c, offset: F.coalesce(num(c.cast("string")).cast("bigint"), synthetic_id(F.col("gsis_id"), offset))
    return rows.select(
        "gsis_id", as_id(F.col("_nfl"), 1).alias("nfl_id"), as_id(espn, 2).alias("espn_id"), "full_name", "first_name",
        "last_name", "team", "position", F.coalesce(num(F.col("weight").cast("string")), default(0)).alias("weight_lbs"),
        F.coalesce(num(F.col("height").cast("string")), default(1)).alias("height_in"))
