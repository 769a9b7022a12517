"""Seed tables: small CSV files with declared column types."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STADIUM_SCHEMA = ("team string, stadium string, city string, state string, latitude double, longitude double, "
                  "is_dome boolean, surface string")
BODY_PART_SCHEMA = "raw_text string, body_part string, body_region string, side string"


def read_seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV seed with a header line and explicit types, from a folder all executors see."""
    return spark.read.schema(schema).option("header", True).csv(path)


def packaged_lines(name: str) -> list[str]:
    return (resources.files("squadlake.sources") / "seed_files" / name).read_text().splitlines()


def packaged_seed(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A seed that comes with the package: executors need no copy of the file."""
    lines = spark.createDataFrame([(line,) for line in packaged_lines(name)[1:]], "line string")
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")


def stadiums(spark: SparkSession) -> DataFrame:
    return packaged_seed(spark, "stadiums.csv", STADIUM_SCHEMA)


def body_part_rows() -> list[tuple[str, str, str, str | None]]:
    return [tuple(cell or None for cell in line.split(",")) for line in packaged_lines("injury_body_parts.csv")[1:]]


def injury_body_parts(spark: SparkSession) -> DataFrame:
    return packaged_seed(spark, "injury_body_parts.csv", BODY_PART_SCHEMA)
