"""Bronze: raw records as they came, landed once.

Layout: Parquet partitioned by (_source, _endpoint), append only.  A record is
identified by its source and the md5 of its canonical JSON.  Beside the table lie
``<path>_claims`` (a file per batch: it gives the batch its range of ids, and two
writers can not get the same) and ``<path>_rejects`` (what is not JSON).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from squadlake.operators.dedup import first_per_key
from squadlake.sources.landed_index import LandedIndex

BRONZE_SCHEMA = ("id bigint, payload string, _ingested_at timestamp, _batch_id string, _payload_hash string, "
                 "_schema_version string, _source string, _endpoint string")
PARTITIONS = ("_source", "_endpoint")
REJECT_SCHEMA = "payload string, _ingested_at timestamp, _batch_id string, _source string, _endpoint string"

# An id is batch number, then partition, then row: 2 ** 20 batches of up to 8,192
# range partitions of 2 ** 30 rows.
BATCH_BITS, ROW_BITS = 43, 30
MAX_PARTITIONS = 1 << (BATCH_BITS - ROW_BITS)


def payload_hash(payload: Column) -> Column:
    """md5 of the JSON with keys sorted at every level and no spaces; NULL if it is not JSON."""
    return F.md5(F.to_json(F.try_parse_json(payload)))


def records_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text: every column kept, NaN as null, values otherwise unchanged."""
    kinds = dict(df.dtypes)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("payload"))


def explode_columnar(df: DataFrame, time_col: str, value_cols: list[str], struct: str, constants: list[str]) -> DataFrame:
    """Unwind an array-of-columns payload: one row per position, constants repeated."""
    zipped = F.arrays_zip(*[F.col(f"{struct}.{c}").alias(c) for c in [time_col, *value_cols]])
    return df.select(*constants, F.inline(zipped))


def project_at_ingest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Land only the columns that are used; the scan reads nothing else."""
    return df.select(*columns)


@dataclass(frozen=True)
class Landing:
    """What one call landed."""

    source: str
    endpoint: str
    batch_id: str
    fetched: int
    inserted: int
    rejected: int
    hash_files: int  # files of landed hashes that were read to compare with


class BronzeTable:
    """The landed records under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.index = LandedIndex(spark, path)

    def _on_disk(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        path, files = self._on_disk(self.path)
        return files.exists(path)

    def _claim(self) -> int:
        """A batch number of its own: the first whose file this writer creates."""
        folder, files = self._on_disk(f"{self.path}_claims")
        number = len(files.listStatus(folder)) if files.exists(folder) else 0
        while True:
            try:
                files.create(self._on_disk(f"{self.path}_claims/{number:07d}")[0], False).close()
                return number
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception) and "already exists" not in str(e.java_exception):
                    raise
                number += 1

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], BRONZE_SCHEMA)
        return self.spark.read.schema(BRONZE_SCHEMA).parquet(self.path)

    def rejects(self) -> DataFrame:
        """What came but is not JSON, as it came."""
        path, files = self._on_disk(f"{self.path}_rejects")
        if not files.exists(path):
            return self.spark.createDataFrame([], REJECT_SCHEMA)
        return self.spark.read.schema(REJECT_SCHEMA).parquet(f"{self.path}_rejects")

    def fetch(self, source: str, endpoint: str | None = None) -> DataFrame:
        """All records of a source or one stream: a partition filter.  Order by
        (_ingested_at, id) only inside the windows that need it."""
        rows = self.read().where(F.col("_source") == source)
        return rows if endpoint is None else rows.where(F.col("_endpoint") == endpoint)

    def unseen(self, batch: DataFrame, source: str, order: list[str], folder: str) -> tuple[DataFrame, int]:
        """Rows of ``batch`` (with ``_payload_hash``) that are not landed yet, each hash by
        its first row in ``order``, and the number of files of landed hashes that
        takes.  Bronze itself is not read.  First rows and the hashes found are stored
        under ``folder``: the comparison, the write and the index read them."""
        first_per_key(batch, ["_payload_hash"], [F.col(c).asc() for c in order]).write.parquet(f"{folder}/first")
        fresh = self.spark.read.schema(batch.schema).parquet(f"{folder}/first")
        files = self.index.suspects(fresh, "_payload_hash", source)
        if not files:
            return fresh, 0
        wanted = fresh.select(F.col("_payload_hash").alias("_w"))
        found = self.index.landed(files).join(wanted, F.col("digest") == F.col("_w"), "left_semi").select(F.col("digest").alias("_hit")).distinct()
        found.write.parquet(f"{folder}/hits")
        hits = self.spark.read.schema(found.schema).parquet(f"{folder}/hits")
        return fresh.join(hits, F.col("_payload_hash") == F.col("_hit"), "left_anti"), len(files)

    def _index_orphans(self, own: int) -> None:
        """Index batches whose writer died between landing and indexing."""
        for number in self.index.missing(f"{self.path}_claims"):
            if number == own or not self.exists():
                continue
            rows = self.read().where((F.col("id") >= number << BATCH_BITS) & (F.col("id") < (number + 1) << BATCH_BITS))
            for r in rows.groupBy("_source").agg(F.count("*").alias("n")).collect():
                self.index.add(rows.where(F.col("_source") == r["_source"]), "_payload_hash", r["_source"], number, r.n)

    def land(self, df: DataFrame, *, source: str, endpoint: str, batch_id: str, schema_version: str | None = None,
             ingested_at: Column | None = None, order: list[str] | None = None) -> Landing:
        """Stamp, hash and append the records not seen before.

        ``df`` has ``payload`` (JSON text) and optionally emission-order columns
        named in ``order``; rows equal in them follow their order in ``df``.  Ids
        follow that order and grow from batch to batch; like a sequence they may
        have gaps.  Of equal records the first one emitted is kept.  Text that is
        not JSON goes to the rejects, with its count.  The batch is stored once, so
        its source is read once, and nothing is renumbered when a task is repeated.
        Only what it adds is indexed: the rest is in the index already.
        """
        order = [*(order or []), "_position"]
        number = self._claim()
        self._index_orphans(number)
        staging = f"{self.path}_staging/{uuid.uuid4().hex}"
        came, went = Observation(), Observation()
        df.withColumn("_position", F.monotonically_increasing_id()).select(
            "payload", *order, payload_hash(F.col("payload")).alias("_payload_hash")).observe(
            came, F.count(F.lit(1)).alias("rows"), F.count("_payload_hash").alias("valid")).write.parquet(f"{staging}/batch")
        try:
            stored = self.spark.read.parquet(f"{staging}/batch")
            fetched, valid = came.get["rows"], came.get["valid"]
            now = (F.current_timestamp() if ingested_at is None else ingested_at).cast("timestamp")
            stamp = [now.alias("_ingested_at"), F.lit(batch_id).alias("_batch_id")]
            where = [F.lit(source).alias("_source"), F.lit(endpoint).alias("_endpoint")]
            if valid < fetched:
                rejected = stored.where("_payload_hash is null").select("payload", *stamp, *where)
                rejected.write.mode("append").parquet(f"{self.path}_rejects")
            partitions = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), MAX_PARTITIONS)
            kept = stored.where("_payload_hash is not null")
            new, hash_files = self.unseen(kept, source, order, staging)
            row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.call_function("shiftleft", F.spark_partition_id().cast("bigint"), F.lit(ROW_BITS))
            rows = new.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select(
                (F.lit(number << BATCH_BITS) + row).alias("id"), "payload", *stamp, "_payload_hash",
                F.lit(schema_version).cast("string").alias("_schema_version"), *where)
            rows.observe(went, F.count(F.lit(1)).alias("rows")).write.mode("append").partitionBy(*PARTITIONS).parquet(self.path)
            inserted = went.get["rows"]
            self.index.add(new, "_payload_hash", source, number, inserted)
            return Landing(source, endpoint, batch_id, fetched, inserted, fetched - valid, hash_files)
        finally:
            path, files = self._on_disk(staging)
            files.delete(path, True)


def schema_versions(bronze: DataFrame) -> DataFrame:
    """Records per envelope version; a missing version counts as 'none'."""
    version = F.coalesce(F.nullif(F.col("_schema_version"), F.lit("")), F.lit("none"))
    return bronze.groupBy(version.alias("schema_version")).agg(F.count("*").alias("records"))
