"""Which records have landed: an index of their hashes beside Bronze.

Each batch adds the hashes that are new with it, cut into files by hash prefix (as many prefixes
as make files of some 65,000 hashes), and a Bloom filter per file.  To find what of a
new batch has landed before, its hashes are tried against the source's filters, two
bytes for each landed hash, and only files whose filter lets something through are
read and joined exactly.  Records nobody has seen cost no file but for one filter hit in
a few thousand, however many batches there are; Bronze itself is never read.

A batch's marker, named by its number and cut (``none`` if it added nothing), is written last.  A batch that landed without one, since its writer
died in between, is indexed from Bronze before the next batch is compared.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_HASHES = 1 << 16
BITS_PER_HASH = 16
PROBES = 4
PREFIX_BITS = 16  # the finest cut: 65,536 files a batch
FILTER_SCHEMA = "number bigint, cut int, bucket int, n_bits bigint, words array<bigint>, _source string"


def bucket_of(digest: Column, cut: Column | int) -> Column:
    """The first ``cut`` bits of a hash in hex (0 to PREFIX_BITS)."""
    head = F.conv(F.substring(digest, 1, PREFIX_BITS // 4), 16, 10).cast("int")
    return F.floor(head / F.pow(F.lit(2), PREFIX_BITS - (F.lit(cut) if isinstance(cut, int) else cut))).cast("int")


def probes(digest: Column, n_bits: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), n_bits) for i in range(PROBES)]


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))


class LandedIndex:
    """The hashes landed in the Bronze table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.hashes, self.filters, self.markers = spark, f"{path}_hashes", f"{path}_filters", f"{path}_indexed"

    def _on_disk(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> set[str]:
        path, files = self._on_disk(folder)
        return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()

    def missing(self, claims: str) -> list[int]:
        """Batches that were claimed and are not indexed."""
        return sorted(int(n) for n in self.names(claims) - {m.split("-")[0] for m in self.names(self.markers)})

    def add(self, digests: DataFrame, column: str, source: str, number: int, at_most: int) -> None:
        """Index the hashes a batch added once it has landed; ``at_most`` bounds their number."""
        if not at_most:
            self._mark(number, "none")
            return
        cut = min(max((at_most - 1) // FILE_HASHES, 0).bit_length(), PREFIX_BITS)
        per_file = max(at_most >> cut, 1)
        n_bits = 1 << max((per_file * BITS_PER_HASH - 1).bit_length(), 10)
        folder = f"{self.hashes}/{number:07d}"
        keyed = digests.where(F.col(column).isNotNull()).select(F.col(column).alias("digest"), bucket_of(F.col(column), cut).alias("bucket")).distinct()
        keyed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        held = self.spark.read.schema("digest string, bucket int").parquet(folder)
        spots = held.select("bucket", F.explode(F.array(*probes(F.col("digest"), F.lit(n_bits)))).alias("p")).select(
            "bucket", F.floor(F.col("p") / 64).cast("int").alias("w"), bit(F.col("p")).alias("b"))
        blank = held.select("bucket").distinct().select("bucket", F.explode(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1))).alias("w"), F.lit(0).cast("bigint").alias("b"))
        words = spots.unionByName(blank).groupBy("bucket", "w").agg(F.bit_or("b").alias("b"))
        filters = words.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x.b).alias("words"))
        filters.select(F.lit(number).cast("bigint").alias("number"), F.lit(cut).alias("cut"), "bucket", F.lit(n_bits).cast("bigint").alias("n_bits"), "words",
                       F.lit(source).alias("_source")).coalesce(1 + (1 << cut) // 64).write.mode("append").partitionBy("_source").parquet(self.filters)
        self._mark(number, cut)

    def _mark(self, number: int, cut: int | str) -> None:
        path, files = self._on_disk(f"{self.markers}/{number:07d}-{cut}")
        files.create(path, True).close()

    def suspects(self, digests: DataFrame, column: str, source: str) -> list[tuple[int, int]]:
        """(batch, bucket) of the files that may hold one of the hashes: at most one for each filter."""
        cuts = sorted({int(c) for m in self.names(self.markers) if (c := m.split("-")[1]) != "none"})  # 17 there can be
        if not cuts or not self.names(self.filters):
            return []
        filters = self.spark.read.schema(FILTER_SCHEMA).parquet(self.filters).where(F.col("_source") == source)
        tried = digests.where(F.col(column).isNotNull()).select(F.col(column).alias("digest")).distinct().select(
            "digest", F.explode(F.array(*[F.lit(c) for c in cuts])).alias("_cut")).withColumn("_bucket", bucket_of(F.col("digest"), F.col("_cut")))
        found = reduce(Column.__and__, [F.get("words", F.floor(p / 64).cast("int")).bitwiseAND(bit(p)) != 0 for p in probes(F.col("digest"), F.col("n_bits"))])
        hits = tried.join(filters, (F.col("cut") == F.col("_cut")) & (F.col("bucket") == F.col("_bucket")) & found)
        return sorted((r.number, r.bucket) for r in hits.select("number", "bucket").distinct().collect())

    def landed(self, files: Iterable[tuple[int, int]]) -> DataFrame:
        """The hashes in some files."""
        paths = [f"{self.hashes}/{number:07d}/bucket={bucket}" for number, bucket in files]
        schema = "digest string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
