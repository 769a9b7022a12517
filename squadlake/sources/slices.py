"""Tables that are replaced slice by slice.

A slice is one combination of values of the partition columns, such as a run and a
source.  Writing replaces the slices written and no other: files of other slices are
neither read nor rewritten, whatever the length of the history.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class SliceTable:
    """Parquet under ``path``, partitioned by ``keys``; one writer per slice."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: tuple[str, ...]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _on_disk(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        path, files = self._on_disk(self.path)
        if not files.exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def replace(self, df: DataFrame, **of: str) -> int:
        """Make ``df`` the slice ``of`` (a value for each key) and return its number of
        rows, counted while they are written.  Without rows the slice is empty afterwards."""
        if set(of) != set(self.keys):
            raise ValueError(f"a slice of {self.path} is named by {self.keys}")
        written = Observation()
        rows = df.drop(*self.keys).withColumns({k: F.lit(of[k]) for k in self.keys})
        (rows.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*self.keys).parquet(self.path))
        n = written.get["rows"]
        if not n:  # a dynamic overwrite leaves what gets no rows
            path, files = self._on_disk(self.slice_path(of))
            files.delete(path, True)
        return n

    def slice_path(self, of: Mapping[str, str]) -> str:
        return "/".join([self.path, *(f"{k}={quote(of[k], safe=' -_.,~@!$&()+;')}" for k in self.keys)])
