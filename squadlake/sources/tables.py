"""Persisted tables: versioned folders for state that is rewritten from itself,
and catalog tables or views per layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Layer -> how its models are published.
MATERIALISATION = {"staging": "view", "dims": "table", "facts": "table", "marts": "table", "dq": "view"}
LAYER_DATABASE = {"staging": "silver", "dims": "gold", "facts": "gold", "marts": "gold", "dq": "gold"}


def publish(df: DataFrame, name: str, layer: str) -> str:
    """Publish a model under its layer's policy and return the name it can be read by.

    Tables go to the layer's database by full refresh; views are temporary
    (session catalog) and always current.
    """
    if MATERIALISATION[layer] == "view":
        df.createOrReplaceTempView(name)
        return name
    spark = df.sparkSession
    database = LAYER_DATABASE[layer]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    df.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")
    return f"{database}.{name}"


class TableStore:
    """Full-refresh tables under one root.

    ``replace`` writes a new version folder; readers take the newest folder
    that carries the committer's ``_SUCCESS`` marker.  A table can therefore be
    computed from its own previous version, a failed write changes nothing, and
    writing also cuts the lineage.  One writer per table.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def versions(self, name: str) -> list[int]:
        fs, folder = self._fs(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = sorted(int(n.split("=")[1]) for n in found if n.startswith("version="))
        done = []
        for n in numbers:
            marker_fs, marker = self._fs(f"{self.root}/{name}/version={n}/_SUCCESS")
            if marker_fs.exists(marker):
                done.append(n)
        return done

    def has(self, name: str) -> bool:
        return bool(self.versions(name))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        done = self.versions(name)
        if not done:
            if schema is None:
                raise FileNotFoundError(f"{self.root}/{name} has no committed version")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/version={done[-1]}")

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next version, drop versions beyond ``keep``, return the new one."""
        done = self.versions(name)
        target = f"{self.root}/{name}/version={(done[-1] if done else 0) + 1}"
        df.write.mode("overwrite").parquet(target)
        for old in done[: max(0, len(done) + 1 - self.keep)]:
            fs, folder = self._fs(f"{self.root}/{name}/version={old}")
            fs.delete(folder, True)
        return self.spark.read.parquet(target)
