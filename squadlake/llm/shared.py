"""Tables and files in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary
    folder on one machine (local masters) or the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        folder = f"file://{tempfile.mkdtemp(prefix='llm-')}" if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if "://" in folder or folder.startswith("file:") else "file://" + folder.rstrip("/")


def delete_folder(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Rows of an Arrow batch: texts of some kilobytes each pass through two workers an
# executor, so this bounds the memory beside its heap.
BATCH_ROWS = "2000"
_RESULTS: list[str] = []  # folders of results written by this driver


def release_results(spark: SparkSession) -> None:
    """Delete the results that queries returned so far, once nothing reads them any more."""
    while _RESULTS:
        delete_folder(spark, _RESULTS.pop())


class Scratch:
    """Intermediate tables of one query.

    ``keep`` writes a frame as Parquet and reads it back: it cuts the lineage,
    and a lost executor costs one step only.  Leaving the context deletes every
    table but those returned by ``result``, which the caller still reads.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.results: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete_folder(self.spark, self.root)

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def _stored(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str = "table", batch_rows: str = BATCH_ROWS) -> DataFrame:
        """Store ``df``; ``batch_rows`` is for rows much wider or narrower than a text."""
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
        try:
            return self._stored(df, self.folder(name))
        finally:
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing lazy reads any more."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.startswith(self.root.replace("file:///", "file:/")) or path.startswith(self.root):
                delete_folder(self.spark, path)

    def result(self, df: DataFrame) -> DataFrame:
        path = f"{shared_folder(self.spark)}/llm-result-{uuid.uuid4().hex}"
        self.results.append(path)
        _RESULTS.append(path)
        return self._stored(df, path)
