import json
import zlib

import pytest

from squadlake.llm.shared import Scratch


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


@pytest.fixture
def docs(spark):
    """docs(texts) -> (doc_id, text, and columns whose names operators use themselves)"""
    def make(rows, partitions=3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
        return df.selectExpr("doc_id", "text", "1 as name", "'x' as key", "2 as u", "3 as hash", "4 as row", "'y' as label")
    return make


@pytest.fixture
def tables(spark, tmp_path):
    """tables(documents=..., ...) -> a folder like the given ones"""
    def make(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)
    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id at all"), (4, "same text here " * 3), (4, "same text here " * 3), (5, "long " * 30_000),
           (6, json.dumps({"ключ": "знач ение 日本語"}, ensure_ascii=False))]
