"""A corpus pipeline: score, clean, deduplicate, decontaminate and pack documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet and hands the reread table to the next one.  All stages but the last
return the columns of their docs.

Rows that share a doc_id are one document for the decisions of stages 3 and 4:
as a near copy it goes when all its rows are copies of a smaller id, as
contaminated when any row is.  Documents without an id are never dropped there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadlake.llm import line_dedup, parity_join, quality, sumsq_pack, winnowing
from squadlake.llm.queries import TOKENIZER, table, training_labels
from squadlake.llm.shared import Scratch, delete_folder

QUALITY_THRESHOLD = 0.3
END_ID = 0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    with Scratch(spark) as scratch:
        stats = scratch.keep(quality.document_statistics(docs), "statistics")
        model = quality.fit(stats, training_labels(spark, sf_dir, "quality"))
    return quality.kept(docs, model, QUALITY_THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that have no text left without them."""
    with Scratch(spark) as scratch:
        drops = scratch.result(line_dedup.dropped_lines(docs, scratch))
    kept = line_dedup.without_lines(docs, drops)
    kept = kept.where(~((F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x00-\x20]")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the least id."""
    with Scratch(spark) as scratch:
        found = scratch.result(parity_join.classes(docs, scratch))
    copy = F.col("doc_id") != F.col("component_id")
    losers = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(copy).alias("copy")).where("copy").select("doc_id")
    twins = found.where(~copy & (F.col("n_shingles") > 0)).groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = docs.join(losers, "doc_id", "left_anti")
    if not twins.isEmpty():
        kept = kept.join(twins, "doc_id", "left_anti").unionByName(kept.join(twins, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in windows of the benchmark go."""
    with Scratch(spark) as scratch:
        found = winnowing.contamination(docs, table(spark, sf_dir, "benchmark"), scratch)
        bad = scratch.result(found.where(winnowing.is_contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with the sequence and offset of each."""
    with Scratch(spark) as scratch:
        pieces = scratch.result(sumsq_pack.token_pieces(docs, public_tokenizers.path(TOKENIZER), END_ID))
    return sumsq_pack.pack(pieces, pieces.count())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_copy_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

# Trained models, edit distances and tokenizers are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        scratch = Scratch(spark)
        docs = scratch.result(stage(spark, docs, sf_dir))
        if before:
            delete_folder(spark, before)
        before = scratch.results[-1]
    return docs
