"""Whole texts as token ids in binary files, and back.

The texts are dealt out by ranges of doc_id, so the files in the order of
(part, number) hold the documents in ascending order; a task rolls over to a new
file every few million ids, which bounds its memory.  A manifest, written as a
table once the job has succeeded, names the files that count and holds each
file's first position.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squadlake.llm.files import attempt_name, open_store
from squadlake.llm.pfor import TokenFile, encode_file
from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import column_of, text_chunks
from squadlake.llm.tokens import TOKEN_CHUNK_BYTES, worker_encoder

FILE_IDS = 2_000_000
MANIFEST = "file string, part long, number long, n_docs long, n_ids long, n_bytes long"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, scratch: Scratch,
                      file_ids: int = FILE_IDS) -> DataFrame:
    """Write (doc_id, text) in ascending doc_id and return the manifest with each
    file's ``first``, the ids in the files before it.

    Null and empty texts are the end id alone.  A null doc_id sorts first; rows
    with one doc_id are all kept, in the order of their texts.  No rows: no files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        part, number = TaskContext.get().partitionId(), 0
        encoder = worker_encoder(tokenizer_path, end_id)
        kept: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            doc_ids = pa.concat_arrays([k[0] for k in kept])
            lengths, ids = np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept])
            name, size = attempt_name(part, number, "pfor"), 0
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/{name}") as out:
                for piece in encode_file(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), lengths, ids):
                    out.write(piece)
                    size += len(piece)
            row = [[name], [part], [number], [len(lengths)], [len(ids)], [size]]
            number, held = number + 1, 0
            kept.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["file", "part", "number", "n_docs", "n_ids", "n_bytes"])

        for batch in batches:
            doc_ids = column_of(batch, "doc_id").cast(pa.int64())
            for low, high, data, offsets in text_chunks(column_of(batch, "text"), TOKEN_CHUNK_BYTES):
                ids, bounds = encoder.encode(data, offsets)
                kept.append((doc_ids.slice(low, high - low), np.diff(bounds), ids))
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if kept:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = scratch.keep(ordered.mapInArrow(write, MANIFEST), "manifest")
    # One row per file of millions of ids: a small window.
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, manifest: DataFrame, folder: str, slots: int) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as f:
                    held = TokenFile.parse(f.read())
                raw = held.ids().astype("<u4").tobytes()
                ends = np.cumsum(held.lengths)
                starts = ends - held.lengths
                view = memoryview(raw)
                sums = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.doc_ids, mask=~held.valid), pa.array(starts + row["first"]), pa.array(held.lengths), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("file", "first").repartition(slots).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
