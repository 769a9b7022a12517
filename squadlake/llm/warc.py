"""WARC archives: written as one gzip stream each, normalised to a member per record.

Equal payloads are grouped by digest first, so that later ones are written as
revisits.  Tasks write archives as monolithic gzip streams.  The normaliser
inflates such a stream once, piece by piece, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets; a reader then fetches
single records by seeking.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squadlake.llm.files import attempt_name, open_store
from squadlake.llm.shared import Scratch
from squadlake.llm.textblocks import column_of

ARCHIVE_BYTES = 64 << 20  # inflated size at which a task starts another archive
PIECE = 256 << 10
LEVEL = 6
GZIP = 31  # zlib window bits for a gzip header
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("8c9d2a52-3f0e-4a53-9d5c-0a4b6b6f6c11")


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``refers_to``: the least page_id of the same
    payload, where that is another page and the payload has ``min_bytes`` or more.

    Null html is the empty payload.  Rows without a page_id are never revisits.
    The digests alone are grouped and joined; copies of one payload are a skewed
    join's key, not one task's group.
    """
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(payload.cast("binary")).alias("_digest"))
    digests = pages.where(F.octet_length(payload) >= min_bytes).select("page_id", "_digest")
    firsts = digests.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = digests.join(firsts, "_digest").where("page_id > refers_to").distinct()
    return pages.join(revisits, ["page_id", "_digest"], "left").drop("_digest")


def _record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_name(page_id)), ("WARC-Date", DATE)]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_name(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    block = http + payload if refers_to is None else http
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def header_fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if line)


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([values])


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(file, records) of the archives that count; each is one gzip stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        part, number, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(column_of(batch, c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, size, records = attempt_name(part, number, "warc.gz"), 0, 0
                    out, packer = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                raw = record(page_id, url, (html or "").encode(), refers_to)
                out.write(packer.compress(raw))
                size, records = size + len(raw), records + 1
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    out, number = None, number + 1
                    yield _row(file=name, records=records)
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield _row(file=name, records=records)

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "file string, records long")


def inflated(read, window: int = GZIP) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces of bounded size; further members are read too."""
    unpacker = zlib.decompressobj(window)
    while piece := read(PIECE):
        while piece:
            out = unpacker.decompress(piece, PIECE)
            if out:
                yield out
            piece = unpacker.unconsumed_tail
            if unpacker.eof:
                piece = unpacker.unused_data
                unpacker = zlib.decompressobj(window)


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[bool, bytes]]:
    """Pieces of the records of an uncompressed WARC stream; True with a record's first."""
    held = bytearray()
    left = 0  # bytes of the current record still to come
    for piece in pieces:
        held += piece
        while held:
            if left:
                part = bytes(held[:left])
                del held[:left]
                left -= len(part)
                yield False, part
                continue
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            head = bytes(held[:end + 4])
            del held[:end + 4]
            left = int(header_fields(head)["Content-Length"]) + 4
            yield True, head
    if held or left:
        raise ValueError("the archive ends inside a record")


def normalise(archives: DataFrame, source: str, target: str, slots: int) -> DataFrame:
    """Rewrite each archive of ``archives`` (file) with a gzip member per record, and
    beside it an index of lines "offset length".  Returns (file, records, stored)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(source)
        _, goal = open_store(target)
        for batch in batches:
            for name in column_of(batch, "file").to_pylist():
                store.create_dir(goal, recursive=True)
                final = attempt_name(TaskContext.get().partitionId(), 0, "warc.gz")
                index, at, start, packer = [], 0, 0, None
                with store.open_input_stream(f"{base}/{name}", compression=None) as f, store.open_output_stream(f"{goal}/{final}", compression=None) as out:
                    for first, piece in split_records(inflated(f.read)):
                        if first:
                            if packer:
                                tail = packer.flush()
                                out.write(tail)
                                at += len(tail)
                                index.append((start, at - start))
                            packer, start = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), at
                        raw = packer.compress(piece)
                        out.write(raw)
                        at += len(raw)
                    if packer:
                        tail = packer.flush()
                        out.write(tail)
                        at += len(tail)
                        index.append((start, at - start))
                with store.open_output_stream(f"{goal}/{final}.idx", compression=None) as out:
                    out.write("".join(f"{a} {n}\n" for a, n in index).encode())
                yield _row(file=final, records=len(index), stored=at)

    return archives.select("file").repartition(slots).mapInArrow(run, "file string, records long, stored long")


def read_records(archives: DataFrame, folder: str, slots: int) -> DataFrame:
    """A row per record, fetched through the index: page_id, url, record_type, payload
    (null for revisits), payload_bytes, payload_digest and refers_to."""
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for name in column_of(batch, "file").to_pylist():
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]
                rows, size = [], 0
                with store.open_input_file(f"{base}/{name}") as f:
                    for at, n in index:
                        f.seek(at)
                        raw = zlib.decompress(f.read(n), GZIP)
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        fields = header_fields(head)
                        http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
                        whole = fields["WARC-Type"] == "response"
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if whole and digest != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"payload and digest differ at {name}:{at}")
                        page, first = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                        rows.append((page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], payload if whole else None,
                                     len(payload) if whole else int(header_fields(http)["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), first and int(first)))
                        size += len(raw)
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    kinds = ("long", "string", "string", "binary", "long", "string", "long")
    return archives.select("file").repartition(slots).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def archive_pages(pages: DataFrame, scratch: Scratch, slots: int, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back (page_id, url, html): the records as rows."""
    raw, final = scratch.folder("whole"), scratch.folder("members")
    whole = scratch.keep(write_archives(with_revisits(pages, min_bytes), raw), "archives")
    members = scratch.keep(normalise(whole, raw, final, slots), "members")
    return read_records(members, final, slots)
