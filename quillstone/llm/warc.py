"""WARC archives as a chunked record table.

An archive is a table (record_no, chunk_no, chunks, data, digest_so_far): the bytes of a record, header, payload and end, are its data
in the order of chunk_no. A payload of any size passes through in pieces of chunk_bytes, both ways; the SHA-1 of the
payload is carried along, and every row holds its value so far, so that a damaged chunk is found where it lies.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import bound_batches

ARCHIVE = "record_no long, chunk_no int, chunks int, data binary, digest_so_far string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FLUSH = 4 << 20
_END = b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, record_no: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}' if page_id is not None else f'record:{record_no}')}>"


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), payload_bytes, refers_to: of equal payloads the smallest page_id is the one to refer to.

    Digests are grouped with a partial aggregate first; the join back is a plain equi-join, whose large groups Spark can split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    equal = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes"))
    first = equal.agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = rows.join(first.hint("shuffle_hash"), (F.col("sha1") == F.col("_sha1")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "sha1", "payload_bytes", refers.alias("refers_to"))


def header(page_id: int | None, url: str | None, sha1: str, size: int, refers_to: int | None, record_no: int) -> bytes:
    """The WARC header and the start of the block, up to the payload."""
    digest = base32(bytes.fromhex(sha1))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, record_no)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, record_no)),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("X-Page-ID", page_id),
        ("X-Refers-To-Page-ID", refers_to),
        ("X-Payload-Length", size),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(http) + (size if refers_to is None else 0)),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode() + http


def _write(chunk_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["record_no", "chunk_no", "chunks", "data", "digest_so_far"])

        for batch in batches:
            cols = [batch[c] for c in ("record_no", "page_id", "url", "payload", "sha1", "payload_bytes", "refers_to")]
            for i in range(batch.num_rows):
                no, page, url, payload, sha1, size, refers = (c[i].as_buffer() if k == 3 else c[i].as_py() for k, c in enumerate(cols))
                body = memoryview(payload) if refers is None else memoryview(b"")
                ahead, digest, chunk_no, at = header(page, url, sha1, size, refers, no), hashlib.sha1(usedforsecurity=False), 0, 0
                total = max(1, -(-(len(ahead) + len(body)) // chunk_bytes))
                while True:
                    piece = body[at : at + max(1, chunk_bytes - len(ahead))]
                    at += len(piece)
                    digest.update(piece)
                    last = at >= len(body)
                    data = b"".join((ahead, piece, _END if last else b""))
                    rows.append((no, chunk_no, total, data, base32(digest.digest())))
                    held, chunk_no, ahead = held + len(data), chunk_no + 1, b""
                    if held >= _FLUSH or len(rows) >= 8192:
                        yield flush()
                        rows.clear()
                        held = 0
                    if last:
                        break
        if rows:
            yield flush()

    return run


def archive(pages: DataFrame, least_bytes: int = 0, chunk_bytes: int = 256 << 10) -> DataFrame:
    """The archive table of pages (page_id, url, html); see RECORDS for what reading it back gives.

    A null html is an empty payload, a null url leaves its field out, a null page_id refers to the smallest id of its payload if
    there is one and is never referred to. Rows repeated with their id are each a record of the same type. Payloads under least_bytes are
    all responses. An empty table gives an empty archive; other columns are not read.
    """
    bound_batches(pages.sparkSession)
    rows = plan_records(pages, least_bytes).withColumn("record_no", F.monotonically_increasing_id())
    return rows.mapInArrow(_write(chunk_bytes), ARCHIVE)


class RecordParser:
    """Parses one record's bytes as they come; keeps the headers and a running digest, never the payload."""

    def __init__(self) -> None:
        self.head, self.fields, self.http = b"", None, False
        self.digest, self.size, self.left, self.tail = hashlib.sha1(usedforsecurity=False), 0, 0, b""

    def feed(self, data: bytes | memoryview) -> list[memoryview]:
        """The pieces of the payload in data."""
        view = memoryview(data)
        while not self.http:
            self.head += bytes(view)
            cut = self.head.find(_END)
            if cut < 0:
                return []
            lines, view, self.head = self.head[:cut].decode().split("\r\n"), memoryview(self.head[cut + 4 :]), b""
            if self.fields is None:
                if not lines[0].startswith("WARC/1."):
                    raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
                self.fields = dict(x.split(": ", 1) for x in lines[1:])
                self.left = int(self.fields["Content-Length"])
            else:
                self.left -= cut + 4
                self.http = True
        piece, rest = view[: self.left], view[self.left :]
        self.left -= len(piece)
        self.size += len(piece)
        self.digest.update(piece)
        self.tail += bytes(rest)
        return [piece] if len(piece) else []

    def close(self) -> tuple:
        f = self.fields
        if f is None or not self.http or self.left or self.tail != _END:
            raise ValueError("a record ends early or has bytes after its end")
        number = lambda k: int(f[k]) if k in f else None
        stated, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"])
        if f["WARC-Type"] == "response" and (base32(self.digest.digest()), self.size) != (stated, size):
            raise ValueError(f"the payload of {f['WARC-Record-ID']} doesn't have the digest and length that its header states")
        return number("X-Page-ID"), f.get("WARC-Target-URI"), size, stated, f["WARC-Type"], number("X-Refers-To-Page-ID")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    parser, now, due = None, None, 0
    for batch in batches:
        out = []
        nos, chunks, data, states = batch["record_no"].to_pylist(), batch["chunk_no"].to_pylist(), batch["data"], batch["digest_so_far"].to_pylist()
        for i, no in enumerate(nos):
            if no != now:
                if parser:
                    out.append(parser.close())
                parser, now, due = RecordParser(), no, 0
            if chunks[i] != due:
                raise ValueError(f"record {no} lacks chunk {due}")
            parser.feed(data[i].as_buffer())
            due += 1
            if base32(parser.digest.digest()) != states[i]:
                raise ValueError(f"record {no} is damaged in chunk {chunks[i]}")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if parser:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(parser.close(), kinds, strict=True)], names=names)


def read_archive(table: DataFrame) -> DataFrame:
    """RECORDS of an archive table, one for each record; only records of more than one chunk are shuffled, to meet their chunks.

    Fails on a damaged one: a chunk that lacks, a digest or a length that differs. A null page_id comes
    back as null, an empty payload as one of no bytes; a payload of any size passes chunk by chunk. An empty table gives no records. Other columns are not read.
    """
    bound_batches(table.sparkSession)
    whole = table.where("chunks = 1")
    long = table.where("chunks > 1").repartition("record_no").sortWithinPartitions("record_no", "chunk_no")
    return whole.mapInArrow(_read, RECORDS).unionByName(long.mapInArrow(_read, RECORDS))


def copy_to(chunks: Iterable, out: BinaryIO) -> int:
    """Writes archive rows that come in the order of record_no and chunk_no, such as toLocalIterator() gives, as a .warc stream."""
    return sum(out.write(bytes(row["data"])) for row in chunks)
