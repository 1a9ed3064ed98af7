"""WARC archives, index first.

Writing: every task appends its records to archives of its own, one gzip member a record, and returns an index row for
each: file, offset, length, URL, payload digest.  The index, written as a table, is what commits an archive: a task
that runs again writes other files, and files that no index row names are ignored.  Records with equal payloads are
written once; the others are revisit records that refer to it.  Payloads stay where they are read as long as the
table of contents that occur twice is small enough to broadcast; beyond that they are dealt by content.

Reading: index rows are sorted by file and offset, neighbouring ranges are joined into one read, and every record is
parsed and its payload's digest verified.

Archives lie in the folder given, on any file system that pyarrow opens by URI (local, HDFS, object stores).

Defined cases: a null payload is empty; a null URL is an empty target; rows without id are revisits if a row with an
id has the same payload, else responses; rows that share the least id and the payload are all responses; other
columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import as_bytes, as_texts, batch_of, bounded_batches, if_small, written

FILE_BYTES = 512 * 2**20
GAP_BYTES, READ_BYTES = 64 * 2**10, 8 * 2**20
RECORD_ID = "urn:textmill:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def file_system(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _named(page: int | None) -> str:
    return f"<{RECORD_ID}{'' if page is None else page}>"


def _page(name: str) -> int | None:
    number = name.removeprefix(f"<{RECORD_ID}").removesuffix(">")
    return int(number) if number else None


def record(page: int | None, url: str, payload: bytes, digest: str, refers: bool, refers_to: int | None) -> bytes:
    """One record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    target = "".join(c if c.isprintable() else "%" + c.encode().hex().upper() for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_named(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """Headers, bytes of the full payload and the payload (None in a revisit) of one record; its digest is verified."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
    if headers["WARC-Type"] == "revisit":
        return headers, size, None
    if len(payload) != size or "sha1:" + digest_of(payload) != headers["WARC-Payload-Digest"]:
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    return headers, size, payload


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for every row of pages and returns the index, itself a written table.

    Of rows with equal payloads of at least revisit_bytes bytes, the one with the least id is the response.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                rows = []
                for page, url, payload, first, refers in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    digest = digest_of(payload)
                    member = record(page, url, payload, digest, refers, first)
                    out.write(member)
                    rows.append((page, url, digest, len(payload), "revisit" if refers else "response", first if refers else None, name, at, len(member)))
                    at += len(member)
                if rows:
                    yield batch_of(_INDEX, [list(c) for c in zip(*rows, strict=True)])
        finally:
            if out is not None:
                out.close()

    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    page = bounded_batches(pages).select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    page = page.withColumn("content", F.sha2("payload", 256))
    copies = page.where(F.octet_length("payload") >= revisit_bytes).groupBy("content").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("content", "first")
    rows = page.join(if_small(written(copies, "warc-copies"), 200_000), "content", "left").select("page", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("refers"))
    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """The records that the rows of index name, read back from the archives in folder."""

    def fetch(files, path: str, rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
        start = rows[0][1]
        with files.open_input_file(f"{path}/{rows[0][0]}") as f:
            data = f.read_at(rows[-1][1] + rows[-1][2] - start, start)
        for _, offset, length in rows:
            yield data[offset - start : offset - start + length]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)

        def opened(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            found = []
            for member in fetch(files, path, rows):
                h, size, payload = parse(member)
                refers = h["WARC-Type"] == "revisit"
                found.append((_page(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], _page(h["WARC-Refers-To"]) if refers else None, payload if with_payload else None))
            return batch_of(_RECORD, [list(c) for c in zip(*found, strict=True)])

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (row[0] != held[-1][0] or row[1] - (held[-1][1] + held[-1][2]) > GAP_BYTES or row[1] + row[2] - held[0][1] > READ_BYTES):
                    yield opened(held)
                    held = []
                held.append(row)
        if held:
            yield opened(held)

    ranges = index.select("file", "offset", "length")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)
