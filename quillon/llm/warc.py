"""WARC archives: written by tasks with an index first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import skew_join, whole
from quillon.staging import new_path, staged

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task begins another archive file beyond this size.
FILE_BYTES = 256 << 20
#: Records of one block of a file are read by one task; adjacent ranges are read together up to this size.
BLOCK_BYTES, RANGE_BYTES, GAP_BYTES = 32 << 20, 8 << 20, 64 << 10

INDEX = "page_id {0}, url string, digest string, record_type string, refers_to {0}, file string, offset long, length long"
RECORDS = "page_id {0}, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to {0}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(uri: str | None) -> int | None:
    tail = uri[len("<urn:page:") : -1] if uri else ""
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone, whose Content-Length is the whole payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or digest32(payload) != digest):
        raise ValueError("a payload does not match its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _number(fields["WARC-Record-ID"]),
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _number(fields.get("WARC-Refers-To")),
    }


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _write(folder: str, date: str, level: int, kind: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"]
        out, at, name = None, 0, ""
        number = pa.int32() if kind == "int" else pa.int64()
        types = [number, pa.string(), pa.string(), pa.string(), number, pa.string(), pa.int64(), pa.int64()]
        try:
            for batch in batches:
                rows: list[list] = [[] for _ in names]
                for page_id, url, payload, keep_id in zip(*(batch.column(i) for i in range(4)), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"  # another attempt of this task writes another file
                        system, path = _opened(folder)
                        out, at = system.open_output_stream(posixpath.join(path, name), compression=None), 0
                    page, body, keep = page_id.as_py(), payload.as_py(), keep_id.as_py()
                    revisit, digest, link = keep is not None and keep != page, digest32(body), url.as_py()
                    member = zlib.compressobj(level, zlib.DEFLATED, 31)
                    packed = member.compress(record(page, link, body, digest, keep if revisit else None, revisit, date)) + member.flush()
                    out.write(packed)
                    row = (page, link, digest, "revisit" if revisit else "response", keep if revisit else None, name, at, len(packed))
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
                    at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date: str = "2000-01-01T00:00:00Z", level: int = 6,
) -> tuple[DataFrame, str]:
    """Write one record per row into ``.warc.gz`` files of a new shared folder; returns the written index and the folder.

    Of rows with equal payloads (null counts as empty), those with the largest id become responses, the
    others revisit records that refer to it. A row of null id revisits like any other; if no row of the
    group has an id, all are responses. Rows repeated with the same id and payload give as many records
    of one kind. Extra columns are not read; an empty table gives an empty index.

    Payloads are compared by SHA-256; a very long one is held whole, by one task. Each task writes files of its own; the index rows of a task are
    committed with it, so files of failed attempts are never referred to.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.encode(whole(html_col), "utf-8").alias("payload")
    ).withColumn("same", F.sha2("payload", 256))
    keep = rows.groupBy("same").agg(F.max("page_id").alias("keep_id"))
    rows = skew_join(rows, keep, "same").select("page_id", "url", "payload", "keep_id")
    folder = new_path(spark, "warc")
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    return staged(rows.mapInArrow(_write(folder, date, level, kind), INDEX.format(kind)), "warc-index"), folder


def _read(folder: str, kind: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        number = pa.int32() if kind == "int" else pa.int64()
        types = [number, pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), number]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            i = 0
            while i < len(wanted):
                file, first, length = wanted[i]
                j, end = i + 1, first + length
                # Ranges that nearly touch become one read.
                while j < len(wanted) and wanted[j][0] == file and 0 <= wanted[j][1] - end <= GAP_BYTES and wanted[j][1] + wanted[j][2] - first <= RANGE_BYTES:
                    end = wanted[j][1] + wanted[j][2]
                    j += 1
                with system.open_input_file(posixpath.join(path, file)) as f:
                    block = f.read_at(end - first, first)
                rows, held = [], 0
                for k in range(i, j):
                    _, o, n = wanted[k]
                    rows.append(parse(zlib.decompress(block[o - first : o - first + n], 31)))
                    held += rows[-1]["payload_bytes"]
                    if held > RANGE_BYTES or k == j - 1:  # however well a range was packed, its payloads go on piece by piece
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)
                        rows, held = [], 0
                i = j

    return read


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` (or a selection of its rows) names, read from the archives and verified.

    Rows are dealt out by blocks of the files and sorted by offset; adjacent byte ranges are read together.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    ranges = index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / BLOCK_BYTES))
    n = max(1, index.sparkSession.sparkContext.defaultParallelism)
    sums = ranges.agg(F.sum("length")).first()[0] or 0
    parts = max(n, -(-sums // BLOCK_BYTES))
    ranges = ranges.repartition(parts, "file", "block").sortWithinPartitions("file", "offset").drop("block")
    return ranges.mapInArrow(_read(folder, kind), RECORDS.format(kind))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows to archives, then read all records back."""
    index, folder = write_archives(pages, id_col, url_col, html_col)
    return read_records(index, folder)
