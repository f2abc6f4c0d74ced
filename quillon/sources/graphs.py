"""Reading and writing knowledge graphs: compact JSON, unquoted CSV, an append-only log, packed binary."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE = "subject string, relation string, object string, confidence double, source string"
COMPACT = "s string, r string, o string, c double, src string, meta map<string,string>, inj array<double>"


def format_of(path: str) -> str:
    """The format that an extension means; an unknown one is an error."""
    name = path.rstrip("/").lower()
    for ending, kind in ((".json", "json"), (".ndjson", "log"), (".jsonl", "log"), (".csv", "csv"), (".pak", "packed"), (".bin", "message"), (".msgpack", "message"), (".parquet", "parquet")):
        if name.endswith(ending):
            return kind
    raise ValueError(f"no graph format for {path}")


def _edges(e: DataFrame) -> DataFrame:
    return e.where("s is not null and r is not null and o is not null").select(
        F.col("s").alias("subject"), F.col("r").alias("relation"), F.col("o").alias("object"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(1.0)))).alias("confidence"), F.coalesce("src", F.lit("unknown")).alias("source"),
        F.col("meta").alias("metadata"), F.when(F.size("inj") == 2, F.struct(F.col("inj")[0].cast("int").alias("layer"), F.col("inj")[1].alias("score"))).alias("injection"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Edges of graph files, each one document ``{"edges": [...]}`` of compact keys."""
    docs = spark.read.schema(f"edges array<struct<s:string,r:string,o:string,c:double,src:string,meta:map<string,string>,inj:array<double>>>").option("multiLine", True).json(path)
    return _edges(docs.select(F.explode("edges").alias("e")).select("e.*"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a line-wise log; lines that are no edge are passed over."""
    return _edges(spark.read.schema(COMPACT).option("mode", "PERMISSIVE").json(path))


def compact(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("subject").alias("s"), F.col("relation").alias("r"), F.col("object").alias("o"), F.col("confidence").alias("c"), F.col("source").alias("src"))


def append_log(edges: DataFrame, path: str) -> None:
    compact(edges).write.mode("append").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``subject,relation,object[,confidence[,source]]`` without quoting: the fifth field takes all further commas.

    A first line that begins with ``subject`` is a header. Lines of under three fields are passed over; a
    confidence that is no number is 1.
    """
    lines = spark.read.text(path).select(F.col("value"), F.split("value", ",", 5).alias("f"))
    lines = lines.where((F.size("f") >= 3) & ~F.col("value").rlike(r"^subject,relation,object(,|$)"))
    return lines.select(
        *[F.trim(F.col("f")[i]).alias(n) for i, n in enumerate(("subject", "relation", "object"))],
        F.coalesce(F.trim(F.get("f", F.lit(3))).try_cast("double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(F.nullif(F.trim(F.get("f", F.lit(4))), F.lit("")), F.lit("unknown")).alias("source"))


def write_csv(edges: DataFrame, path: str) -> None:
    text: Column = F.concat_ws(",", "subject", "relation", "object", F.col("confidence").cast("string"), "source")
    edges.select(text.alias("value")).write.text(path)


# The first bytes of packed files, and the order of the sources in them.
MAGIC = b"LARQ"
SOURCES = ("unknown", "parametric", "document", "installed", "wikidata", "manual")


def packed(rows: list[tuple[str, str, str, float, str]]) -> bytes:
    """One file of fixed-size records and a table of strings: 32 bytes of header, 28 a record, f32 confidences."""
    strings: dict[str, int] = {}
    records = b"".join(
        struct.pack("<IIIfIII", *(strings.setdefault(x, len(strings)) for x in r[:3]), r[3], SOURCES.index(r[4]) if r[4] in SOURCES else 0, 0, 0) for r in rows)
    table = b"".join(struct.pack("<I", len(b := s.encode())) + b for s in strings)
    return struct.pack("<4sIQQQ", MAGIC, 1, len(rows), len(strings), 32 + len(records)) + records + table


def unpacked(data: bytes) -> list[tuple[str, str, str, float, str]]:
    magic, version, n, n_strings, at = struct.unpack_from("<4sIQQQ", data)
    if magic != MAGIC or version != 1 or at != 32 + 28 * n:
        raise ValueError("not a packed graph")
    strings = []
    for _ in range(n_strings):
        (size,) = struct.unpack_from("<I", data, at)
        strings.append(data[at + 4 : at + 4 + size].decode())
        at += 4 + size
    return [(strings[s], strings[r], strings[o], c, SOURCES[src]) for s, r, o, c, src, _, _ in struct.iter_unpack("<IIIfIII", data[32 : 32 + 28 * n])]


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["subject", "relation", "object", "confidence", "source"]
    for batch in batches:
        for data in batch.column(0):
            rows = unpacked(data.as_py())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 3 else pa.string()) for i, c in enumerate(columns)], names)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Edges of packed files; a file is read by one task."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpack, EDGE)


def _message(value: object) -> bytes:
    """MessagePack of nested dicts, lists, texts, numbers, booleans and None."""
    if value is None or isinstance(value, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        return struct.pack(">b", value) if -32 <= value < 128 else struct.pack(">Bq", 0xD3, value)
    if isinstance(value, float):
        return struct.pack(">Bd", 0xCB, value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else struct.pack(">BI", 0xDB, len(raw))) + raw
    if isinstance(value, dict):
        return (bytes([0x80 | len(value)]) if len(value) < 16 else struct.pack(">BI", 0xDF, len(value))) + b"".join(_message(k) + _message(v) for k, v in value.items())
    return (bytes([0x90 | len(value)]) if len(value) < 16 else struct.pack(">BI", 0xDD, len(value))) + b"".join(map(_message, value))


#: By first byte: how the number that follows is written. Lengths of texts, bytes, lists and maps come first.
_LENGTHS = {0xD9: "B", 0xDA: "H", 0xDB: "I", 0xC4: "B", 0xC5: "H", 0xC6: "I", 0xDC: "H", 0xDD: "I", 0xDE: "H", 0xDF: "I"}
_NUMBERS = {0xCA: "f", 0xCB: "d", 0xCC: "B", 0xCD: "H", 0xCE: "I", 0xCF: "Q", 0xD0: "b", 0xD1: "h", 0xD2: "i", 0xD3: "q"}


def _parsed(data: bytes, at: int = 0) -> tuple[object, int]:
    """The value that begins at ``at``, and where it ends; ValueError for anything that is no such value."""
    if at >= len(data):
        raise ValueError("a message is cut short")
    first, at = data[at], at + 1
    if first < 0x80 or first >= 0xE0:
        return first - 256 * (first >= 0xE0), at
    if first in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[first], at
    if first in _NUMBERS:
        size = struct.calcsize(_NUMBERS[first])
        return struct.unpack_from(f">{_NUMBERS[first]}", data, at)[0], at + size
    if first in _LENGTHS:
        (n,) = struct.unpack_from(f">{_LENGTHS[first]}", data, at)
        at += struct.calcsize(_LENGTHS[first])
        kind = "text" if first >= 0xD9 and first <= 0xDB else "bytes" if first <= 0xC6 else "list" if first <= 0xDD else "map"
    elif first < 0xC0:
        n, kind = (first & 0x1F, "text") if first >= 0xA0 else (first & 0x0F, "list" if first >= 0x90 else "map")
    else:
        raise ValueError(f"a message holds byte {first:#x}, which is no value here")
    if kind in ("text", "bytes"):
        raw = data[at : at + n]
        if len(raw) < n:
            raise ValueError("a message is cut short")
        return raw.decode() if kind == "text" else raw, at + n
    items = []
    for _ in range(n * (1 + (kind == "map"))):
        item, at = _parsed(data, at)
        items.append(item)
    return (dict(zip(items[::2], items[1::2], strict=True)) if kind == "map" else items), at


def messaged(edges: list[dict]) -> bytes:
    """A graph of compact edges as one MessagePack document."""
    return _message({"edges": edges})


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Edges of MessagePack graphs, or of packed ones by their first bytes; a file is read by one task, edges without both ends or a relation are passed over."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "r", "o", "c", "src", "meta", "inj"]
        types = [pa.string()] * 3 + [pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.float64())]
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                if raw.startswith(MAGIC):
                    rows = [[*r, None, None] for r in unpacked(raw)]
                else:
                    rows = [[e.get(n) for n in names] for e in _parsed(raw)[0]["edges"]]
                for row in rows:
                    row[5] = None if row[5] is None else [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in row[5].items()]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return _edges(spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, COMPACT))


def load(spark: SparkSession, path: str) -> DataFrame:
    kind = format_of(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return {"json": read_json, "log": read_log, "csv": read_csv, "packed": read_packed, "message": read_messages}[kind](spark, path)
