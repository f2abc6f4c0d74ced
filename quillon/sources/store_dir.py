"""A model's store directory as a data source: gate vectors, feature metadata and token embeddings, read by ranges of records.

    spark.dataSource.register(StoreSource)
    spark.read.format("model_store").option("path", folder).option("table", "gates").option("layers", "4-7").load()

Partitions are ranges of fixed-size records of a layer, so a task seeks to its own part and no other is read. The folder
has to be mounted on all executors.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The mark at the head of a metadata file, its version, and the bytes of a number by storage type.
MAGIC, VERSION = 0x444D4554, 1
WIDTHS = {"f32": 4, "f16": 2}
#: Bytes that one partition reads, about.
PART_BYTES = 64 << 20

SCHEMAS = {
    "gates": "layer int, feature long, gate array<double>",
    "embeddings": "token_id long, embedding array<double>",
    "meta": "layer int, feature long, token_id long, token string, c_score double, top_k array<struct<token:string,token_id:bigint,logit:double>>",
}


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` of a layer, whose first lies at ``offset``."""

    layer: int
    offset: int
    first: int
    last: int


def tokens_of(folder: Path) -> dict[int, str]:
    """Tokens by id of a word-level or byte-pair vocabulary file; the space mark and byte-level blanks are taken off."""
    file = folder / "tokenizer.json"
    if not file.exists():
        return {}
    vocabulary = json.loads(file.read_text()).get("model", {}).get("vocab", {})
    pairs = vocabulary.items() if isinstance(vocabulary, dict) else ((t, i) for i, (t, _) in enumerate(vocabulary))
    return {i: t.replace("▁", " ").replace("Ġ", " ").strip() for t, i in pairs}


class StoreReader(DataSourceReader):
    def __init__(self, folder: Path, table: str, layers: tuple[int, int] | None) -> None:
        self.folder, self.table, self.layers = folder, table, layers
        self.config = json.loads((folder / "index.json").read_text())
        dtype = self.config.get("dtype", "f32")
        if dtype not in WIDTHS:
            raise ValueError(f"vectors of type {dtype} are not read")
        self.bytes, self.kind = WIDTHS[dtype], {"f32": "<f4", "f16": "<f2"}[dtype]
        self.top = 0

    def _wanted(self, layer: int) -> bool:
        return self.layers is None or self.layers[0] <= layer <= self.layers[1]

    def _ranges(self, layer: int, offset: int, records: int, size: int) -> list[Range]:
        step = max(1, PART_BYTES // size)
        return [Range(layer, offset, a, min(records, a + step)) for a in range(0, records, step)]

    def partitions(self) -> list[Range]:
        hidden = self.config["hidden_size"]
        if self.table == "embeddings":
            return self._ranges(0, 0, self.config["vocab_size"], hidden * self.bytes)
        if self.table == "gates":
            return [r for x in self.config["layers"] if self._wanted(x["layer"]) for r in self._ranges(x["layer"], x["offset"], x["num_features"], hidden * self.bytes)]
        out = []
        with (self.folder / "down_meta.bin").open("rb") as f:
            magic, version, layers, top = struct.unpack("<4I", f.read(16))
            if magic != MAGIC or version != VERSION:
                raise ValueError("not a metadata file of a known version")
            size, at = 8 + 8 * top, 16
            for layer in range(layers):
                f.seek(at)
                (records,) = struct.unpack("<I", f.read(4))
                if self._wanted(layer):
                    out += self._ranges(layer, at + 4, records, size)
                at += 4 + records * size
        return out

    def _records(self, name: str, part: Range, size: int) -> bytes:
        with (self.folder / name).open("rb") as f:
            f.seek(part.offset + part.first * size)
            return f.read((part.last - part.first) * size)

    def read(self, part: Range) -> Iterator[tuple]:
        hidden = self.config["hidden_size"]
        if self.table != "meta":
            raw = self._records("gate_vectors.bin" if self.table == "gates" else "embeddings.bin", part, hidden * self.bytes)
            vectors = np.frombuffer(raw, self.kind).reshape(-1, hidden).astype(float)
            for i, v in enumerate(vectors.tolist(), part.first):
                yield (part.layer, i, v) if self.table == "gates" else (i, v)
            return
        with (self.folder / "down_meta.bin").open("rb") as f:
            top = struct.unpack("<4I", f.read(16))[3]
        names = tokens_of(self.folder)
        entry = np.dtype([("id", "<u4"), ("score", "<f4")])
        for i, row in enumerate(np.frombuffer(self._records("down_meta.bin", part, 8 + 8 * top), entry).reshape(-1, top + 1), part.first):
            pairs = [(int(x["id"]), float(x["score"])) for x in row]
            top_k = [(names.get(t, f"T{t}"), t, s) for t, s in pairs[1:] if t > 0 or s != 0]
            (token, score) = pairs[0]
            if token == 0 and score == 0 and not top_k:
                yield part.layer, i, None, None, None, None
            else:
                yield part.layer, i, token, names.get(token, f"T{token}"), score, top_k


class StoreSource(DataSource):
    """Options: ``path``, ``table`` (gates, meta or embeddings) and ``layers`` (``first-last``, both included)."""

    @classmethod
    def name(cls) -> str:
        return "model_store"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "gates")]

    def reader(self, schema) -> StoreReader:
        layers = self.options.get("layers")
        first, _, last = (layers or "").partition("-")
        return StoreReader(Path(self.options["path"].removeprefix("file://")), self.options.get("table", "gates"), (int(first), int(last or first)) if layers else None)
