"""Removal of long repeated byte strings by suffix sorting with a difference cover.

Suffixes are dealt out to tasks, sorted there by the difference cover modulo 3 (:mod:`quillon.llm.suffix_array`:
sampled triples, recursion on their names, merge of the rest), and neighbours' prefixes compared byte by byte.

What is dealt out, and where, follows from the content: in each string of ``length`` bytes the leftmost of its
least ``GRAM``-byte names is a sample, so equal strings have equal samples at the same distance. Samples whose
name occurs once cannot lie in a repeated string; around the others all strings are cut out, and the cuts of one
name sorted together. Names are hashes and say only what is compared with what: strings count as repeated where
their bytes are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import skew_join, whole
from quillon.llm.suffix_array import repeated_starts
from quillon.staging import new_path, staged

GRAM = 32
#: Names that occur more often than this are split before they are compared within one partition.
HOT = 500
#: Strings in a block of a name that is split.
BLOCK = 24
#: Sampled suffixes that one partition compares, about.
PER_PARTITION = 20_000
#: Bytes of cuts whose suffixes are sorted at once, about.
SORTED_BYTES = 1_000_000
#: Positions of one text that are sampled at once.
WINDOW = 1 << 22
#: Bytes of text in a bucket, about.
BUCKET_BYTES = 128 << 20

_BASE = 0x9E3779B97F4A7C15
_ONE = np.ones(1, np.uint64)
_POWERS = np.cumprod(np.concatenate((_ONE, np.full(4095, _BASE, np.uint64))))
_INVERSE = np.cumprod(np.concatenate((_ONE, np.full(4095, pow(_BASE, -1, 1 << 64), np.uint64))))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def names(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of the ``size`` bytes at each position of the last axis, equal for equal bytes."""
    n = data.shape[-1]
    if n < size:
        return np.zeros((*data.shape[:-1], 0), np.uint64)
    step = len(_POWERS) - size + 1
    out = []
    for a in range(0, n - size + 1, step):
        part = data[..., a : a + step + size - 1].astype(np.uint64) + np.uint64(1)
        sums = np.zeros((*part.shape[:-1], part.shape[-1] + 1), np.uint64)
        np.cumsum(part * _INVERSE[: part.shape[-1]], axis=-1, out=sums[..., 1:])
        m = part.shape[-1] - size + 1
        out.append(_mixed((sums[..., size:] - sums[..., :m]) * _POWERS[:m]))
    return np.concatenate(out, axis=-1)


def samples(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, their names, and the first and last start of the strings that each is the sample of."""
    grams = names(data, GRAM)
    width = length - GRAM + 1
    n = len(grams) - width + 1
    if n < 1:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty
    # Least value over each window of `width`: of blocks, the rest from the left and the part from the right.
    # The position stands in the low bits, so that of equal names the leftmost is least.
    blocks = -(-len(grams) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(grams)] = grams
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    # The leftmost position of the least name: starts that share it form runs, split where the position is left behind.
    change = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    stops = np.append(change[1:], n)
    at, name, first, last = [], [], [], []
    for a, b in zip(change.tolist(), stops.tolist(), strict=True):
        value = least[a]
        i = a
        hits = None
        while i < b:
            if hits is None:
                hits = np.flatnonzero(grams[a : b + width - 1] == value) + a
            p = int(hits[np.searchsorted(hits, i)])
            j = min(p, b - 1)
            at.append(p)
            name.append(value)
            first.append(i)
            last.append(j)
            i = j + 1
    return np.array(at), np.array(name, np.uint64), np.array(first), np.array(last)


def windowed_samples(data: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`samples` of a text of any size, ``WINDOW`` starts at a time."""
    for a in range(0, max(0, len(data) - length + 1), WINDOW):
        at, name, first, last = samples(data[a : a + WINDOW + length - 1], length)
        yield at + a, name, first + a, last + a


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _samples(held: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    place = (columns[3] << 20) | ((columns[3] - columns[4]) << 10) | (columns[3] - columns[5])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns[:3], place)], ["t1", "t2", "name", "place"])


def _sampled(length: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held: list[tuple] = []
            n = 0
            for i, text in enumerate(batch.column(2)):
                data = _bytes(text.as_py())
                for at, name, first, last in windowed_samples(data, length):
                    held.append((np.full(len(at), t1[i]), np.full(len(at), t2[i]), name.view(np.int64), at, first, last))
                    n += len(at)
                    if n > 200_000:
                        yield _samples(held)
                        held, n = [], 0
            if held:
                yield _samples(held)

    return sample


def _cut(length: int):
    """The bytes around each sampled position of interest: all strings that it is the sample of, overlaid; equal ones of a text in one row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            size = 0
            for t1, t2, text, wanted in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                firsts: dict[tuple[int, bool, bytes], list[int]] = {}
                for w in wanted.as_py():
                    p = w["place"] >> 20
                    first, last = p - (w["place"] >> 10 & 1023), p - (w["place"] & 1023)
                    firsts.setdefault((w["name"], w["hot"], raw[first : last + length]), []).append(first)
                for (name, hot, cut), at in firsts.items():
                    for column, value in zip(rows, (t1.as_py(), t2.as_py(), name, hot, at, cut), strict=True):
                        column.append(value)
                    size += len(cut)
                if size > 8 << 20:
                    yield _cuts(rows)
                    rows, size = [[] for _ in range(6)], 0
            if size:
                yield _cuts(rows)

    return cut


def _cuts(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["t1", "t2", "name", "hot", "firsts", "bytes"])


def _compared(length: int):
    """Sort the suffixes of one partition's cuts, name by name, and keep runs of starts whose strings equal a neighbour's."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), *(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True)
        rows.sort()
        spans: list[tuple[int, int, int, int]] = []
        different: list[tuple[bytes, list[tuple[int, int, int]]]] = []
        size = 0
        for _, of_name in groupby(rows, lambda r: r[0]):
            cuts = [(cut, [r[2:] for r in same]) for cut, same in groupby(of_name, lambda r: r[1])]
            for cut, places in cuts:
                if len(places) > 1:  # equal cuts are repeated as a whole
                    spans += [(t1, t2, first, first + len(cut)) for t1, t2, first in places]
            if len(cuts) > 1:
                different += cuts
                size += sum(len(cut) for cut, _ in cuts)
                if size > SORTED_BYTES:
                    spans += _runs(different, length)
                    different, size = [], 0
        if different:
            spans += _runs(different, length)
        for a in range(0, len(spans), 100_000):
            columns = zip(*spans[a : a + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["t1", "t2", "start", "end"])

    return compare


def _runs(cuts: list[tuple[bytes, list[tuple[int, int, int]]]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans of the repeated strings of ``cuts`` that stand at one place."""
    row, offset = repeated_starts([cut for cut, _ in cuts], length)
    if not len(row):
        return
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)))
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    for r, a, b in zip(row[begin].tolist(), offset[begin].tolist(), offset[end].tolist(), strict=True):
        if len(cuts[r][1]) == 1:
            t1, t2, first = cuts[r][1][0]
            yield t1, t2, first + a, first + b + length


def _parts(rows: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["t1", "t2", "name", "firsts", "bytes", "n"])


def _name(core: bytes, seed: int) -> int:
    key = xxhash.xxh64_intdigest(core, seed)
    return key - ((key >> 63) << 64)


def _blocked(length: int, width: int):
    """Cuts parted into blocks of at most ``width`` strings, by distance to their sample.

    All strings of a block share the bytes that are named here, so equal strings have the same name again.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for t1, t2, name, first, cut, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = int(np.argmax(names(np.frombuffer(cut, np.uint8), GRAM).view(np.int64) == name))
                last = len(cut) - length
                for b in range(at // width + 1):
                    lo, hi = max(0, at - (b + 1) * width + 1), min(last, at - b * width)
                    if lo <= hi:
                        key = _name(cut[at - b * width : at - (b + 1) * width + 1 + length], b)
                        for column, value in zip(rows, (t1, t2, key, [first + lo], cut[lo : hi + length], n), strict=True):
                            column.append(value)
            yield _parts(rows)

    return block


def _strings(length: int):
    """Cuts parted into their strings, each named by all its bytes."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for t1, t2, _, first, cut, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(len(cut) - length + 1):
                    string = cut[i : i + length]
                    for column, value in zip(rows, (t1, t2, _name(string, 0), [first + i], string, n), strict=True):
                        column.append(value)
                if len(rows[0]) > 50_000:
                    yield _parts(rows)
                    rows = [[] for _ in range(6)]
            yield _parts(rows)

    return part


def _collapsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different cuts of ``rows`` (``t1, t2, name, firsts, bytes, n``), and spans of the rows whose cut occurs twice.

    A cut that occurs twice is repeated as a whole. Equal cuts are added up in each task first, then across.
    Rows with ``n`` over 1 stand for cuts whose spans are known, and give none.
    """
    one = F.min(F.struct("t1", "t2", F.col("firsts")[0].alias("first"))).alias("one")
    groups = rows.groupBy("name", "bytes").agg(F.sum("n").alias("n"), one)
    groups = staged(groups.select("one.t1", "one.t2", "name", "one.first", "bytes", "n").withColumn("cut", F.xxhash64("name", "bytes")), "suffix-groups")
    often = groups.where("n > 1").select("cut", F.col("bytes").alias("same"))
    again = skew_join(rows.where(F.col("n") == F.size("firsts")).withColumn("cut", F.xxhash64("name", "bytes")), often, "cut", only=F.col("bytes") == F.col("same"))
    size = F.octet_length("bytes")
    return groups, again.select("t1", "t2", F.transform("firsts", lambda a: F.struct(a.alias("start"), (a + size).alias("end"))).alias("spans"))


def _crowded(groups: DataFrame) -> DataFrame:
    """``groups`` with ``crowded`` where over ``HOT`` different cuts share the name."""
    many = groups.groupBy("name").agg(F.count("*").alias("cuts")).where(F.col("cuts") > HOT).select("name", F.lit(True).alias("crowded"))
    return staged(skew_join(groups, many, "name", "left"), "suffix-crowded")


def _spans(cuts: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings: ``t1, t2, spans``, several rows a text.

    Of names that occur often, equal cuts are collapsed. Names that many different cuts share even so are
    named anew, by more bytes, for blocks of their strings, which are collapsed in turn, and where over ``HOT``
    blocks share even that, by single strings, which are equal or not. What is left is sorted within a partition.
    """
    columns = ["t1", "t2", "name", "first", "bytes"]
    groups, whole_cuts = _collapsed(cuts.where("hot").select("t1", "t2", "name", "firsts", "bytes", F.size("firsts").cast("long").alias("n")))
    groups = _crowded(groups)
    schema = "t1 long, t2 long, name long, firsts array<long>, bytes binary, n long"
    blocks = groups.where("crowded").select(*columns, "n").mapInArrow(_blocked(length, BLOCK), schema)
    parts, whole_blocks = _collapsed(staged(blocks, "suffix-blocks"))
    parts = _crowded(parts)
    strings = parts.where("crowded").select(*columns, "n").mapInArrow(_strings(length), schema)
    _, whole_strings = _collapsed(staged(strings, "suffix-strings"))
    cold = cuts.where("not hot").select("t1", "t2", "name", F.explode("firsts").alias("first"), "bytes")
    cold = cold.unionByName(groups.where("crowded is null").select(columns)).unionByName(parts.where("crowded is null").select(columns))
    n = max(int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cold.count() // PER_PARTITION))
    near = cold.repartition(n, "name").mapInArrow(_compared(length), "t1 long, t2 long, start long, end long")
    single = near.select("t1", "t2", F.array(F.struct("start", "end")).alias("spans"))
    return single.unionByName(whole_cuts).unionByName(whole_blocks).unionByName(whole_strings)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that ``spans`` cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removed(length: int, keep_text: bool):
    columns = {"t1": pa.int64(), "t2": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.string()}
    if keep_text:
        columns["kept"] = pa.binary()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, t2, text, n_rows, spans in zip(*(batch.column(i) for i in range(5)), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                if n_rows.as_py() > 1:  # every string of it starts in its copy too
                    runs = [(0, len(raw))] if len(raw) >= length else []
                else:
                    runs = merged([(s["start"], s["end"]) for s in spans.as_py() or []])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join(kept) + raw[at:]
                rows.append([t1.as_py(), t2.as_py(), len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), ",".join(f"{a}:{b}" for a, b in runs), left][: len(columns)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(columns), columns.values(), strict=True)], list(columns))

    return remove


def _keyed(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    """The text's 128-bit key beside id and text."""
    text = whole(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.lit(seed), text).alias("t1"), F.xxhash64(text, F.lit(seed)).alias("t2"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, str]:
    """Rows with their text's key; the different texts, in a table bucketed by key; and that table's name.

    Later joins move the small side only. Rows of a key agree in the SHA-256 of their text, else another seed is taken.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(whole(text_col)))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    for seed in count():
        keyed = _keyed(docs, id_col, text_col, seed)
        digest = F.unhex(F.sha2("text", 256))
        texts = keyed.groupBy("t1", "t2").agg(
            F.first("text").alias("text"), F.count("*").alias("n_rows"), (F.min(digest) == F.max(digest)).alias("one_text"))
        path = new_path(spark, "texts")
        name = "texts_" + path.rpartition("-")[2]
        texts.write.bucketBy(n, "t1", "t2").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        texts = spark.table(name)
        if texts.where("not one_text").isEmpty():
            return keyed, texts.drop("one_text"), name
        spark.sql(f"DROP TABLE {name}")


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep_text: bool = False) -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts anywhere else.

    Returns per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (maximal removed runs as
    ``start:end``), with ``keep_text`` also ``kept``, the remaining bytes. Texts are taken as UTF-8; strings
    never cross rows, are judged on the input, and may overlap, within one text too. Null texts count as
    empty; texts shorter than ``length`` stay whole. Rows of equal text, repeated ones too, are copies of
    each other. An empty table gives an empty result; extra columns are not read. A text is held whole in one task,
    and sampled ``WINDOW`` positions at a time, at about 40 bytes each.

    Equal texts are worked on once. Of every text suffixes are sampled and named; names that occur once are
    left behind. Around the others all strings are cut out, which is the only text that moves again; the suffixes of
    the cuts of a name are sorted within a partition and neighbours compared by their bytes; names that occur over
    ``HOT`` times are split first (:func:`_spans`).
    """
    if not GRAM < length <= 1000:
        raise ValueError(f"length must be over {GRAM} and at most 1000")
    spark = docs.sparkSession
    keyed, texts, name = _texts(docs, id_col, text_col)
    try:
        sampled = staged(texts.select("t1", "t2", "text").mapInArrow(_sampled(length), "t1 long, t2 long, name long, place long"), "suffix-samples")
        counts = sampled.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", (F.col("n") > HOT).alias("hot"))
        wanted = skew_join(sampled, counts, "name")
        wanted = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("name", "hot", "place")).alias("wanted"))
        cuts = texts.select("t1", "t2", "text").join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "wanted")
        cuts = staged(cuts.mapInArrow(_cut(length), "t1 long, t2 long, name long, hot boolean, firsts array<long>, bytes binary"), "suffix-cuts")
        spans = _spans(cuts, length).groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        schema = "t1 long, t2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
        done = texts.join(spans, ["t1", "t2"], "left").select("t1", "t2", "text", "n_rows", "spans")
        done = staged(done.mapInArrow(_removed(length, keep_text), schema + ", kept binary" * keep_text), "suffix-done")
    finally:
        spark.sql(f"DROP TABLE {name}")  # the entry of the catalogue; the files lie in the shared folder
    return keyed.drop("text").join(done, ["t1", "t2"]).drop("t1", "t2")
