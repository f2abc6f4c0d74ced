"""SimHash fingerprints and near-duplicate components by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, lean, skew_join, whole
from quillon.operators.components import connected_components
from quillon.staging import staged

#: Three segments: of at most four differing bits, one segment holds one at most.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of more members that do not all hang together are parted by an exact block of the other bits: of five
#: blocks at most four differ, so the links stay the same.
REFINE_ABOVE = 256
#: Fingerprints whose signatures one task lists, about.
PER_TASK = 20_000


def shingle_hashes(text: str, words: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included; of the whole sequence if there are fewer."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not tokens:
        return []
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(tokens), seed)]
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``hashes``, the word whose bits are set in over half of the run, as signed 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view("<i8").ravel()


def _fingerprints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    most = 100_000  # hashes unpacked at once
    out = np.zeros(batch.num_rows, np.int64)
    held: list[tuple[int, list[int]]] = []
    n = 0

    def flush() -> None:
        if held:
            counts = np.array([len(h) for _, h in held])
            flat = np.fromiter((x for _, h in held for x in h), np.uint64, int(counts.sum()))
            out[[i for i, _ in held]] = majority(flat, np.cumsum(counts) - counts, counts)
            held.clear()

    for i, text in enumerate(batch.column(1)):
        if hashes := shingle_hashes(text.as_py()):
            held.append((i, hashes))
            n += len(hashes)
            if n >= most:
                flush()
                n = 0
    flush()
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row; null and wordless texts have 0. ``hashed`` adds ``text_hash``."""
    kind = docs.schema[id_col].dataType.simpleString()
    more = [F.xxhash64(whole(text_col)).alias("text_hash")] if hashed else []
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), *more)
    return rows.mapInArrow(lean(_fingerprints), f"doc_id {kind}, fp long" + (", text_hash long" if hashed else ""))


def signatures(fp: Column) -> Column:
    """Array of each segment, whole (its number and 64 above 22 bits) and in its one-wildcard variants (the wildcard's place there).

    Two fingerprints that differ in at most four bits share a whole segment, or a variant in whose wildcard they differ.
    """
    out = []
    for number, (start, width) in enumerate(SEGMENTS):
        part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.lit((64 + number) << 22).bitwiseOR(part))
        for bit in range(width):
            left = part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)))
            out.append(F.lit((start + bit) << 22).bitwiseOR(left))
    return F.array(*out)


def blocks(key: Column, fp: Column) -> Column:
    """Array of names for the five blocks of the bits outside the segment that ``key`` is a signature of."""
    place, out = F.shiftright(key, 22), None
    for number, (start, width) in reversed(list(enumerate(SEGMENTS))):
        rest = [b for b in range(64) if not start <= b < start + width]
        names = []
        for i in range(5):
            mask = sum(1 << b for b in rest[i::5])
            names.append(F.xxhash64(key, F.lit(i), fp.bitwiseAND(F.lit(mask - ((mask >> 63) << 64)))))
        out = F.array(*names) if out is None else F.when((place < start + width) | (place == 64 + number), F.array(*names)).otherwise(out)
    return out


def turned(key: Column, fp: Column, back: bool = False) -> Column:
    """``fp`` turned until the wildcard of ``key`` is its sign, so that members of either value are the least and the greatest; ``back`` undoes it."""
    place = F.shiftright(key, 22).cast("int")
    up = F.when(place < 64, 63 - place).otherwise(0)
    down = F.when(place < 64, place + 1).otherwise(0)  # turned by 0 and by 64 is the same
    left, right = ("shiftrightunsigned", "shiftleft") if back else ("shiftleft", "shiftrightunsigned")
    return F.call_function(left, fp, up).bitwiseOR(F.call_function(right, fp, down))


def near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _strangers(placed: DataFrame) -> DataFrame:
    """Of ``key, fp, component, members`` the rows of keys with several components, with the largest (``main``) and the rows (``n``) of each."""
    mains = placed.groupBy("key").agg(
        F.max(F.struct("members", "component")).alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")
    )
    mains = mains.where("lo < hi").select("key", F.col("main.component").alias("main"), "n")
    return staged(skew_join(placed, mains.hint("merge"), "key"), "simhash-mixed")


def linked(fps: DataFrame, bits: int = 4) -> DataFrame:
    """``fp, component`` of the distinct fingerprints ``fps`` that link to another one.

    Exact: the links are those between all pairs that differ in at most ``bits`` bits. Buckets of equal
    signatures are never expanded into pairs: first each member is checked against its bucket's least and
    greatest member; then, in the buckets that still hold several components, the members outside the
    largest of them are compared with the rest, inside the join; buckets of over ``REFINE_ABOVE`` members
    are parted by :func:`blocks` before. Buckets of a wildcard count only where members differ in it, as others
    share the whole segment. No join is broadcast: what the driver would have to hold grows with the rows.
    """
    if bits > 4:
        raise ValueError("three segments find links of at most four bits")
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, -(-fps.count() // PER_TASK))
    index = fps.repartition(tasks, "fp").select(F.explode(signatures(F.col("fp"))).alias("key"), "fp")
    at = turned(F.col("key"), F.col("fp"))
    ends = index.groupBy("key").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"))
    ends = ends.where((F.col("n") > 1) & ((F.shiftright("key", 22) >= 64) | ((F.col("lo") < 0) & (F.col("hi") >= 0))))
    ends = ends.select("key", *[turned(F.col("key"), F.col(c), back=True).alias(c) for c in ("lo", "hi")], "n")
    # The checks stand in the join: strangers that meet in a bucket of two are not even emitted.
    to_lo, to_hi = (F.col("fp") != F.col("lo")) & near("fp", "lo", bits), (F.col("fp") != F.col("hi")) & near("fp", "hi", bits)
    shared = staged(skew_join(index, ends.hint("merge"), "key", only=(F.col("n") > 2) | to_lo | to_hi), "simhash-buckets")
    star = shared.where(to_lo).select(F.col("fp").alias("src"), F.col("lo").alias("dst"))
    other = shared.where(to_hi).select(F.col("fp").alias("src"), F.col("hi").alias("dst"))
    first = connected_components(star.unionByName(other))
    first = staged(first, "simhash-first")
    sizes = first.groupBy("component").agg(F.count("*").alias("members"))
    known = skew_join(first, sizes.hint("merge"), "component").select(F.col("node").alias("fp"), "component", "members")
    # Buckets of two are settled; in larger ones members may link to others than the two ends.
    placed = shared.where("n > 2").select("key", "fp").join(known.hint("merge"), "fp", "left").select(
        "key", "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("members", F.lit(1)).alias("members")
    )
    mixed = _strangers(staged(placed, "simhash-placed"))
    crowded = mixed.where(F.col("n") > REFINE_ABOVE).select(F.explode(blocks(F.col("key"), F.col("fp"))).alias("key"), "fp", "component", "members")
    mixed = mixed.where(F.col("n") <= REFINE_ABOVE).unionByName(_strangers(staged(crowded, "simhash-crowded")))
    a = mixed.where("component <> main").select("key", F.col("fp").alias("a"), F.col("component").alias("ca"))
    b = mixed.select("key", F.col("fp").alias("b"), F.col("component").alias("cb"), "main")
    meet = (
        near("a", "b", bits) & (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
    )
    more = a.join(b.hint("merge"), (a.key == b.key) & meet).groupBy("ca", "cb").agg(F.lit(1)).select(F.col("ca").alias("src"), F.col("cb").alias("dst"))
    more = staged(more, "simhash-more")
    if more.isEmpty():
        return first.select(F.col("node").alias("fp"), "component")
    over = staged(connected_components(more).select(F.col("node").alias("component"), F.col("component").alias("above")), "simhash-above")
    alone = more.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(first.hint("merge"), "node", "left_anti")
    every = first.unionByName(alone.select("node", F.col("node").alias("component")))
    return skew_join(every, over.hint("merge"), "component", "left").select(F.col("node").alias("fp"), F.coalesce("above", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Texts are lower-cased in A-Z and cut at ASCII white space; the fingerprint is the bit-wise majority of
    the XXH64 of all shingles of four words. Rows link when their fingerprints differ in at most ``bits``
    bits; ``component_id`` is the smallest id reachable. Very long texts are hashed as a whole, in one task. Null, empty and wordless texts have fingerprint 0
    and link like any other. Null ids never name a component; a component of null ids only has a null one.
    Repeated rows are returned as often as they came. An empty table gives an empty result. Extra columns
    are not read.
    """
    found = placed_rows(fingerprints(docs, id_col, text_col), bits)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def placed_rows(rows: DataFrame, bits: int = 4) -> DataFrame:
    """The ``rows`` of :func:`fingerprints` with the ``component_id`` of each."""
    rows = staged(rows, "simhash-fingerprints")
    fps = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    groups = staged(linked(fps.select("fp"), bits), "simhash-linked")
    named = fps.join(groups.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = staged(skew_join(named, ids.hint("merge"), "component").select("fp", "component_id"), "simhash-ids")
    return skew_join(rows, ids.hint("merge"), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, all columns as they were.

    Of rows that share that id, all stay. Components whose ids are all null stay whole. Rows are told
    apart by id and text, on which alone the decision rests: others of a removed row's id, or of null id, stay.
    """
    found = placed_rows(fingerprints(docs, id_col, text_col, hashed=True))
    gone = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    hash_col = fresh(docs, "text_hash")
    rows = docs.withColumn(hash_col, F.xxhash64(whole(text_col)))
    same = rows[id_col].eqNullSafe(gone["gone_id"]) & (rows[hash_col] == gone["gone_hash"])
    return rows.join(gone.hint("merge"), same, "left_anti").drop(hash_col)
