"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import WORD, skew_join, whole
from quillon.staging import staged

#: Rows of a source that one sort of its shuffled order holds, about.
SLICE_ROWS = 4000
#: Rows in a range of the global sort by finish time, about.
RANGE_ROWS = 50_000
#: Sums of so many slices or ranges are added up by one task.
SUMS = 1000
#: Up to so many sources go along with the tasks.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``source, nth, source_size, n_docs, target`` from rows of ``source, size``.

    The sources, by code point with null last, weigh ``weights`` in turn. The total of all sizes is dealt
    out by weight; no target exceeds ``cap`` times its source's size, and what is over is dealt out again
    among the others until none is above. Sources without any word get the target 0.

    Works on one row per source: the tables that pass through single-partition windows here hold
    aggregates per source, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("nth", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights) + 1))
    # A source is held at its cap before any other that has more room for its weight: in order of
    # room, the first source whose share does not exceed its cap ends the capped ones.
    room = Window.orderBy((F.col("source_size") * cap / F.col("weight")), F.col("source").asc_nulls_last())
    before = room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("rate", left / others)
    capped = F.col("source_size") * cap <= F.col("rate") * F.col("weight")
    per = per.withColumn("capped", capped)
    rate = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") * cap / F.col("weight"), F.col("source").isNull(), "source", "rate"))).over(everything)
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(rate["rate"] * F.col("weight"))
    return per.select("source", "nth", "source_size", "n_docs", target.alias("target"))


def words_ahead(sums: DataFrame, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, order, ahead``: the ``words`` of all rows before, in order within ``by``.

    Added up by blocks of ``SUMS`` rows and within them, so that one task holds a share of the sums only.
    """
    sums = sums.withColumn("block", F.floor(F.col(order) / SUMS))
    until = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy(*by, "block").agg(F.sum("words").alias("words"))
    blocks = blocks.select(*by, "block", F.coalesce(F.sum("words").over(until("block", *by)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("words").over(until(order, *by, "block")), F.lit(0))
    return sums.withColumn("within", within).join(blocks, [*by, "block"]).select(*by, order, (F.col("before") + F.col("within")).alias("ahead"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    row_col: str | None = None,
) -> DataFrame:
    """Words that a mix of all sources takes of each row: ``doc_id, size, source_size, target, taken``.

    Weighted fair queueing: the rows of a source are queued in shuffled order, up to ``cap`` times in
    a row; each gets a virtual finish time, the cumulative words of its source divided by the source's
    target. All sources' queues are range-sorted by finish time and cut where the words of the total budget
    (all words there are) are used up; the row at the cut is taken in part.

    A row of no words is taken with 0 words. Null texts count as empty, null sources are one source,
    repeated rows are queued apart, ties are broken by the shuffle digest and the row. Rows that share an id,
    or have none, are shuffled by their row number too. An empty table gives an empty result. Extra columns
    are not read; of a text, however long, only its number of words goes on. ``row_col`` names a column
    that numbers the rows; it is then returned as ``row``, since neither ids nor texts tell repeated rows apart.

    A hot source is never gathered: its shuffled order is cut into slices of about ``SLICE_ROWS`` rows by
    the digest; of slices and of ranges of finish times only the sums are added up in order.
    """
    sized = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(text_col).alias("size"),
    )
    sized = staged(sized, "mix-sizes")
    sources = staged(source_targets(sized, weights, cap), "mix-sources")
    n_sources, budget, n_docs = sources.agg(F.count("*"), F.sum("source_size"), F.sum("n_docs")).first()
    if n_sources <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    else:
        sources = sources.repartition("source")
    rows = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop("source")
    # The shuffle: a digest in [0, 1) for each pass over the source.
    passes = F.least(F.lit(cap), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") + 1)
    queue = _told_apart(rows.where("size > 0")).withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    digest = F.md5(F.concat_ws(":", F.lit(seed), "pass", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "again"))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    queue = queue.withColumn("digest", digest).withColumn("slice", F.floor(place * F.ceil(F.col("n_docs") / SLICE_ROWS)))
    queue = staged(queue.drop("again"), "mix-queue")
    key = ["nth", "pass", "slice"]
    ahead = words_ahead(staged(queue.groupBy(key).agg(F.sum("size").alias("words")), "mix-slices"), "slice", ("nth", "pass"))
    within = Window.partitionBy(key).orderBy("digest", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    timed = queue.withColumn("so_far", F.sum("size").over(within)).join(ahead, key)
    done = F.col("pass") * F.col("source_size") + F.col("ahead") + F.col("so_far")
    timed = staged(timed.select("row", "size", "digest", (done / F.col("target")).alias("finish")), "mix-times")
    # The global sort by finish time: ranges, numbered in order, and sorted within.
    ranges = max(1, -(-timed.count() // RANGE_ROWS))
    ranged = timed.repartitionByRange(ranges, "finish", "digest", "row").withColumn("range", F.spark_partition_id())
    ranged = staged(ranged, "mix-ranges")
    ahead = words_ahead(staged(ranged.groupBy("range").agg(F.sum("size").alias("words")), "mix-range-sums"), "range")
    within = Window.partitionBy("range").orderBy("finish", "digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("ahead")
    taken = ranged.join(ahead, "range").withColumn("before", before)
    taken = taken.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.least("size", F.lit(budget or 0) - F.col("before")))).alias("taken"))
    return rows.join(taken, "row", "left").select(
        *(["row"] if row_col else []), "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: the row number as text where several rows share the id, else null."""
    many = staged(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("many")), "mix-repeated")
    if many.isEmpty():
        return rows.withColumn("again", F.lit(None).cast("string"))
    nulls = not many.where("doc_id is null").isEmpty()
    rows = skew_join(rows, many.where("doc_id is not null"), "doc_id", "left")
    again = F.col("many") | (F.col("doc_id").isNull() & F.lit(nulls))
    return rows.withColumn("again", F.when(again, F.col("row").cast("string"))).drop("many")
