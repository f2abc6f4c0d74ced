"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every contract of this package means it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the deal into folds; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def skew_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", only: Column | None = None) -> DataFrame:
    """Join a table with hot keys to an aggregate of one row per key; ``only`` is a further join condition.

    The key is given twice: the aggregate's own partitioning then does not serve the join, both sides are
    dealt out for it, and adaptive execution can split the hot partitions of ``many``.
    """
    left = many.select("*", F.col(key).alias("__l"))
    right = few.select(*[c for c in few.columns if c != key], F.col(key).alias("__k"), F.col(key).alias("__r"))
    on = (F.col(key) == F.col("__k")) & (F.col("__l") == F.col("__r"))
    return left.join(right, on if only is None else on & only, how).drop("__l", "__r", "__k")


def lean(each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives ``each`` batch's results, and holds no batch while the next is read.

    Workers wait for further tasks beside the executor; what a task has freed goes back to the system at its end.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                yield from each(batch)
                del batch
        finally:
            give_back()

    return task


def give_back() -> None:
    """Freed memory that this process still holds goes back to the system, where the C library can do that (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
