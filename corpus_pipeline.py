"""The corpus pipeline: reject low quality, deduplicate exactly and nearly, mix sources, tokenise.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; stages are
written as Parquet in the shared folder and read again, so a lost executor costs one stage at most.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import fresh, remainder, table
from quillon.llm.exact_dedup import exact_dedup
from quillon.llm.mixing import mixed
from quillon.llm.quality import accepted
from quillon.llm.sentencepiece_codec import coded
from quillon.llm.simhash import simhash_dedup
from quillon.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    Null texts count as empty and are scored like any other; every row, repeated or without an id, is decided by its own
    text; a score at the threshold stays; without a positive label all stay. An empty table stays empty.
    """
    held_out = remainder("doc_id", 5) == 0
    return accepted(docs, table(spark, sf_dir, "labels"), held_out)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space.

    The longest stays, of equally long ones the smallest id, then the first row; null texts count as empty and null
    ids lose. Of rows that agree in id and text one stays. An empty table stays empty.
    """
    return exact_dedup(docs).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates.

    Rows are told apart by id and text: others of a removed row's id, or of null id, stay, and rows that share the
    smallest id all stay. Null texts count as empty; groups without any id stay whole. An empty table stays empty.
    """
    return simhash_dedup(docs).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them (the last, at the cut of the budget, whole).

    Rows are numbered, so each comes back as often as it was taken itself, whatever ids it shares; rows without a word,
    null texts among them, are not taken; null sources are one source. An empty table stays empty.
    """
    row = fresh(docs, "row")
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = mixed(docs, row_col=row).where("taken > 0").select(F.col("row").alias("taken_row"), F.array_repeat(F.lit(0), times).alias("times"))
    rows = docs.join(taken, docs[row] == taken.taken_row).select(*[docs[c] for c in docs.columns if c != row], F.explode(taken.times))
    return rows.select(*rows.columns[:-1])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix; null texts have no tokens, repeated rows are coded each, an empty table stays empty."""
    return coded(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", tokens),
]

#: A classifier and a fingerprint by bit majority are not expressible; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
