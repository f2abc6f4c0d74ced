"""Streams: an edge log that is replayed as it grows, windows over events and over positions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.graphs import COMPACT, _edges


def edge_stream(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a growing log, each triple once. Its state holds every triple; :func:`replay_into` keeps them in a table instead."""
    return _edges(spark.readStream.schema(COMPACT).json(path)).dropDuplicates(["subject", "relation", "object"])


def replay_into(spark: SparkSession, log: str, table: str, checkpoint: str) -> None:
    """Take over what is new in a growing log into a table of edges, each triple once, and return.

    Known triples are found by a join with the table, so a stream's state does not grow with the graph; a batch that
    is run again after a failure writes its own folder anew.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["subject", "relation", "object"])
        try:
            known = spark.read.parquet(table).where(F.col("batch") != number).select("subject", "relation", "object")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            new = new.join(known, ["subject", "relation", "object"], "left_anti")
        new.write.mode("overwrite").parquet(f"{table.rstrip('/')}/batch={number}")

    stream = _edges(spark.readStream.schema(COMPACT).json(log))
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by type and tumbling window; with ``late`` as the watermark of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def token_windows(tokens: DataFrame, size: int) -> DataFrame:
    """One row for each window of ``size`` positions of a sequence (``id, pos, value``): its bounds and last value."""
    return tokens.groupBy("id", F.floor(F.col("pos") / size).alias("window")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max_by("value", "pos").alias("boundary"))


def last_positions(tokens: DataFrame, size: int) -> DataFrame:
    """The last ``size`` positions of each sequence: what a sliding window keeps."""
    order = Window.partitionBy("id").orderBy(F.desc("pos"))
    return tokens.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= size).drop("__n")
