"""Global row numbers without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.staging import staged

#: Rows in a range of the global sort, about.
RANGE_ROWS = 50_000


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number in the total order ``order``, from 0 on.

    Rows are range-sorted, numbered within their range, and what the ranges before hold (one number a range) is added.
    """
    rows = staged(rows, "number-rows")
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    ranged = staged(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "number-ranges")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    out = ranged.withColumn("__place", place).join(sizes.select("__range", ahead.alias("__ahead")), "__range")
    return out.withColumn(name, F.col("__place") + F.col("__ahead")).drop("__range", "__place", "__ahead")
