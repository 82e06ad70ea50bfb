"""Numbering rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.lineage import cut

#: Up to so many rows, counted, one window numbers them; beyond, ranges do.
ONE_WINDOW = 1_000_000


def number_rows(df: DataFrame, *order: str, name: str = "number", one_window: int = ONE_WINDOW) -> DataFrame:
    """``df`` with ``name``, 0 for the first row by ``order``, whose values must be distinct.

    Rows are dealt to ranges and sorted there; a row's number is its place in its range after the
    sizes of the ranges before, of which there are as many as partitions.
    """
    if df.limit(one_window + 1).count() <= one_window:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__at") + F.col("__before")).cast("bigint")).drop("__part", "__at", "__before")
