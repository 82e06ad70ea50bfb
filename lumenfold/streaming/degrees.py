"""Degrees of a growing graph, as a stream: an addition of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame) -> DataFrame:
    """(i, deg) over all edges (i, j, w) that have come; write with output mode update or complete."""
    return edges.groupBy("i").agg(F.sum(F.col("w").cast("double")).alias("deg"))


def windowed_degrees(edges: DataFrame, *, time: str = "ts", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, i, deg) by event time; edges later than ``late`` are not counted."""
    return edges.withWatermark(time, late).groupBy(F.window(time, width), "i").agg(F.sum(F.col("w").cast("double")).alias("deg"))
