"""Selecting, signing and scaling coordinates.

Eigenvectors are long, (i, c, v); eigenvalues are (c, lam).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_eigenvectors(values: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(i, c, v) of the dims vectors after the smallest eigenvalue, in order; ties by column."""
    if values.count() < dims + 1:
        raise ValueError(f"{dims + 1} eigenvalues are needed")
    order = values.select(F.col("c").alias("old"), (F.row_number().over(Window.orderBy("lam", "c")) - 2).alias("rank"))
    chosen = order.where((F.col("rank") >= 0) & (F.col("rank") < dims))
    return vectors.join(F.broadcast(chosen), vectors["c"] == F.col("old")).select("i", F.col("rank").cast("int").alias("c"), "v")


def normalize_signs(coords: DataFrame) -> DataFrame:
    """Each column negated if its largest element in size, the first of equal ones, is negative."""
    lead = coords.groupBy("c").agg(F.max_by("v", F.struct(F.abs("v"), -F.col("i"))).alias("lead"))
    return coords.join(F.broadcast(lead), "c").select("i", "c", F.when(F.col("lead") < 0, -F.col("v")).otherwise(F.col("v")).alias("v"))


def scale_coords(coords: DataFrame, most: float = 10.0) -> DataFrame:
    """All columns by one factor, so that the largest size is ``most``; in single precision."""
    top = coords.agg(F.max(F.abs("v")).alias("top"))
    scaled = F.when(F.col("top") > 0, F.col("v") * (F.lit(most) / F.col("top"))).otherwise(F.raise_error("all coordinates are zero").cast("double"))
    return coords.join(F.broadcast(top)).select("i", "c", scaled.cast("float").alias("v"))


def add_noise(coords: DataFrame, scale: float = 1e-4, seed: int = 42) -> DataFrame:
    """Gaussian noise by Box and Muller from a hash of seed, node and column: partitions do not matter."""
    if not (math.isfinite(scale) and scale > 0 and scale >= 1.2e-38):
        raise ValueError("the noise scale must be finite, positive and a normal single-precision number")
    u = lambda n: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "i", "c", F.lit(n)), 11).cast("double") + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))
    return coords.select("i", "c", (F.col("v") + (normal * scale).cast("float")).cast("float").alias("v"))


def min_max(coords: DataFrame, most: float = 10.0) -> DataFrame:
    """Each column shifted and scaled to 0 .. ``most``; a constant column becomes 0."""
    span = coords.groupBy("c").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    v = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) * most / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return coords.join(F.broadcast(span), "c").select("i", "c", v.alias("v"))


def wide(coords: DataFrame, kind: str = "float") -> DataFrame:
    """(i, coords array) from (i, c, v)."""
    return coords.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("p")).select("i", F.transform("p", lambda e: e["v"].cast(kind)).alias("coords"))


def long(coords: DataFrame, column: str = "coords") -> DataFrame:
    return coords.select("i", F.posexplode(column).alias("c", "v"))
