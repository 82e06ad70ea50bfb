"""Degrees, Laplacians and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The most edges at a node whose degree is added up in the order of rows, in one task.
COMPAT_EDGES = 1_000_000


def degrees(edges: DataFrame, vertices: DataFrame, mode: str = "native") -> DataFrame:
    """(i, deg, sqrt_deg); self loops count, isolated nodes have 0.

    ``native``: row sums in double.  ``compat``: column sums in single precision, added in the
    order of rows, then widened; a plain float sum would be widened before it is added.  That
    order gathers a node's edges, so nodes of over ``COMPAT_EDGES``, counted, are refused.
    """
    if mode == "native":
        sums = edges.groupBy("i").agg(F.sum(F.col("w").cast("double")).alias("deg"))
    elif mode == "compat":
        widest = edges.groupBy("j").count().agg(F.max("count")).first()[0] or 0
        if widest > COMPAT_EDGES:
            raise ValueError(f"a node has {widest} edges: use native degrees")
        ordered = F.sort_array(F.collect_list(F.struct("i", F.col("w").cast("float").alias("w"))))
        fold = F.aggregate(ordered, F.lit(0.0).cast("float"), lambda s, e: (s + e["w"]).cast("float"))
        sums = edges.groupBy(F.col("j").alias("k")).agg(fold.cast("double").alias("deg")).select(F.col("k").alias("i"), "deg")
    else:
        raise ValueError(f"no such mode: {mode}")
    deg = F.coalesce("deg", F.lit(0.0))
    return vertices.select("i").join(sums, "i", "left").select("i", deg.alias("deg"), F.sqrt(deg).alias("sqrt_deg"))


def inverse_sqrt(sqrt_deg: Column) -> Column:
    """1 / sqrt, or 0 for an isolated node."""
    return F.when(sqrt_deg > 0, 1 / sqrt_deg).otherwise(0.0)


def with_inverse(degs: DataFrame) -> DataFrame:
    return degs.select("i", inverse_sqrt(F.col("sqrt_deg")).alias("inv"))


def laplacian(edges: DataFrame, degs: DataFrame) -> DataFrame:
    """(i, j, l) of I - D^-1/2 W D^-1/2: self loops dropped, the diagonal 1 for every vertex."""
    inv = with_inverse(degs)
    a = edges.where("i <> j").join(inv, "i")
    b = a.join(inv.select(F.col("i").alias("j"), F.col("inv").alias("inv_j")), "j")
    off = b.select("i", "j", (-F.col("inv") * F.col("w").cast("double") * F.col("inv_j")).alias("l"))
    return off.unionByName(degs.select("i", F.col("i").alias("j"), F.lit(1.0).alias("l")))


def two_i_minus(lap: DataFrame) -> DataFrame:
    """2I - L."""
    return lap.select("i", "j", F.when(F.col("i") == F.col("j"), 2 - F.col("l")).otherwise(-F.col("l")).alias("l"))


def shifted(lap: DataFrame, eps: float) -> DataFrame:
    """L + eps I."""
    return lap.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("l") + eps).otherwise(F.col("l")).alias("l"))


def spmv(lap: DataFrame, x: DataFrame) -> DataFrame:
    """(i, y) with y = L x; x is (i, x)."""
    return lap.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("l") * F.col("x")).alias("y"))


def spmm(lap: DataFrame, x: DataFrame, k: int) -> DataFrame:
    """(i, y array) with Y = L X; x is (i, x array of k).  One join and one combined sum for all columns."""
    joined = lap.join(x.select(F.col("i").alias("j"), "x"), "j")
    sums = joined.groupBy("i").agg(*[F.sum(F.col("l") * F.col("x")[c]).alias(f"y{c}") for c in range(k)])
    return sums.select("i", F.array(*[f"y{c}" for c in range(k)]).alias("y"))
