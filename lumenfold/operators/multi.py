"""Placing the components of a disconnected graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.blocks import against, distances, matrix


def spectral_meta_needed(components: int, dims: int) -> bool:
    return components > 2 * dims


def orthogonal_meta(labels: DataFrame, dims: int) -> DataFrame:
    """(label, c, v): component r at plus the r-th unit vector, the next dims at minus."""
    unit = F.when(F.col("c") == F.col("label") % dims, F.when(F.col("label") < dims, 1.0).otherwise(-1.0)).otherwise(0.0)
    return labels.select("label").distinct().select("label", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("c")).select("label", "c", unit.alias("v"))


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, f, v): mean of each feature over a component's points (i, x)."""
    long = points.join(labels, "i").select("label", F.posexplode("x").alias("f", "x"))
    return long.groupBy("label", "f").agg(F.avg(F.col("x").cast("double")).alias("v"))


def _by_label(long: DataFrame, column: str) -> DataFrame:
    """(label, x): a component's numbers in the order of ``column``, which has few values."""
    return long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), "v"))).alias("s")).select("label", F.transform("s", lambda e: e["v"]).alias("x"))


def affinity(cents: DataFrame) -> DataFrame:
    """(a, b, w): exp of minus the squared distance of two centroids, a component with itself too.

    Pairs of components are the result; they are made by blocks.
    """
    rows = _by_label(cents, "f")

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "w": pd.Series(dtype="float64")})
        d = distances(matrix(p["x"]), matrix(q["x"]))
        return pd.DataFrame({"a": np.repeat(p["label"].to_numpy(), len(q)), "b": np.tile(q["label"].to_numpy(), len(p)), "w": np.exp(-d * d).ravel()})

    return against(rows, rows, meet, "a int, b int, w double", key="label")


def meta_laplacian(aff: DataFrame) -> DataFrame:
    """(i, j, l) of the component graph; degrees leave out the diagonal."""
    from lumenfold.operators.laplacian import degrees, laplacian

    edges = aff.where("a <> b").select(F.col("a").alias("i"), F.col("b").alias("j"), "w")
    vertices = aff.select(F.col("a").alias("i")).distinct()
    return laplacian(edges, degrees(edges, vertices))


def data_ranges(meta: DataFrame) -> DataFrame:
    """(label, range): half the distance to the nearest other position that is not the same; 1 if none.

    Meta positions have one row for each component and column.
    """
    rows = _by_label(meta, "c")

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"label": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})
        d = distances(matrix(p["x"]), matrix(q["x"]))
        d[(d == 0) | (p["label"].to_numpy()[:, None] == q["label"].to_numpy()[None, :])] = np.inf
        least = pd.DataFrame({"label": p["label"].to_numpy(), "d": d.min(1)})
        return least[np.isfinite(least["d"])]

    near = against(rows, rows, meet, "label int, d double", key="label").groupBy("label").agg((F.min("d") / 2).alias("range"))
    return meta.select("label").distinct().join(near, "label", "left").select("label", F.coalesce("range", F.lit(1.0)).alias("range"))
