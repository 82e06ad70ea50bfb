"""Fuzzy neighbour graphs.

Edges are (i, j, w).  Constants follow the published UMAP algorithm: the bandwidth search takes
64 steps; a bandwidth is at least a thousandth of the mean distance of its point, or of all
points where the nearest neighbour is at distance 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 64
FLOOR = 1e-3


def _weight_sum(gaps: Column, sigma: Column) -> Column:
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + F.when(g > 0, F.exp(-g / sigma)).otherwise(1.0))


def smooth_knn(neighbours: DataFrame, k: int) -> DataFrame:
    """(i, rho, sigma): distance to the nearest neighbour, and the bandwidth at which the
    weights of a point's neighbours add up to log2(k)."""
    by_point = neighbours.groupBy("i").agg(F.min("dist").alias("rho"), F.array_sort(F.collect_list("dist")).alias("d"))
    gaps = F.transform("d", lambda x: x - F.col("rho"))
    target = F.log2(F.lit(float(k)))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(1.0).alias("mid"))

    def step(s: Column, _: Column) -> Column:
        high = _weight_sum(F.col("gaps"), s["mid"]) > target
        lo, hi = F.when(high, s["lo"]).otherwise(s["mid"]), F.when(high, s["mid"]).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi == float("inf"), s["mid"] * 2).otherwise((lo + hi) / 2).alias("mid"))

    searched = by_point.withColumn("gaps", gaps).withColumn("found", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["mid"])
    mean = F.aggregate("d", F.lit(0.0), lambda s, v: s + v) / F.size("d")
    overall = neighbours.agg(F.avg("dist").alias("overall"))
    floor = FLOOR * F.when(F.col("rho") > 0, mean).otherwise(F.col("overall"))
    return searched.join(F.broadcast(overall)).select("i", "rho", F.greatest("found", floor).alias("sigma"))


def membership(neighbours: DataFrame, bandwidths: DataFrame) -> DataFrame:
    """Directed (i, j, w): 1 up to rho, then exp(-(d - rho) / sigma); no self edges, no zeros."""
    w = F.when(F.col("dist") <= F.col("rho"), 1.0).otherwise(F.exp(-(F.col("dist") - F.col("rho")) / F.col("sigma")))
    return neighbours.where("i <> j").join(bandwidths, "i").select("i", "j", w.alias("w")).where("w > 0")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")


def coalesce_duplicates(edges: DataFrame) -> DataFrame:
    """Weights of equal (i, j) added up."""
    return edges.groupBy("i", "j").agg(F.sum("w").alias("w"))


def fuzzy_union(edges: DataFrame) -> DataFrame:
    """A + At - A * At, element by element, without zeros.

    Each edge is dealt out once in both directions and the two weights meet in one aggregation,
    so that one shuffle does for the full outer join.
    """
    once = coalesce_duplicates(edges)
    both = once.select("i", "j", F.col("w").alias("a"), F.lit(0.0).alias("b")).unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("a"), F.col("w").alias("b")))
    return both.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b")).select("i", "j", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("w")).where("w > 0")


def n_epochs(n: int) -> int:
    return 500 if n <= 10_000 else 200


def prune(edges: DataFrame, n: int, epochs: int | None = None) -> DataFrame:
    """Edges of at least max(w) / epochs; epochs follow the number of points."""
    most = edges.agg(F.max("w").alias("most"))
    return edges.join(F.broadcast(most)).where(F.col("w") >= F.col("most") / (epochs or n_epochs(n))).select("i", "j", "w")


def adjacency(edges: DataFrame) -> DataFrame:
    """(i, nbrs array of (j, w)): a row for each node that has edges, neighbours ascending."""
    return edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("nbrs"))


def asymmetry(edges: DataFrame) -> DataFrame:
    """One row: max_diff between A and At, and whether it is under 1e-10."""
    both = edges.select("i", "j", "w").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("w")).alias("w")))
    diff = both.groupBy("i", "j").agg(F.abs(F.sum("w")).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("max_diff"))
    return diff.select("max_diff", (F.col("max_diff") < 1e-10).alias("symmetric"))


def fuzzy_graph(points: DataFrame, k: int = 15, method: str = "auto", neighbours: DataFrame | None = None) -> DataFrame:
    """Points to pruned symmetric edges (i, j, w float): the whole construction."""
    from lumenfold.operators.knn import knn
    from lumenfold.operators.lineage import cut

    near = cut(neighbours if neighbours is not None else knn(points, k, method))
    graph = fuzzy_union(membership(near, smooth_knn(near, k)))
    return prune(graph, points.count()).select("i", "j", F.col("w").cast("float").alias("w"))
