"""Synthetic points and graphs (A19 to A27), the same on every run and partitioning.

Graphs are edges (i, j, w) in both directions and vertices (i).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Graph = tuple[DataFrame, DataFrame]


def _uniform(seed: int, *salt) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id", *[F.lit(s) for s in salt]), 11).cast("double") + 0.5) / float(1 << 53)


def _normal(seed: int, *salt) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *salt, 1))) * F.cos(2 * math.pi * _uniform(seed, *salt, 2))


def _points(df: DataFrame, columns: list[Column], label: Column) -> DataFrame:
    return df.select(F.col("id").alias("i"), F.array(*[c.cast("double") for c in columns]).alias("x"), label.cast("int").alias("label"))


def blobs(spark: SparkSession, n: int, features: int = 2, centers: int = 3, std: float = 1.0, seed: int = 42) -> DataFrame:
    """Gaussian groups around centres drawn from -10 .. 10."""
    which = F.pmod("id", F.lit(centers))

    def centre(f: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), which, F.lit(f), F.lit("centre")), 11).cast("double") + 0.5) / float(1 << 53)
        return u * 20 - 10

    return _points(spark.range(n), [centre(f) + _normal(seed, f) * std for f in range(features)], which)


def moons(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 42) -> DataFrame:
    upper = F.col("id") < n // 2
    t = F.when(upper, F.col("id") / max(1, n // 2 - 1)).otherwise((F.col("id") - n // 2) / max(1, n - n // 2 - 1)) * math.pi
    x, y = F.when(upper, F.cos(t)).otherwise(1 - F.cos(t)), F.when(upper, F.sin(t)).otherwise(0.5 - F.sin(t))
    return _points(spark.range(n), [x + _normal(seed, 0) * noise, y + _normal(seed, 1) * noise], F.when(upper, 0).otherwise(1))


def circles(spark: SparkSession, n: int, noise: float = 0.05, factor: float = 0.5, seed: int = 42) -> DataFrame:
    outer = F.col("id") < n // 2
    t = F.when(outer, F.col("id") / max(1, n // 2)).otherwise((F.col("id") - n // 2) / max(1, n - n // 2)) * 2 * math.pi
    r = F.when(outer, 1.0).otherwise(factor)
    return _points(spark.range(n), [r * F.cos(t) + _normal(seed, 0) * noise, r * F.sin(t) + _normal(seed, 1) * noise], F.when(outer, 0).otherwise(1))


def near_duplicates(spark: SparkSession, n: int, copies: int = 10, centre: float = 50.0, jitter: float = 3e-7, seed: int = 42) -> DataFrame:
    plain = F.col("id") < n - copies
    at = lambda f: F.when(plain, _normal(seed, f)).otherwise(centre + (_uniform(seed, f, 3) * 2 - 1) * jitter)
    return _points(spark.range(n), [at(0), at(1)], F.when(plain, 0).otherwise(1))


def disconnected(spark: SparkSession, n: int, groups: int = 4, apart: float = 100.0, seed: int = 42) -> DataFrame:
    g = F.floor(F.col("id") * groups / n)
    return _points(spark.range(n), [_normal(seed, 0) + g * apart, _normal(seed, 1)], g)


def swiss_roll(spark: SparkSession, n: int, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """A rolled sheet; labels are fifths of the angle, by its known uniform distribution."""
    u = _uniform(seed, 0)
    t = 1.5 * math.pi * (1 + 2 * u)
    columns = [t * F.cos(t) + _normal(seed, 1) * noise, _uniform(seed, 2) * 21 + _normal(seed, 3) * noise, t * F.sin(t) + _normal(seed, 4) * noise]
    return _points(spark.range(n), columns, F.floor(u * 5))


# The named datasets, generator and options.
DATASETS = {
    "blobs_50": (blobs, {"n": 50, "centers": 3}),
    "blobs_500": (blobs, {"n": 500, "centers": 5}),
    "blobs_5000": (blobs, {"n": 5000, "centers": 10}),
    "moons_200": (moons, {"n": 200}),
    "circles_300": (circles, {"n": 300}),
    "near_dupes_100": (near_duplicates, {"n": 100}),
    "disconnected_200": (disconnected, {"n": 200}),
    "blobs_connected_200": (blobs, {"n": 200, "centers": 3, "std": 3.0}),
    "blobs_connected_2000": (blobs, {"n": 2000, "features": 10, "centers": 5, "std": 5.0}),
}


def dataset(spark: SparkSession, name: str) -> DataFrame:
    if name not in DATASETS:
        raise KeyError(f"no dataset {name}; single-cell tables and downloads are not offered")
    make, options = DATASETS[name]
    return make(spark, **options)


def _graph(spark: SparkSession, n: int, once: DataFrame) -> Graph:
    """Both directions of edges given once."""
    once = once.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("w").cast("float"))
    return once.unionByName(once.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), spark.range(n).withColumnRenamed("id", "i")


def ring(spark: SparkSession, n: int, reach: int = 1, w: float = 1.0) -> Graph:
    once = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("d"))
    return _graph(spark, n, once.select("i", F.pmod(F.col("i") + F.col("d"), F.lit(n)).alias("j"), F.lit(w).alias("w")))


def path(spark: SparkSession, n: int, w: Column | None = None) -> Graph:
    return _graph(spark, n, spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), (w if w is not None else F.lit(1.0)).alias("w")))


def exponential_path(spark: SparkSession, n: int, base: float = 0.5, floor: float = 1e-6) -> Graph:
    return path(spark, n, F.greatest(F.pow(F.lit(base), F.col("id").cast("double")), F.lit(floor)))


def _clique(spark: SparkSession, n: int, offset: int = 0) -> DataFrame:
    once = spark.range(n).select((F.col("id") + offset).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    return once.where(F.col("b") + offset > F.col("i")).select("i", (F.col("b") + offset).alias("j"), F.lit(1.0).alias("w"))


def complete(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _clique(spark, n))


def bridged_cliques(spark: SparkSession, m: int, w: float = 1.0) -> Graph:
    """Two cliques of m and one edge of weight w between them: a barbell, or a weak bridge."""
    bridge = spark.range(1).select(F.lit(m - 1).alias("i"), F.lit(m).alias("j"), F.lit(w).alias("w"))
    return _graph(spark, 2 * m, _clique(spark, m).unionByName(_clique(spark, m, m)).unionByName(bridge))


def torus(spark: SparkSession, a: int, b: int) -> Graph:
    """Rings of a and b nodes multiplied: 4-regular, with a spectrum in closed form."""
    at = spark.range(a * b).select(F.col("id").alias("i"), F.floor(F.col("id") / b).alias("r"), (F.col("id") % b).alias("s"))
    right = at.select("i", (F.col("r") * b + (F.col("s") + 1) % b).alias("j"), F.lit(1.0).alias("w"))
    down = at.select("i", ((F.col("r") + 1) % a * b + F.col("s")).alias("j"), F.lit(1.0).alias("w"))
    return _graph(spark, a * b, right.unionByName(down))


def star(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.lit(0).alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w")))


def bipartite(spark: SparkSession, a: int, b: int) -> Graph:
    once = spark.range(a).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(a), F.lit(a + b - 1))).alias("j"), F.lit(1.0).alias("w"))
    return _graph(spark, a + b, once)


def lollipop(spark: SparkSession, clique: int, tail: int) -> Graph:
    line = spark.range(clique - 1, clique + tail - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"))
    return _graph(spark, clique + tail, _clique(spark, clique).unionByName(line))


def single_edge(spark: SparkSession) -> Graph:
    return path(spark, 2)


def cliques(spark: SparkSession, count: int, size: int) -> Graph:
    """``count`` cliques that are not connected."""
    once = spark.range(count * size).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(max(1, size - 1)))).alias("d")).select("i", (F.col("i") + F.col("d")).alias("j"))
    own = once.where(F.floor(F.col("i") / size) == F.floor(F.col("j") / size)).select("i", "j", F.lit(1.0).alias("w"))
    return _graph(spark, count * size, own)


def two_paths(spark: SparkSession, n: int) -> Graph:
    once = spark.range(2 * n - 1).where(F.col("id") != n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"))
    return _graph(spark, 2 * n, once)


def identity_laplacian(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("l"))


def ring_laplacian(spark: SparkSession, n: int) -> DataFrame:
    """The Laplacian of a ring in closed form: 1 on the diagonal, -1/2 beside it."""
    side = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.pmod(F.col("id") + 1, F.lit(n)), F.pmod(F.col("id") - 1, F.lit(n)))).alias("j"), F.lit(-0.5).alias("l"))
    return side.unionByName(identity_laplacian(spark, n))


def laplacian_with_roots(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """The Laplacian (i, j, l) of a generated graph and its (i, deg, sqrt_deg)."""
    from lumenfold.operators.laplacian import degrees, laplacian

    degs = degrees(*graph)
    return laplacian(graph[0], degs), degs
