"""Preparation of feature tables.

A table is long, (cell, feature, value), unless said otherwise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modulus and multiplier of a hash that any SQL engine can compute on whole numbers.
HASH_MOD, HASH_MUL = 2_147_483_647, 48_271


def portable_hash(key: Column, seed: int) -> Column:
    """A multiplicative hash of whole-number keys in 1 .. HASH_MOD - 1, the same in any engine."""
    first = F.pmod((F.pmod(key, F.lit(HASH_MOD)) + seed + 1) * HASH_MUL, F.lit(HASH_MOD))
    return F.pmod(first * HASH_MUL, F.lit(HASH_MOD))


def portable_hash_of(keys: np.ndarray, seed: int) -> np.ndarray:
    """The same hash of an array of whole numbers."""
    first = (np.asarray(keys, dtype=np.int64) % HASH_MOD + seed + 1) * HASH_MUL % HASH_MOD
    return first * HASH_MUL % HASH_MOD


def normalize_total(values: DataFrame, total: float = 1e3) -> DataFrame:
    """Each cell's values scaled to add up to ``total``; a cell of zeros stays."""
    s = F.sum("value").over(Window.partitionBy("cell"))
    return values.select("cell", "feature", F.when(s != 0, F.col("value") * total / s).otherwise(F.col("value")).alias("value"))


def log1p(values: DataFrame, base2: bool = False) -> DataFrame:
    v = F.log2(1 + F.col("value")) if base2 else F.log1p("value")
    return values.select("cell", "feature", v.alias("value"))


def zscore_clip(values: DataFrame, most: float = 10.0) -> DataFrame:
    """Each feature centred and scaled to unit sample deviation, then clipped above at ``most``.

    Moments come from one aggregation with a row for each feature, joined back, so that a
    feature's cells are never gathered in one task.
    """
    moments = values.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = F.when(F.coalesce("s", F.lit(0.0)) > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0)
    return values.join(moments, "feature").select("cell", "feature", F.least(z, F.lit(most)).alias("value"))


def run_mean_normalize(values: DataFrame) -> DataFrame:
    """(cell, run, feature, value): each run scaled so that its mean is the mean of all."""
    by_run = values.groupBy("run").agg(F.avg("value").alias("run_mean"))
    overall = values.agg(F.avg("value").alias("overall"))
    scaled = F.when(F.col("run_mean") != 0, F.col("value") * F.col("overall") / F.col("run_mean")).otherwise(F.col("value"))
    return values.join(by_run, "run").join(F.broadcast(overall)).select("cell", "run", "feature", scaled.alias("value"))


def highly_variable(values: DataFrame, top: int = 1000, bins: int = 20) -> DataFrame:
    """(feature, dispersion, norm_dispersion): the ``top`` features by dispersion, variance over
    mean, normalised within bins of the mean; ties by name."""
    d = values.groupBy("feature").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    d = d.select("feature", "mean", F.when(F.col("mean") != 0, F.col("var") / F.col("mean")).otherwise(0.0).alias("dispersion"))
    d = d.withColumn("bin", F.ntile(bins).over(Window.orderBy("mean", "feature")))
    stats = d.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("s"))
    norm = F.when(F.coalesce("s", F.lit(0.0)) > 0, (F.col("dispersion") - F.col("m")) / F.col("s")).otherwise(0.0)
    return d.join(F.broadcast(stats), "bin").select("feature", "dispersion", norm.alias("norm_dispersion")).orderBy(F.desc("norm_dispersion"), "feature").limit(top)


def pca(points: DataFrame, components: int = 10) -> DataFrame:
    """(i, x): the leading principal components of (i, x), by the Gram matrix of the features.

    The d x d Gram matrix is added up over partitions and only it comes to the driver; signs make
    the largest loading positive.
    """
    import numpy as np
    import pandas as pd

    spark = points.sparkSession
    d = points.select(F.size("x").alias("d")).first()["d"]

    def gram(batches):
        total, mean, n = np.zeros((d, d)), np.zeros(d), 0
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["x"]])
            total, mean, n = total + x.T @ x, mean + x.sum(0), n + len(x)
        yield pd.DataFrame({"g": [total.ravel().tolist()], "m": [mean.tolist()], "n": [n]})

    parts = points.select("x").mapInPandas(gram, "g array<double>, m array<double>, n long").where("n > 0")
    added = parts.select("n", F.posexplode(F.concat("g", "m"))).groupBy("pos").agg(F.sum("col").alias("v"), F.sum("n").alias("n")).orderBy("pos").collect()
    n = added[0]["n"]
    v = np.array([r["v"] for r in added])
    g, m = v[: d * d].reshape(d, d), v[d * d :] / n
    _, vectors = np.linalg.eigh((g - n * np.outer(m, m)) / max(1, n - 1))
    load = vectors[:, ::-1][:, :components]
    load = load * np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    weights, centre = spark.sparkContext.broadcast(load), spark.sparkContext.broadcast(m)

    def project(batches):
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["x"]]) if len(pdf) else np.zeros((0, d))
            yield pd.DataFrame({"i": pdf["i"], "x": list((x - centre.value) @ weights.value)})

    return points.select("i", "x").mapInPandas(project, "i long, x array<double>")


def random_sample(rows: DataFrame, n: int, *, key: str = "i", seed: int = 42) -> DataFrame:
    """n rows without replacement: the smallest hashes of the key; the same on every run."""
    return rows.orderBy(portable_hash(F.col(key), seed), key).limit(n)


def stratified_sample(cells: DataFrame, n: int, *, grid: int = 50, key: str = "i", seed: int = 42) -> DataFrame:
    """n of (key, x, y), dealt over a grid in proportion to each square's cells, one at least."""
    span = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("all"))
    square = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.lit(grid - 1), F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * grid))).otherwise(0).cast("int")
    h = portable_hash(F.col(key), seed)
    placed = cells.join(F.broadcast(span)).select(*cells.columns, "all", square("x", "x0", "x1").alias("gx"), square("y", "y0", "y1").alias("gy"), h.alias("h"))
    sizes = placed.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("members"))
    ranked = placed.withColumn("k", F.row_number().over(Window.partitionBy("gx", "gy").orderBy("h", key))).join(sizes, ["gx", "gy"])
    share = F.greatest(F.lit(1), F.round(F.col("members") * n / F.col("all")))
    return ranked.where(F.col("k") <= share).orderBy("h", key).limit(n).select(*cells.columns, "gx", "gy")


def sweep_winner(runs: DataFrame, *, least_trust: float = 0.85, least_silhouette: float = 0.2) -> DataFrame:
    """The run with the widest spectral gap among those that pass both floors; ties by name."""
    return runs.where((F.col("trustworthiness") > least_trust) & (F.col("silhouette") > least_silhouette)).orderBy(F.desc("spectral_gap"), "run").limit(1)
