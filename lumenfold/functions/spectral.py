"""Metrics of eigenpairs and embeddings.

Eigenvectors are (i, c, v), eigenvalues (c, lam), Laplacians (i, j, l).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.report import metric_row

# The acceptance thresholds of the solver levels and tests.
RSVD_GATE = 1e-2
DENSE_GATE = 1e-6
LOBPCG_GATE = 1e-5
SINV_GATE = 1e-6
LOBPCG_TOL = 1e-5
SINV_TOL = 1e-8
DEGENERATE_GAP = 1e-6
SUBSPACE_DET = 0.95
ORTHOGONALITY_GATE = 1e-8


def residuals(lap: DataFrame, values: DataFrame, vectors: DataFrame) -> DataFrame:
    """(c, residual): |Lv - lam v| / max(|v|, 1e-300)."""
    x = vectors.select(F.col("i").alias("j"), "c", "v")
    product = lap.join(x, "j").groupBy("i", "c").agg(F.sum(F.col("l") * F.col("v")).alias("y"))
    both = vectors.join(product, ["i", "c"], "left").join(F.broadcast(values), "c")
    d = F.coalesce("y", F.lit(0.0)) - F.col("lam") * F.col("v")
    return both.groupBy("c").agg((F.sqrt(F.sum(d * d)) / F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(1e-300))).alias("residual"))


def max_residual(lap: DataFrame, values: DataFrame, vectors: DataFrame) -> DataFrame:
    """The worst residual; NaN counts as the worst of all."""
    return residuals(lap, values, vectors).agg(F.max("residual").alias("max_residual"))


def gram(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, g): inner products of the columns of two sets of vectors."""
    right = b.select("i", F.col("c").alias("b"), F.col("v").alias("y"))
    return a.select("i", F.col("c").alias("a"), F.col("v").alias("x")).join(right, "i").groupBy("a", "b").agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("g"))


def orthogonality_error(vectors: DataFrame) -> DataFrame:
    """Frobenius norm of VtV - I."""
    d = F.col("g") - F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    return gram(vectors, vectors).agg(F.sqrt(F.sum(d * d)).alias("orthogonality_error"))


def eigenvalue_bounds(values: DataFrame, tol: float = 1e-12) -> DataFrame:
    """Whether all lie in [-tol, 2 + tol], and whether they ascend within tol."""
    step = values.withColumn("before", F.lag("lam").over(Window.orderBy("c")))
    return step.agg(
        F.bool_and((F.col("lam") >= -tol) & (F.col("lam") <= 2 + tol)).alias("in_bounds"),
        F.bool_and(F.coalesce(F.col("lam") >= F.col("before") - tol, F.lit(True))).alias("is_sorted"),
    )


def separation_ratio(coords: DataFrame, labels: DataFrame) -> DataFrame:
    """Least distance of component centroids over the largest spread around one; infinity for
    fewer than two components or no spread."""
    long = coords.join(labels, "i")
    cents = long.groupBy("label", "c").agg(F.avg(F.col("v").cast("double")).alias("m"))
    off = long.join(cents, ["label", "c"]).groupBy("i").agg(F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("d")).agg(F.max("d").alias("spread"))
    right = cents.select(F.col("label").alias("other"), "c", F.col("m").alias("n"))
    between = cents.join(right, "c").where("label < other").groupBy("label", "other").agg(F.sqrt(F.sum((F.col("m") - F.col("n")) * (F.col("m") - F.col("n")))).alias("d")).agg(F.min("d").alias("gap"))
    ratio = F.when(F.col("gap").isNull() | (F.coalesce("spread", F.lit(0.0)) == 0), F.lit(math.inf)).otherwise(F.col("gap") / F.col("spread"))
    return between.join(off).select(ratio.alias("separation_ratio"))


def eigenvalue_errors(found: DataFrame, true: DataFrame) -> DataFrame:
    """(c, abs_error, rel_error)."""
    d = F.abs(F.col("lam") - F.col("other"))
    return found.join(true.select("c", F.col("lam").alias("other")), "c").select("c", d.alias("abs_error"), F.when(F.col("other") != 0, d / F.abs("other")).alias("rel_error"))


def _normalized_gram(a: DataFrame, b: DataFrame) -> DataFrame:
    norms = lambda x, name: x.groupBy(F.col("c").alias(name)).agg(F.sqrt(F.sum(F.col("v").cast("double") * F.col("v"))).alias(f"n{name}"))
    return gram(a, b).join(norms(a, "a"), "a").join(norms(b, "b"), "b").select("a", "b", (F.col("g") / (F.col("na") * F.col("nb"))).alias("g"))


def subspace_det(a: DataFrame, b: DataFrame) -> DataFrame:
    """|det| of the 2 x 2 matrix of inner products of normalised columns 0 and 1."""
    cell = lambda x, y: F.sum(F.when((F.col("a") == x) & (F.col("b") == y), F.col("g")))
    return _normalized_gram(a, b).agg(F.abs(cell(0, 0) * cell(1, 1) - cell(0, 1) * cell(1, 0)).alias("det"))


def _cosines(a: DataFrame, b: DataFrame) -> np.ndarray:
    """Singular values of the small matrix of inner products of normalised columns."""
    rows = _normalized_gram(a, b).collect()
    n, m = 1 + max(r["a"] for r in rows), 1 + max(r["b"] for r in rows)
    g = np.zeros((n, m))
    for r in rows:
        g[r["a"], r["b"]] = r["g"]
    return np.linalg.svd(g, compute_uv=False)


def subspace_det_kd(a: DataFrame, b: DataFrame) -> float:
    """Product of the cosines of the principal angles, for any number of columns."""
    return float(np.prod(_cosines(a, b)))


def max_principal_angle(a: DataFrame, b: DataFrame) -> float:
    return float(np.arccos(np.clip(_cosines(a, b).min(), -1, 1)))


def sign_agnostic_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest over columns of the smaller of |a - b| and |a + b|, each at its worst row."""
    both = a.join(b.select("i", "c", F.col("v").alias("w")), ["i", "c"])
    each = both.groupBy("c").agg(F.least(F.max(F.abs(F.col("v") - F.col("w"))), F.max(F.abs(F.col("v") + F.col("w")))).alias("e"))
    return each.agg(F.max("e").alias("max_error"))


def tolerance_margin(threshold: float, worst: float) -> float:
    return math.inf if worst == 0 else threshold / worst


def spectrum(values: DataFrame) -> DataFrame:
    """spectral_gap (second eigenvalue to the third, or first to second where there are two) and
    condition_number (last over the second; infinity at 0)."""
    ranked = values.select("lam", F.row_number().over(Window.orderBy("c")).alias("k"))
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("lam")))
    got = ranked.agg(at(1).alias("a"), at(2).alias("b"), F.max_by("lam", "k").alias("z"))
    return got.select((F.col("b") - F.col("a")).alias("spectral_gap"), F.when(F.col("b") == 0, F.lit(math.inf)).otherwise(F.col("z") / F.col("b")).alias("condition_number"))


def rotation_bound(iterations: int, nnz: int, gap: float) -> float:
    """How far rounding may turn an eigenvector: iterations * nonzeros * epsilon / gap."""
    return iterations * nnz * float(np.finfo(float).eps) / gap


def ulp_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many doubles lie between two arrays, element by element."""
    order = lambda x: np.where((u := np.asarray(x, dtype=np.float64).view(np.int64)) < 0, np.int64(-(2**63)) - u, u)
    return np.abs(order(a) - order(b))


def ulp_distances(pairs: DataFrame) -> DataFrame:
    """(i, ulps) of (i, a, b): how many doubles lie between a and b, in Arrow batches."""
    @F.pandas_udf("long")
    def between(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(ulp_distance(a.to_numpy(), b.to_numpy()))

    return pairs.select("i", between("a", "b").alias("ulps"))


def margins(worst: DataFrame, threshold: float) -> DataFrame:
    """(c, margin) of (c, residual): threshold over residual; infinity at 0."""
    return worst.select("c", F.when(F.col("residual") == 0, F.lit(math.inf)).otherwise(threshold / F.col("residual")).alias("margin"))


def rotation_bounds(solves: DataFrame) -> DataFrame:
    """(name, bound) of (name, iterations, nnz, gap), as rotation_bound."""
    return solves.select("name", (F.col("iterations") * F.col("nnz") * float(np.finfo(float).eps) / F.col("gap")).alias("bound"))


def product_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """max_abs and rms of the difference of two vectors (i, y)."""
    d = F.col("y") - F.col("z")
    return a.join(b.select("i", F.col("y").alias("z")), "i").agg(F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rms"))


def compare_eigenvectors(values: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(columns, kind, error): compare by clusters of eigenvalues nearer than DEGENERATE_GAP, single
    vectors up to sign, clusters by the largest principal angle."""
    cut = F.when(F.col("lam") - F.lag("lam").over(Window.orderBy("c")) >= DEGENERATE_GAP, 1).otherwise(0)
    clusters = values.withColumn("new", cut).withColumn("cluster", F.sum("new").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))
    out = []
    for row in clusters.groupBy("cluster").agg(F.sort_array(F.collect_list("c")).alias("cs")).orderBy("cluster").collect():
        own = [x.where(F.col("c").isin(row["cs"])).select("i", (F.col("c") - row["cs"][0]).alias("c"), "v") for x in (a, b)]
        single = len(row["cs"]) == 1
        out.append((row["cs"], "vector" if single else "subspace", float(sign_agnostic_error(*own).first()[0] if single else max_principal_angle(*own))))
    return values.sparkSession.createDataFrame(out, "columns array<int>, kind string, error double")


def assess(dataset: str, n: int, lap: DataFrame, values: DataFrame, vectors: DataFrame, *, components: int, expected_components: int, gate: float = RSVD_GATE) -> DataFrame:
    """The gated report (dataset, n, name, dimension, value, threshold, passed) of a solve;
    threshold 0 marks a figure that is only told."""
    spark = lap.sparkSession
    worst = max_residual(lap, values, vectors).first()[0]
    ortho = orthogonality_error(vectors).first()[0]
    bounds, spec = eigenvalue_bounds(values).first(), spectrum(values).first()
    rows = [
        metric_row(dataset, n, "component_count_match", float(components), float(expected_components), components == expected_components),
        metric_row(dataset, n, "max_eigenpair_residual", worst, gate, worst <= gate),
        metric_row(dataset, n, "orthogonality_error", ortho, ORTHOGONALITY_GATE, ortho <= ORTHOGONALITY_GATE),
        metric_row(dataset, n, "eigenvalues_in_bounds", float(bounds["in_bounds"]), 1.0, bounds["in_bounds"]),
        metric_row(dataset, n, "eigenvalues_sorted", float(bounds["is_sorted"]), 1.0, bounds["is_sorted"]),
        metric_row(dataset, n, "spectral_gap", spec["spectral_gap"], 0.0, True),
        metric_row(dataset, n, "condition_number", spec["condition_number"], 0.0, True),
        metric_row(dataset, n, "residual_margin", tolerance_margin(gate, worst), 0.0, True),
    ]
    return spark.createDataFrame(rows)
