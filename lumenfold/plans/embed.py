"""Spectral initial coordinates of a weighted graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.spectral import residuals
from lumenfold.operators import multi
from lumenfold.operators.components import components, local_numbers, subgraphs
from lumenfold.operators.laplacian import degrees, laplacian
from lumenfold.operators.lineage import cut
from lumenfold.operators.selection import add_noise, normalize_signs, scale_coords, select_eigenvectors, wide
from lumenfold.plans.config import ConvergenceFailure, InvalidGraph, SpectralConfig, TooFewNodes
from lumenfold.plans.distributed import smallest_pairs
from lumenfold.plans.solvers import RSVD_GATE, Csr, embed_component, laplacian_of, solve

_PART = "label int, li long, c int, v double, level int"


def validate(edges: DataFrame, vertices: DataFrame, dims: int) -> int:
    """The number of nodes; raises for what no solver can take."""
    n = vertices.count()
    if n == 0:
        raise InvalidGraph("a graph without nodes")
    if dims <= 0:
        raise InvalidGraph("dimensions must be positive")
    if n <= dims:
        raise TooFewNodes(n, dims)
    bad = edges.where(F.col("w").isNull() | F.isnan("w") | (F.col("w") < 0)).limit(1).count()
    if bad:
        raise InvalidGraph("a weight is null, NaN or negative")
    ends = edges.select(F.col("i").alias("k")).unionByName(edges.select(F.col("j").alias("k"))).distinct()
    if ends.join(vertices.select(F.col("i").alias("k")), "k", "left_anti").limit(1).count():
        raise InvalidGraph("an edge ends at a node that is not there")
    return n


def _local(edges: DataFrame, dims: int, seed: int, config: SpectralConfig) -> DataFrame:
    """Signed coordinates of each component of (label, li, lj, w), a component in a task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(max(pdf["li"].max(), pdf["lj"].max())) + 1
        x, solved = embed_component(pdf["li"].to_numpy(), pdf["lj"].to_numpy(), pdf["w"].to_numpy(), n, dims, seed, config)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "li": np.repeat(np.arange(n), dims), "c": np.tile(np.arange(dims), n), "v": x.ravel(), "level": solved.level})

    return edges.groupBy("label").applyInPandas(one, _PART)


def _large(edges: DataFrame, labels: DataFrame, label: int, dims: int, seed: int, config: SpectralConfig) -> DataFrame:
    """Signed coordinates (i, c, v) of one component beyond a task."""
    nodes = labels.where(F.col("label") == label).select("i")
    own = edges.join(nodes, "i", "left_semi")
    # Degrees in double precision: the other mode gathers a hub's edges in one task.
    degs = cut(degrees(own, nodes))
    values, vectors, worst, _ = smallest_pairs(cut(laplacian(own, degs)), degs, dims + 1, seed=seed)
    if not worst < RSVD_GATE:
        raise ConvergenceFailure(f"component {label}: the worst residual is {worst:g}")
    spark = edges.sparkSession
    lam = spark.createDataFrame([(c, float(v)) for c, v in enumerate(values)], "c int, lam double")
    return normalize_signs(select_eigenvectors(lam, vectors.select("i", F.posexplode("x").alias("c", "v")), dims))


def spectral_meta(points: DataFrame, labels: DataFrame, count: int, dims: int, seed: int, most: int = SpectralConfig.most_placed) -> DataFrame:
    """(label, c, v): positions of components from the affinity of their centroids.

    The matrix has a row for a component and is solved on the driver, up to ``most`` of them.
    """
    if count > most:
        raise InvalidGraph(f"{count} components are too many to be placed by their affinity")
    rows = multi.meta_laplacian(multi.affinity(multi.centroids(points, labels))).collect()
    i, j, v = (np.array([r[k] for r in rows]) for k in range(3))
    lap = Csr(i, j, v, count)
    solved = solve(lap, dims, seed, np.ones(count))
    x = solved.vectors[:, np.argsort(solved.values, kind="stable")[1 : dims + 1]]
    top = np.abs(x).max()
    if not top > 0:
        raise InvalidGraph("the component positions are all zero")
    x = x / top
    return labels.sparkSession.createDataFrame([(r, c, float(x[r, c])) for r in range(count) for c in range(dims)], "label int, c int, v double")


def raw_coordinates(edges: DataFrame, vertices: DataFrame, dims: int = 2, seed: int = 42, data: DataFrame | None = None, config: SpectralConfig | None = None) -> DataFrame:
    """(i, c, v, level) before scaling; level is the solver that a component ended at: -1 for nodes of
    a component too small to solve, 9 for the DataFrame solver."""
    config = config or SpectralConfig()
    validate(edges, vertices, dims)
    labels = cut(components(edges, vertices))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    with_edges = edges.join(labels, "i").groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    sizes = cut(sizes.join(with_edges, "label", "left").select("label", "n", F.coalesce("m", F.lit(0)).alias("m")))
    count = sizes.count()
    tiny = F.col("n") < 2 * dims if count > 1 else F.lit(False)
    local = sizes.where(~tiny & (F.col("m") <= config.local_edges)).select("label")
    chosen = labels.join(local, "label", "left_semi")
    numbered = subgraphs(edges.select("i", "j", F.col("w").cast("float").alias("w")), chosen.select("i", "label"))
    ids = local_numbers(chosen)
    parts = cut(_local(numbered, dims, seed, config)).join(ids, ["label", "li"]).select("label", "i", "c", "v", "level")
    for row in sizes.where(~tiny & (F.col("m") > config.local_edges)).select("label").collect():
        own = _large(edges, labels, row["label"], dims, seed, config)
        parts = parts.unionByName(own.select(F.lit(row["label"]).alias("label"), "i", "c", "v", F.lit(9).alias("level")))
    if count == 1:
        return parts.select("i", "c", "v", "level")
    if multi.spectral_meta_needed(count, dims):
        if data is None:
            raise InvalidGraph(f"{count} components need the data to be placed")
        meta = spectral_meta(data, labels, count, dims, seed, config.most_placed)
    else:
        meta = multi.orthogonal_meta(labels, dims)
    meta = cut(meta)
    top = parts.groupBy("label").agg(F.max(F.abs("v")).alias("top"))
    placed = parts.join(top, "label").join(multi.data_ranges(meta), "label").join(meta.select("label", "c", F.col("v").alias("at")), ["label", "c"])
    scaled = placed.select("i", "c", (F.when(F.col("top") > 0, F.col("v") * F.col("range") / F.col("top")).otherwise(0.0) + F.col("at")).alias("v"), "level")
    rest = labels.join(sizes.where(tiny).select("label"), "label", "left_semi").join(meta, "label").select("i", "c", "v", F.lit(-1).alias("level"))
    return scaled.unionByName(rest)


def spectral_coordinates(edges: DataFrame, vertices: DataFrame, dims: int = 2, seed: int = 42, data: DataFrame | None = None, config: SpectralConfig | None = None) -> DataFrame:
    """(i, coords array<float>): initial coordinates, the largest of size ``expansion``, plus noise.

    Components are embedded on their own, in parallel, and placed: at unit vectors if they are few,
    else by the affinity of their data.  The result does not depend on partitioning.
    """
    config = config or SpectralConfig()
    raw = cut(raw_coordinates(edges, vertices, dims, seed, data, config))
    return wide(add_noise(scale_coords(raw.select("i", "c", "v"), config.expansion), config.noise, seed))


def eigenpairs(edges: DataFrame, vertices: DataFrame, dims: int = 2, seed: int = 42, config: SpectralConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Laplacian (i, j, l), values (c, lam, residual, level) and vectors (i, c, v) of a graph: in one
    task up to ``local_edges`` edges, beyond that by the DataFrame solver (level 9)."""
    config = config or SpectralConfig()
    n = validate(edges, vertices, dims)
    if edges.count() > config.local_edges:
        degs = cut(degrees(edges, vertices))
        lap = cut(laplacian(edges, degs))
        lam, x, worst, _ = smallest_pairs(lap, degs, dims + 1, seed=seed)
        if not worst < RSVD_GATE:
            raise ConvergenceFailure(f"the worst residual is {worst:g}")
        vectors = cut(x.select("i", F.posexplode("x").alias("c", "v")))
        values = edges.sparkSession.createDataFrame([(c, float(v)) for c, v in enumerate(lam)], "c int, lam double")
        return lap, values.join(residuals(lap, values, vectors), "c").withColumn("level", F.lit(9)), vectors
    values, vectors = level_pairs(edges, vertices, n, lambda lap, root: solve(lap, dims, seed, root, config), config)
    return laplacian(edges, degrees(edges, vertices, config.compute_mode.value)), values, vectors


def level_pairs(edges: DataFrame, vertices: DataFrame, n: int, run, config: SpectralConfig) -> tuple[DataFrame, DataFrame]:
    """Values (c, lam, residual, level) and vectors (i, c, v) of ``run``, a Solved of a Laplacian and
    the roots of its degrees, in one task."""
    ids = cut(local_numbers(vertices.select("i", F.lit(0).alias("label"))))
    local = subgraphs(edges.select("i", "j", F.col("w").cast("float").alias("w")), ids.select("i", "label"))
    compat = config.compute_mode.value == "compat"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lap, root = laplacian_of(pdf["li"].to_numpy(), pdf["lj"].to_numpy(), pdf["w"].to_numpy(), n, compat=compat)
        got = run(lap, root)
        k = len(got.values)
        r = lap.apply(got.vectors) - got.vectors * got.values
        each = np.sqrt((r * r).sum(0)) / np.maximum(np.sqrt((got.vectors * got.vectors).sum(0)), 1e-300)
        return pd.DataFrame({"li": np.repeat(np.arange(n), k), "c": np.tile(np.arange(k), n), "v": got.vectors.ravel(), "lam": np.tile(got.values, n), "residual": np.tile(each, n), "level": got.level})

    got = cut(local.groupBy("label").applyInPandas(one, "li long, c int, v double, lam double, residual double, level int"))
    return got.where("li = 0").select("c", "lam", "residual", "level"), got.join(ids, "li").select("i", "c", "v")
