"""Nearest neighbours.

Points are (i, x array); neighbours are (i, rank, j, dist), rank from 1, the point itself left
out, ties by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.blocks import BLOCK, against, distances, matrix
from lumenfold.operators.lineage import cut
from lumenfold.operators.prep import portable_hash, portable_hash_of

NEIGHBOURS = "i long, j long, dist double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("i").orderBy("dist", "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", "dist")


def _nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of y for each row of x, by (distance, id)."""
    order = np.argsort(others, kind="stable")
    others, y = others[order], y[order]
    d = distances(x, y)
    d[ids[:, None] == others[None, :]] = np.inf
    k = min(k, d.shape[1])
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    out = pd.DataFrame({"i": np.repeat(ids, k), "j": others[near].ravel(), "dist": dist.ravel()})
    return out[np.isfinite(out["dist"])]


def knn_exact(points: DataFrame, k: int = 15, *, block: int = BLOCK, queries: DataFrame | None = None) -> DataFrame:
    """Exact search: each pair of blocks yields k candidates a point; the best k of them stay.
    With ``queries``, a part of the points, only their neighbours are searched, among all."""

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": pd.Series(dtype="int64"), "j": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        return _nearest(a["i"].to_numpy(), matrix(a["x"]), b["i"].to_numpy(), matrix(b["x"]), k)

    rows = points.select("i", "x")
    return _ranked(against(rows if queries is None else queries.select("i", "x"), rows, meet, NEIGHBOURS, block=block), k)


class Tree:
    """Halving planes between points of a sample: a leaf holds about ``leaf`` of the sample's points."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.sides: list[list[int]] = []
        self.sizes: list[int] = []
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            own, parent, side = todo.pop()
            normal, far = None, None
            if len(own) > leaf:
                a, b = sample[rng.choice(own, 2, replace=False)]
                normal = a - b
                at = sample[own] @ normal
                offset = float(np.median(at))
                far = at > offset
            if far is None or not far.any():
                # A leaf; points that no plane divides are one, however many.
                name = -1 - len(self.sizes)
                self.sizes.append(len(own))
            else:
                name = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.sides.append([0, 0])
                todo += [(own[~far], name, 0), (own[far], name, 1)]
            if parent >= 0:
                self.sides[parent][side] = name
        self.arrays = np.array(self.normals), np.array(self.offsets), np.array(self.sides)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), dtype=np.int64) if self.normals else np.full(len(x), -1)
        normals, offsets, sides = self.arrays
        while len(inner := np.flatnonzero(node >= 0)):
            at = node[inner]
            far = np.einsum("ij,ij->i", x[inner], normals[at]) > offsets[at]
            node[inner] = sides[at, far.astype(np.int64)]
        return -1 - node


def _refined(points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours after every point has brought its own neighbours together."""
    chunks = max(1, -(-points.count() // 1024))
    lists = near.select(F.col("i").alias("m"), F.col("j").alias("i")).unionByName(points.select(F.col("i").alias("m"), "i"))
    met = lists.join(points.select("i", "x"), "i").withColumn("chunk", F.pmod(F.xxhash64("m"), F.lit(chunks)))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["m", "i"])
        ids, x = pdf["i"].to_numpy(), matrix(pdf["x"])
        out = []
        for at in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(pdf["m"].to_numpy())) + 1):
            d = distances(x[at], x[at])
            a, b = np.nonzero(~np.eye(len(at), dtype=bool))
            out.append((ids[at][a], ids[at][b], d[a, b]))
        found = pd.DataFrame({c: np.concatenate([o[n] for o in out]) for n, c in enumerate(("i", "j", "dist"))}).drop_duplicates(["i", "j"])
        order = found.sort_values(["i", "dist", "j"])
        return order[order.groupby("i").cumcount() < k]

    pairs = met.groupBy("chunk").applyInPandas(meet, NEIGHBOURS).unionByName(near.select("i", "j", "dist"))
    return _ranked(pairs.groupBy("i", "j").agg(F.min("dist").alias("dist")), k)


def knn_approx(points: DataFrame, k: int = 15, *, tables: int = 12, bucket: int = 512, rounds: int = 1, sample: int = 65_536, seed: int = 42) -> DataFrame:
    """Approximate search by trees of halving planes, refined by the neighbours of neighbours.

    Each tree is grown on the driver from ``sample`` points at most, chosen by a hash, until a leaf
    stands for about ``bucket`` of all points; every point is dealt to its leaf on the executors, and
    the points of a leaf are compared.  Leaves with many more, such as of equal points, are dealt to
    parts by a hash, so that no group grows with the data.  Then, ``rounds`` times, every point
    compares its neighbours with each other.  Work grows as n * (bucket * tables + k * k * rounds).
    Recall falls slowly as n grows; the README has figures.  Never taken unless asked for.
    """
    rows = points.select("i", "x")
    n = rows.count()
    chosen = [np.asarray(r["x"], dtype=np.float64) for r in rows.orderBy(portable_hash(F.col("i"), seed), "i").limit(sample).select("x").collect()]
    if not chosen:
        return _ranked(rows.select("i", F.col("i").alias("j"), F.lit(0.0).alias("dist")).limit(0), k)
    known = np.stack(chosen)
    share = len(known) / n
    leaf = max(2, int(bucket * share))
    trees = rows.sparkSession.sparkContext.broadcast([Tree(known, leaf, np.random.default_rng([seed, t])) for t in range(tables)])

    def deal(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids = matrix(pdf["x"]), pdf["i"].to_numpy()
            for t, tree in enumerate(trees.value):
                at = tree.leaves(x)
                parts = np.maximum(1, (np.array(tree.sizes)[at] / share / (2 * bucket)).astype(np.int64))
                yield pd.DataFrame({"tbl": t, "leaf": at, "part": portable_hash_of(ids, seed + t) % parts, "i": ids, "x": pdf["x"]})

    dealt = rows.select("i", F.transform("x", lambda v: v.cast("double")).alias("x")).mapInPandas(deal, "tbl int, leaf long, part long, i long, x array<double>")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["i"].to_numpy(), matrix(pdf["x"])
        return _nearest(ids, x, ids, x, k)

    near = dealt.groupBy("tbl", "leaf", "part").applyInPandas(within, NEIGHBOURS)
    found = _ranked(near.groupBy("i", "j").agg(F.min("dist").alias("dist")), k)
    for _ in range(rounds):
        found = _refined(rows, cut(found), k)
    return found


def knn(points: DataFrame, k: int = 15, method: str = "auto", **options) -> DataFrame:
    """``exact``, ``approx``, or ``auto``, which is exact at every size."""
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"no such method: {method}")
    return (knn_approx if method == "approx" else knn_exact)(points, k, **options)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row, ``recall``: the share of true neighbours that were found."""
    hit = true.select("i", "j").join(found.select("i", "j", F.lit(1).alias("hit")), ["i", "j"], "left")
    return hit.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
