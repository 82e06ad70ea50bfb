"""Quality of an embedding against its points.

Points and embeddings are (i, x array); labels are (i, label); neighbours (i, rank, j, dist).
Work over all pairs goes by blocks: each pair of blocks gives sums, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.blocks import BLOCK, against, distances, matrix
from lumenfold.operators.lineage import cut
from lumenfold.operators.prep import portable_hash, random_sample

# Verdict thresholds of a comparison with a baseline embedding.
PROCRUSTES_MOST, CORRELATION_LEAST, TRUST_DRIFT, SILHOUETTE_DRIFT = 0.05, 0.99, 0.01, 0.05


def neighbour_ranks(points: DataFrame, pairs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(i, j, r): the place of j among all others by distance from i (ties by id), for given pairs.

    A pair is first given its distance.  A block of points with the distances of their pairs then
    meets every block of points and counts who is nearer.
    """
    x = points.select("i", "x")
    wanted = pairs.select("i", "j").join(x, "i").join(x.select(F.col("i").alias("j"), F.col("x").alias("xj")), "j")

    def measure(batches):
        for pdf in batches:
            a, b = matrix(pdf["x"]), matrix(pdf["xj"])
            if not len(pdf):
                continue
            off = (a - b)[:, None, :]
            d = np.sqrt(np.einsum("ijk,ijk->ij", off, off))[:, 0]
            yield pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "d": d})

    measured = wanted.select("i", "j", "x", "xj").mapInPandas(measure, "i long, j long, d double")
    told = measured.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("to"))
    held = x.join(told.select("i", F.transform("to", lambda t: t["j"]).alias("js"), F.transform("to", lambda t: t["d"]).alias("ds")), "i")

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("i", "j", "n")})
        ids, d = b["i"].to_numpy(), distances(matrix(a["x"]), matrix(b["x"]))
        row = np.repeat(np.arange(len(a)), [len(v) for v in a["js"]])
        i, j, dj = a["i"].to_numpy()[row], np.concatenate(a["js"].tolist()), np.concatenate(a["ds"].tolist())
        n = np.empty(len(row), dtype=np.int64)
        step = max(1, (1 << 22) // len(ids))
        for at in range(0, len(row), step):
            own = slice(at, at + step)
            there, to, me = d[row[own]], dj[own, None], j[own, None]
            nearer = (there < to) | ((there == to) & (ids < me))
            n[own] = (nearer & (ids != i[own, None]) & (ids != me)).sum(1)
        return pd.DataFrame({"i": i, "j": j, "n": n})

    parts = against(held, points.select("i", "x"), count, "i long, j long, n long", block=block)
    return parts.groupBy("i", "j").agg((F.sum("n") + 1).alias("r"))


def _preservation(ranks: DataFrame, n: int, k: int, name: str) -> DataFrame:
    penalty = F.coalesce(F.sum(F.when(F.col("r") > k, F.col("r") - k)), F.lit(0))
    return ranks.agg((1 - F.lit(2.0) / (n * k * (2 * n - 3 * k - 1)) * penalty).alias(name))


def trustworthiness(points: DataFrame, near_in_embedding: DataFrame, k: int = 15) -> DataFrame:
    """How far the neighbours in the embedding are neighbours among the points."""
    near = near_in_embedding.where(F.col("rank") <= k)
    return _preservation(neighbour_ranks(points, near), points.count(), k, "trustworthiness")


def continuity(embedding: DataFrame, near_in_points: DataFrame, k: int = 15) -> DataFrame:
    """How far the neighbours among the points are neighbours in the embedding."""
    near = near_in_points.where(F.col("rank") <= k)
    return _preservation(neighbour_ranks(embedding, near), embedding.count(), k, "continuity")


def silhouette(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean of (b - a) / max(a, b) with Euclidean distances; 0 for a label of one point; NaN for
    fewer than two labels."""
    rows = points.select("i", "x").join(labels.select("i", "label"), "i")

    def sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "s": pd.Series(dtype="float64"), "n": pd.Series(dtype="int64")})
        d = distances(matrix(a["x"]), matrix(b["x"]))
        d[a["i"].to_numpy()[:, None] == b["i"].to_numpy()[None, :]] = 0
        names, inverse = np.unique(b["label"].to_numpy(), return_inverse=True)
        s = np.stack([d[:, inverse == g].sum(1) for g in range(len(names))], axis=1)
        n = np.bincount(inverse, minlength=len(names))
        return pd.DataFrame({"i": np.repeat(a["i"].to_numpy(), len(names)), "other": np.tile(names, len(a)), "s": s.ravel(), "n": np.tile(n, len(a))})

    by_label = against(rows, rows, sums, "i long, other long, s double, n long").groupBy("i", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    own = by_label.join(labels.select("i", "label"), "i")
    each = own.groupBy("i").agg(
        F.max(F.when((F.col("other") == F.col("label")) & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(F.col("other") != F.col("label"), F.col("s") / F.col("n"))).alias("b"),
        F.max(F.when(F.col("other") == F.col("label"), F.col("n"))).alias("size"),
    )
    top = F.greatest("a", "b")
    s = F.when(F.col("size") < 2, 0.0).when(F.col("b").isNull(), F.lit(math.nan)).when(top == 0, 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return each.agg(F.avg(s).alias("silhouette"))


def procrustes(a: DataFrame, b: DataFrame) -> float:
    """Disparity of two embeddings after centring, scaling to unit norm and best rotation.

    Centred cross products are sums over rows; only d x d numbers come to the driver.
    """
    d = a.select(F.size("x").alias("d")).first()["d"]
    if b.select(F.size("x").alias("d")).first()["d"] != d:
        raise ValueError("embeddings of different shapes")
    both = a.select("i", "x").join(b.select("i", F.col("x").alias("y")), "i")
    p, q = [F.col("x")[k].cast("double") for k in range(d)], [F.col("y")[k].cast("double") for k in range(d)]
    m = both.agg(*[F.avg(v) for v in p + q]).first()
    p, q = [v - m[k] for k, v in enumerate(p)], [v - m[d + k] for k, v in enumerate(q)]
    got = both.agg(F.sum(sum(v * v for v in p)), F.sum(sum(v * v for v in q)), *[F.sum(u * v) for u in p for v in q]).first()
    cross = np.array(got[2:]).reshape(d, d) / math.sqrt(got[0] * got[1])
    return float(1 - np.linalg.svd(cross, compute_uv=False).sum() ** 2)


def pair_distances(a: DataFrame, b: DataFrame, *, sample: int, seed: int = 42) -> DataFrame:
    """(i, j, da, db), i < j: distances in both spaces over a bounded sample of ``sample`` points.

    The sample is part of the metrics that use it; it bounds the pairs to sample**2 / 2.
    """
    if a.count() > sample:
        a = random_sample(a.select("i", "x"), sample, seed=seed)
    rows = a.select("i", "x").join(b.select("i", F.col("x").alias("y")), "i")

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"i": pd.Series(dtype="int64"), "j": pd.Series(dtype="int64"), "da": pd.Series(dtype="float64"), "db": pd.Series(dtype="float64")})
        one, two = distances(matrix(p["x"]), matrix(q["x"])), distances(matrix(p["y"]), matrix(q["y"]))
        up = p["i"].to_numpy()[:, None] < q["i"].to_numpy()[None, :]
        r, c = np.nonzero(up)
        return pd.DataFrame({"i": p["i"].to_numpy()[r], "j": q["i"].to_numpy()[c], "da": one[r, c], "db": two[r, c]})

    return against(rows, rows, meet, "i long, j long, da double, db double", block=512)


def distance_correlation(a: DataFrame, b: DataFrame, *, sample: int = 2000) -> DataFrame:
    """Pearson correlation of pair distances."""
    return pair_distances(a, b, sample=sample).agg(F.corr("da", "db").alias("distance_correlation"))


def average_ranks(values: DataFrame, column: str, name: str) -> DataFrame:
    """``values`` with the average rank of ``column``.

    Distinct values are counted and their running totals taken over ranges: counts by range first,
    then within each range, so that no task sees all values.
    """
    # Ranks meet their values by equality: both must come from one computation of the values.
    values = cut(values)
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranged = cut(counts.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_n").alias("_all"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    run = F.sum("_n").over(Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.withColumn("_run", run).join(F.broadcast(before), "_part").select(column, (F.col("_before") + F.col("_run") - (F.col("_n") - 1) / 2).alias(name))
    return values.join(ranks, column)


def spearman(pairs: DataFrame, a: str = "da", b: str = "db") -> DataFrame:
    """Pearson correlation of average ranks."""
    return average_ranks(average_ranks(pairs, a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb").alias("spearman"))


def distance_rank_correlation(a: DataFrame, b: DataFrame, *, sample: int = 5000) -> DataFrame:
    return spearman(pair_distances(a, b, sample=sample)).select(F.col("spearman").alias("distance_rank_correlation"))


def shepard(a: DataFrame, b: DataFrame, *, sample: int = 2000) -> DataFrame:
    """Pearson and Spearman correlation of pair distances."""
    pairs = pair_distances(a, b, sample=sample)
    return average_ranks(average_ranks(pairs, "da", "_ra"), "db", "_rb").agg(F.corr("da", "db").alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def _both(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    own = lambda x, name: x.where(F.col("rank") <= k).groupBy("i").agg(F.collect_set("j").alias(name))
    return own(a, "p").join(own(b, "q"), "i")


def neighbour_agreement(spatial: DataFrame, embedded: DataFrame, k: int = 15) -> DataFrame:
    """Mean Jaccard similarity of the two neighbour sets of a point."""
    j = F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q"))
    return _both(spatial, embedded, k).agg(F.avg(j).alias("neighbour_agreement"))


def neighbour_preservation(a: DataFrame, b: DataFrame, k: int = 15) -> DataFrame:
    """Mean share of a point's neighbours that stay."""
    return _both(a, b, k).agg(F.avg(F.size(F.array_intersect("p", "q")) / F.lit(float(k))).alias("neighbour_preservation"))


def morans_i(values: DataFrame, spatial: DataFrame, k: int = 6) -> DataFrame:
    """(c, morans_i) of each embedding column over the k nearest places, binary weights."""
    near = spatial.where(F.col("rank") <= k).select("i", "j")
    long = values.select("i", F.posexplode("x").alias("c", "v"))
    mean = long.groupBy("c").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    z = long.join(F.broadcast(mean), "c").select("i", "c", "n", (F.col("v") - F.col("m")).alias("z"))
    cross = near.join(z, "i").join(z.select(F.col("i").alias("j"), "c", F.col("z").alias("zj")), ["j", "c"]).groupBy("c").agg(F.sum(F.col("z") * F.col("zj")).alias("num"), F.count(F.lit(1)).alias("w"))
    den = z.groupBy("c").agg(F.sum(F.col("z") * F.col("z")).alias("den"), F.first("n").alias("n"))
    return cross.join(den, "c").select("c", F.when(F.col("den") > 0, F.col("n") / F.col("w") * F.col("num") / F.col("den")).otherwise(0.0).alias("morans_i"))


def nearest_alike(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(i, label, d): distance to the nearest point of the same label."""
    rows = points.select("i", "x").join(labels.select("i", "label"), "i")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"i": pd.Series(dtype="int64"), "label": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64")})
        d = distances(matrix(a["x"]), matrix(b["x"]))
        alike = (a["label"].to_numpy()[:, None] == b["label"].to_numpy()[None, :]) & (a["i"].to_numpy()[:, None] != b["i"].to_numpy()[None, :])
        out = pd.DataFrame({"i": a["i"], "label": a["label"], "d": np.where(alike, d, np.inf).min(1)})
        return out[np.isfinite(out["d"])]

    return against(rows, rows, meet, "i long, label long, d double").groupBy("i", "label").agg(F.min("d").alias("d"))


def chaos(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean distance to the nearest point of the same cluster, over clusters of two or more; infinity
    if there are none."""
    return nearest_alike(points, labels).agg(F.coalesce(F.avg("d"), F.lit(math.inf)).alias("chaos"))


def pas(neighbours: DataFrame, labels: DataFrame, *, k: int = 10, threshold: float = 0.6) -> DataFrame:
    """Share of points of whose k neighbours fewer than 1 - threshold have the point's label."""
    own = labels.select("i", "label")
    same = neighbours.where(F.col("rank") <= k).join(own, "i").join(own.select(F.col("i").alias("j"), F.col("label").alias("other")), "j")
    share = same.groupBy("i").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("s"))
    return share.agg(F.avg((F.col("s") < 1 - threshold).cast("double")).alias("pas"))


def _pairs_of(n):
    return n * (n - 1) / 2


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chance-corrected agreement of two labellings (i, label)."""
    table = a.select("i", F.col("label").alias("a")).join(b.select("i", F.col("label").alias("b")), "i").groupBy("a", "b").count()
    cells = table.agg(F.sum(_pairs_of(F.col("count"))).alias("ij"), F.sum("count").alias("n"))
    rows = table.groupBy("a").agg(F.sum("count").alias("n")).agg(F.sum(_pairs_of(F.col("n"))).alias("ra"))
    columns = table.groupBy("b").agg(F.sum("count").alias("n")).agg(F.sum(_pairs_of(F.col("n"))).alias("rb"))
    expected = F.when(_pairs_of(F.col("n")) > 0, F.col("ra") * F.col("rb") / _pairs_of(F.col("n"))).otherwise(0.0)
    most = (F.col("ra") + F.col("rb")) / 2
    return cells.join(rows).join(columns).select(F.when(most == expected, 1.0).otherwise((F.col("ij") - expected) / (most - expected)).alias("ari"))


def normalized_mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """2 I / (Ha + Hb); 1 if both labellings are of one label."""
    table = a.select("i", F.col("label").alias("a")).join(b.select("i", F.col("label").alias("b")), "i").groupBy("a", "b").count()
    entropy = lambda t, name: t.join(total).agg((-F.sum(F.col("n") / F.col("all") * F.log(F.col("n") / F.col("all")))).alias(name))
    total = F.broadcast(table.agg(F.sum("count").alias("all")))
    ha, hb = entropy(table.groupBy("a").agg(F.sum("count").alias("n")), "ha"), entropy(table.groupBy("b").agg(F.sum("count").alias("n")), "hb")
    hab = entropy(table.select(F.col("count").alias("n")), "hab")
    h = F.col("ha") + F.col("hb")
    return ha.join(hb).join(hab).select(F.when(h == 0, 1.0).otherwise(2 * (h - F.col("hab")) / h).alias("nmi"))


def purity(clusters: DataFrame, types: DataFrame, *, by: str = "cluster") -> DataFrame:
    """Share of points in the dominant type of their cluster; by="type": in the dominant cluster of
    their type."""
    table = clusters.select("i", F.col("label").alias("cluster")).join(types.select("i", F.col("label").alias("type")), "i").groupBy("cluster", "type").count()
    return table.groupBy(by).agg(F.max("count").alias("top"), F.sum("count").alias("n")).agg((F.sum("top") / F.sum("n")).alias("purity"))


def triplet_accuracy(a: DataFrame, b: DataFrame, *, triplets: int = 50_000, first: int = 5000, seed: int = 42) -> DataFrame:
    """Share of hashed triplets (i, j, k) whose order of distances from i is kept."""
    spark = a.sparkSession
    rows = a.select("i", "x").join(b.select("i", F.col("x").alias("y")), "i").orderBy("i").limit(first)
    numbered = rows.select("x", "y", (F.row_number().over(Window.orderBy("i")) - 1).alias("k"))
    n = min(first, a.count())
    draw = lambda s: F.pmod(portable_hash(F.col("id") * 3 + s, seed), F.lit(n))
    drawn = spark.range(triplets).select(draw(0).alias("p"), draw(1).alias("q"), draw(2).alias("r")).where("p <> q and p <> r and q <> r")
    for name in "pqr":
        drawn = drawn.join(F.broadcast(numbered.select(F.col("k").alias(name), F.col("x").alias(f"x{name}"), F.col("y").alias(f"y{name}"))), name)
    d = lambda u, v: F.aggregate(F.zip_with(u, v, lambda s, t: (s.cast("double") - t) * (s.cast("double") - t)), F.lit(0.0), lambda s, t: s + t)
    kept = (d("xp", "xq") < d("xp", "xr")) == (d("yp", "yq") < d("yp", "yr"))
    return drawn.agg(F.avg(kept.cast("double")).alias("triplet_accuracy"))


def centroid_correlation(a: DataFrame, b: DataFrame, labels: DataFrame) -> DataFrame:
    """Spearman correlation of the distances of label centroids in both spaces."""
    def cents(p: DataFrame) -> DataFrame:
        long = p.join(labels.select("i", "label"), "i").select("label", F.posexplode("x").alias("f", "v"))
        return long.groupBy("label", "f").agg(F.avg(F.col("v").cast("double")).alias("m"))

    def pairs(c: DataFrame, name: str) -> DataFrame:
        right = c.select(F.col("label").alias("other"), "f", F.col("m").alias("n"))
        return c.join(right, "f").where("label < other").groupBy("label", "other").agg(F.sqrt(F.sum((F.col("m") - F.col("n")) * (F.col("m") - F.col("n")))).alias(name))

    both = pairs(cents(a), "da").join(pairs(cents(b), "db"), ["label", "other"])
    return spearman(both).select(F.col("spearman").alias("centroid_correlation"))


def verdicts(metrics: DataFrame) -> DataFrame:
    """(dataset, init, procrustes, distance_correlation, trust_drift, silhouette_drift) with a pass
    for each threshold and overall."""
    p, c = F.col("procrustes") < PROCRUSTES_MOST, F.col("distance_correlation") > CORRELATION_LEAST
    t, s = F.abs("trust_drift") < TRUST_DRIFT, F.abs("silhouette_drift") < SILHOUETTE_DRIFT
    return metrics.select("*", p.alias("procrustes_ok"), c.alias("correlation_ok"), t.alias("trust_ok"), s.alias("silhouette_ok"), (p & c & t & s).alias("overall"))


def too_easy(judged: DataFrame, random_init: str = "random") -> DataFrame:
    """Datasets where the compared embedding passes and random coordinates do too."""
    passes = judged.groupBy("dataset").agg(F.bool_or(F.col("overall") & (F.col("init") != random_init)).alias("ours"), F.bool_or(F.col("overall") & (F.col("init") == random_init)).alias("random"))
    return passes.where("ours and random").select("dataset")


def speedups(timings: DataFrame) -> DataFrame:
    """(n, baseline_ns, variant_ns, setup_ns) with speedup, and the iterations after which a
    variant's set-up pays (null if never)."""
    gain = F.col("baseline_ns") - F.col("variant_ns")
    return timings.select("*", (F.col("baseline_ns") / F.col("variant_ns")).alias("speedup"), F.when(gain > 0, F.ceil(F.col("setup_ns") / gain).cast("double")).alias("break_even"))


def level_shares(solves: DataFrame) -> DataFrame:
    """(level, share) of solves that ended at each level."""
    total = solves.agg(F.count(F.lit(1)).alias("n"))
    return solves.groupBy("level").count().join(F.broadcast(total)).select("level", (F.col("count") / F.col("n")).alias("share"))


def slowest(timings: DataFrame) -> DataFrame:
    """(name, seconds), slowest first; ties by name."""
    return timings.orderBy(F.desc("seconds"), "name")
