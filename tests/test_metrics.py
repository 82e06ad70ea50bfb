import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import quality as Q
from lumenfold.functions import spectral as S
from lumenfold.operators.knn import knn_exact


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i long, x array<double>")


def labelled(spark, labels):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "i long, label int")


def long(spark, v):
    return spark.createDataFrame([(i, c, float(v[i, c])) for i in range(v.shape[0]) for c in range(v.shape[1])], "i long, c int, v double")


def dist(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def ranks(d):
    out = np.zeros(d.shape, dtype=int)
    for i in range(len(d)):
        for r, j in enumerate(sorted((j for j in range(len(d)) if j != i), key=lambda j: (d[i, j], j))):
            out[i, j] = r + 1
    return out


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(8)
    x, y, lab = rng.normal(size=(60, 4)), rng.normal(size=(60, 2)), rng.integers(0, 4, 60)
    y[:, 0] += x[:, 0] * 2
    return x, y, lab, points(spark, x).cache(), points(spark, y).cache(), labelled(spark, lab).cache()


def test_preservation(spark, cloud):
    x, y, _, px, py, _ = cloud
    k, n = 7, 60
    rx, ry = ranks(dist(x)), ranks(dist(y))
    factor = 2 / (n * k * (2 * n - 3 * k - 1))
    tw = 1 - factor * ((rx - k) * ((ry > 0) & (ry <= k) & (rx > k))).sum()
    ct = 1 - factor * ((ry - k) * ((rx > 0) & (rx <= k) & (ry > k))).sum()
    assert Q.trustworthiness(px, knn_exact(py, k), k).first()[0] == pytest.approx(tw)
    assert Q.continuity(py, knn_exact(px, k), k).first()[0] == pytest.approx(ct)
    assert Q.trustworthiness(px, knn_exact(px, k), k).first()[0] == 1
    a, b = (rx > 0) & (rx <= k), (ry > 0) & (ry <= k)
    assert Q.neighbour_preservation(knn_exact(px, k), knn_exact(py, k), k).first()[0] == pytest.approx((a & b).sum() / (n * k))
    assert Q.neighbour_agreement(knn_exact(px, k), knn_exact(py, k), k).first()[0] == pytest.approx(((a & b).sum(1) / (a | b).sum(1)).mean())


def test_silhouette(spark, cloud):
    x, _, lab, px, _, pl = cloud
    d = dist(x)
    s = []
    for i in range(60):
        a = d[i][lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = min(d[i][lab == g].mean() for g in set(lab) - {lab[i]})
        s.append((b - a) / max(a, b))
    assert Q.silhouette(px, pl).first()[0] == pytest.approx(np.mean(s))
    assert math.isnan(Q.silhouette(px, pl.withColumn("label", F.lit(1))).first()[0])
    assert Q.silhouette(points(spark, [[0.0], [1.0]]), labelled(spark, [0, 1])).first()[0] == 0


def test_distances_and_ranks(spark, cloud):
    x, y, _, px, py, pl = cloud
    up = np.triu_indices(60, 1)
    a, b = dist(x)[up], dist(y)[up]
    rank = lambda v: np.argsort(np.argsort(v))
    assert Q.distance_correlation(px, py).first()[0] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert Q.distance_rank_correlation(px, py).first()[0] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    got = Q.shepard(px, py).first()
    assert got["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["spearman"] == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert Q.pair_distances(px, py, sample=10).count() == 45
    tied = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, 2.0, 3.0]], "v double")
    assert sorted((r.v, r.r) for r in Q.average_ranks(tied, "v", "r").collect()) == [(1, 1), (2, 2), (3, 4), (3, 4), (3, 4)]
    assert -1 <= Q.centroid_correlation(px, py, pl).first()[0] <= 1
    assert Q.centroid_correlation(px, px, pl).first()[0] == pytest.approx(1)


def test_procrustes(spark, cloud):
    _, y, _, px, py, _ = cloud
    t = 0.7
    turned = y @ np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) * 3 + 5
    assert Q.procrustes(py, points(spark, turned)) == pytest.approx(0, abs=1e-9)
    z = np.random.default_rng(1).normal(size=y.shape)
    p, q = y - y.mean(0), z - z.mean(0)
    s = np.linalg.svd((p / np.linalg.norm(p)).T @ (q / np.linalg.norm(q)), compute_uv=False).sum()
    assert Q.procrustes(py, points(spark, z)) == pytest.approx(1 - s**2)
    with pytest.raises(ValueError):
        Q.procrustes(px, py)


def test_spatial(spark, cloud):
    x, y, lab, px, py, pl = cloud
    r, d = ranks(dist(y)), dist(y)
    w = (r > 0) & (r <= 6)
    z = x - x.mean(0)
    want = 60 / w.sum() * np.einsum("ij,ic,jc->c", w, z, z) / (z**2).sum(0)
    assert np.allclose([m.morans_i for m in Q.morans_i(px, knn_exact(py, 6)).orderBy("c").collect()], want)
    np.fill_diagonal(d, np.inf)
    near = [d[i][lab == lab[i]].min() for i in range(60)]
    assert Q.chaos(py, pl).first()[0] == pytest.approx(np.mean(near))
    assert Q.chaos(points(spark, [[0.0], [1.0]]), labelled(spark, [0, 1])).first()[0] == math.inf
    w = (r > 0) & (r <= 10)
    share = (w & (lab[None] == lab[:, None])).sum(1) / 10
    assert Q.pas(knn_exact(py, 10), pl).first()[0] == pytest.approx((share < 0.4).mean())


def test_clusters(spark, cloud):
    pl = cloud[5]
    other = pl.select("i", (F.col("label") * 10).alias("label"))
    one = pl.withColumn("label", F.lit(0))
    for f in (Q.adjusted_rand, Q.normalized_mutual_information, Q.purity):
        assert f(pl, other).first()[0] == pytest.approx(1)
    assert Q.adjusted_rand(pl, one).first()[0] == pytest.approx(0) and Q.normalized_mutual_information(pl, one).first()[0] == pytest.approx(0)
    assert Q.adjusted_rand(one, one).first()[0] == 1 and Q.normalized_mutual_information(one, one).first()[0] == 1
    a, b = labelled(spark, [0, 0, 0, 1, 1, 1]), labelled(spark, [0, 0, 1, 1, 2, 2])
    assert Q.adjusted_rand(a, b).first()[0] == pytest.approx(0.24242424)
    assert Q.purity(a, b).first()[0] == pytest.approx(4 / 6) and Q.purity(a, b, by="type").first()[0] == pytest.approx(5 / 6)


def test_triplets_and_verdicts(spark, cloud):
    _, _, _, px, py, _ = cloud
    assert Q.triplet_accuracy(px, px, triplets=500).first()[0] == 1 and 0.3 < Q.triplet_accuracy(px, py, triplets=2000).first()[0] < 1
    rows = [("d", "ours", 0.01, 0.999, 0.0, 0.0), ("d", "random", 0.01, 0.999, 0.0, 0.0), ("e", "ours", 0.05, 0.999, 0.0, 0.0)]
    got = Q.verdicts(spark.createDataFrame(rows, "dataset string, init string, procrustes double, distance_correlation double, trust_drift double, silhouette_drift double"))
    assert [r.overall for r in got.orderBy("dataset", "init").collect()] == [True, True, False]
    assert [r.dataset for r in Q.too_easy(got).collect()] == ["d"]


def test_spectral_metrics(spark):
    lap = np.array([[1, -1, 0], [-1, 2, -1], [0, -1, 1.0]])
    values, x = np.linalg.eigh(lap)
    frame = spark.createDataFrame([(i, j, float(lap[i, j])) for i in range(3) for j in range(3) if lap[i, j]], "i long, j long, l double")
    lam = spark.createDataFrame([(c, float(v)) for c, v in enumerate(values)], "c int, lam double")
    assert S.max_residual(frame, lam, long(spark, x)).first()[0] < 1e-12
    assert S.orthogonality_error(long(spark, x)).first()[0] < 1e-12
    bad = x.copy()
    bad[0, 1] = np.nan
    assert math.isnan(S.max_residual(frame, lam, long(spark, bad)).first()[0])
    assert tuple(S.eigenvalue_bounds(lam).first()) == (False, True)
    assert tuple(S.eigenvalue_bounds(lam.where("c < 2").withColumn("lam", -F.col("lam") + 1)).first()) == (True, False)
    gap = S.spectrum(lam).first()
    assert gap["spectral_gap"] == pytest.approx(1) and gap["condition_number"] == pytest.approx(3)
    assert S.spectrum(lam.withColumn("lam", F.lit(0.0))).first()["condition_number"] == math.inf
    a, b = long(spark, x[:, :2]), long(spark, -x[:, :2])
    assert S.subspace_det(a, b).first()[0] == pytest.approx(1) and S.subspace_det_kd(a, b) == pytest.approx(1)
    assert S.sign_agnostic_error(a, b).first()[0] < 1e-12 and S.max_principal_angle(a, b) == pytest.approx(0, abs=1e-6)
    t = 0.3
    turned = np.c_[x[:, 0], math.cos(t) * x[:, 1] + math.sin(t) * x[:, 2]]
    assert S.max_principal_angle(a, long(spark, turned)) == pytest.approx(t)
    err = S.eigenvalue_errors(lam, lam.withColumn("lam", F.col("lam") + 0.5)).orderBy("c").collect()
    assert all(r.abs_error == pytest.approx(0.5) for r in err)
    pair = spark.createDataFrame([(0, 1, 0.0), (1, 1, 2e-7), (2, 1, 0.5)], "c int, k int, lam double")
    turned = np.c_[math.cos(t) * x[:, 0] + math.sin(t) * x[:, 1], -math.sin(t) * x[:, 0] + math.cos(t) * x[:, 1], -x[:, 2]]
    got = S.compare_eigenvectors(pair.select("c", "lam"), long(spark, x), long(spark, turned))
    got = got.orderBy("columns").collect()
    assert [g["columns"] for g in got] == [[0, 1], [2]] and [g["kind"] for g in got] == ["subspace", "vector"] and all(g["error"] < 1e-6 for g in got)


def test_separation(spark):
    c = long(spark, np.array([[0.0, 0], [0, 2], [10, 0], [10, 2]]))
    assert S.separation_ratio(c, labelled(spark, [0, 0, 1, 1])).first()[0] == pytest.approx(10)
    assert S.separation_ratio(c, labelled(spark, [0, 0, 0, 0])).first()[0] == math.inf
    assert S.separation_ratio(c, labelled(spark, [0, 1, 2, 3])).first()[0] == math.inf
