import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import components as comp
from lumenfold.operators import fuzzy, knn, laplacian, multi, prep, selection
from lumenfold.sources import generators as gen


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "i long, x array<double>")


def brute_knn(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return {(i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k])}


@pytest.mark.parametrize("block", [7, 1000])
def test_exact_neighbours(spark, block):
    x = np.random.default_rng(1).integers(0, 4, (40, 3)).astype(float)  # ties
    got = knn.knn_exact(points(spark, x), 5, block=block)
    assert set(rows(got, "i", "rank", "j")) == brute_knn(x, 5)
    assert got.where("i = j").count() == 0
    assert knn.knn_exact(points(spark, x[:1]), 5).count() == 0 and knn.knn_exact(points(spark, x[:3]), 5).count() == 6


def test_approximate_neighbours_and_the_switch(spark):
    p = gen.blobs(spark, 600, features=4, centers=4).select("i", "x")
    r = knn.recall(knn.knn_approx(p, 10, bucket=100), knn.knn_exact(p, 10)).first()["recall"]
    assert r > 0.9
    with pytest.raises(ValueError):
        knn.knn(p, 3, "other")
    assert knn.knn(p.limit(20), 3).count() == 60


def test_the_default_search_loses_no_neighbour_of_a_large_table(spark):
    x = np.random.default_rng(5).normal(size=(9000, 12))
    got = {}
    for i, j in rows(knn.knn(points(spark, x), 5).where("i < 60"), "i", "j"):
        got.setdefault(i, set()).add(j)
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert got[i] == set(np.argsort(d)[:5].tolist())


def test_bandwidths_meet_the_target(spark):
    k = 8
    near = knn.knn_exact(gen.blobs(spark, 120).select("i", "x"), k)
    band = fuzzy.smooth_knn(near, k)
    w = fuzzy.membership(near, band)
    sums = w.groupBy("i").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s - math.log2(k)) < 1e-6 for r in sums)
    assert band.where("sigma <= 0").count() == 0 and w.where("w <= 0 or w > 1").count() == 0


def test_bandwidth_floor_for_duplicates(spark):
    near = knn.knn_exact(points(spark, np.r_[np.zeros((6, 2)), np.ones((6, 2))]), 3)
    got = fuzzy.smooth_knn(near, 3)
    assert got.where("rho <> 0 or sigma < 0").count() == 0 and fuzzy.membership(near, got).where("w <> 1").count() == 0


def test_union_prune_and_symmetry(spark):
    e = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.25), (1, 2, 0.001), (0, 1, 0.1), (3, 3, 0.2)], "i long, j long, w double")
    u = fuzzy.fuzzy_union(e)
    got = {(r.i, r.j): r.w for r in u.collect()}
    both = 0.6 + 0.25 - 0.6 * 0.25
    assert got == pytest.approx({(0, 1): both, (1, 0): both, (1, 2): 0.001, (2, 1): 0.001, (3, 3): 0.2 + 0.2 - 0.04})
    assert fuzzy.asymmetry(u).first()["symmetric"] and not fuzzy.asymmetry(e).first()["symmetric"]
    assert {(r.i, r.j) for r in fuzzy.prune(u, 4).collect()} == {(0, 1), (1, 0), (3, 3)}
    assert fuzzy.prune(u, 4, epochs=2000).count() == 5 and fuzzy.n_epochs(10_000) == 500 and fuzzy.n_epochs(10_001) == 200


def random_graph(spark, n=60, m=70, seed=3):
    rng = random.Random(seed)
    once = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n - 3), rng.randrange(n - 3)) for _ in range(m)) if a != b}
    both = [(a, b, w) for a, b in sorted(once) for w in [rng.random()] for a, b in ((a, b), (b, a))]
    return spark.createDataFrame(both, "i long, j long, w float"), spark.range(n).withColumnRenamed("id", "i"), both


@pytest.mark.parametrize("partitions", ["2", "9"])
def test_components_members_subgraphs(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    e, v, both = random_graph(spark)
    parent = list(range(60))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b, _ in both:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    firsts = sorted({root(x) for x in range(60)})
    labels = comp.components(e, v)
    assert rows(labels, "i", "label") == rows(comp.components(e, v, local_edges=0), "i", "label") == [(x, firsts.index(root(x))) for x in range(60)]
    members = {r.label: r.members for r in comp.component_members(labels).collect()}
    assert members[0] == [x for x in range(60) if root(x) == 0] and members[firsts.index(59)] == [59]
    sub = comp.subgraphs(e, labels).collect()
    assert len(sub) == len(both) and {(members[r.label][r.li], members[r.label][r.lj]) for r in sub} == {(a, b) for a, b, _ in both}
    assert comp.same_partition(labels, labels.select("i", (-F.col("label")).alias("label"))).first()["same"]
    assert not comp.same_partition(labels, labels.select("i", F.lit(0).alias("label"))).first()["same"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_numbers_by_ranges(spark):
    from lumenfold.operators.numbering import number_rows

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("number2")).repartition(5)
    for limit in (10, 10_000):
        assert rows(number_rows(df, "v", one_window=limit), "v", "number") == [(k, k) for k in range(1000)]
    labels = spark.range(500).select(F.col("id").alias("i"), F.when(F.col("id") % 10 == 3, 1).otherwise(0).alias("label"))
    assert rows(comp.local_numbers(labels, 10), "i", "label", "li") == rows(comp.local_numbers(labels), "i", "label", "li")
    assert comp.local_numbers(labels, 10).where("label = 1").agg(F.max("li")).first()[0] == 49


def test_components_of_a_long_path_and_of_no_edges(spark):
    e, v = gen.path(spark, 300)
    assert comp.components(e, v).where("label <> 0").count() == 0
    assert comp.components(e, v, local_edges=0).where("label <> 0").count() == 0
    assert rows(comp.components(e.limit(0), v.limit(4)), "i", "label") == [(k, k) for k in range(4)]
    zero = spark.createDataFrame([(0, 1, 0.0), (1, 0, 0.0)], "i long, j long, w float")
    assert comp.components(zero, v.limit(2)).select("label").distinct().count() == 1


def test_degrees_laplacian_products(spark):
    e, v, both = random_graph(spark)
    e = e.unionByName(spark.createDataFrame([(2, 2, 0.5)], "i long, j long, w float"))
    both = [*both, (2, 2, 0.5)]
    w = np.zeros((60, 60), dtype=np.float32)
    for a, b, x in both:
        w[a, b] = x
    d64 = w.astype(float).sum(1)
    d32 = np.zeros(60, dtype=np.float32)
    for a in range(60):
        d32 += w[a]
    native, compat = laplacian.degrees(e, v), laplacian.degrees(e, v, "compat")
    assert np.allclose([r[1] for r in rows(native, "i", "deg")], d64, atol=1e-12)
    assert [r[1] for r in rows(compat, "i", "deg")] == d32.astype(float).tolist()
    with pytest.raises(ValueError):
        laplacian.degrees(e, v, "other")
    inv = np.divide(1, np.sqrt(d64), out=np.zeros(60), where=d64 > 0)
    want = -inv[:, None] * w * inv[None]
    np.fill_diagonal(want, 1)
    lap = laplacian.laplacian(e, native)
    dense = np.zeros((60, 60))
    for r in lap.collect():
        dense[r.i, r.j] = r.l
    assert np.allclose(dense, want, atol=1e-12) and lap.where("i = j").count() == 60
    x = np.random.default_rng(2).normal(size=(60, 3))
    frame = spark.createDataFrame([(k, p.tolist(), float(p[0])) for k, p in enumerate(x)], "i long, x array<double>, v double")
    y = {r.i: r.y for r in laplacian.spmm(lap, frame.select("i", "x"), 3).collect()}
    assert np.allclose([y[k] for k in range(60)], dense @ x)
    y = {r.i: r.y for r in laplacian.spmv(lap, frame.select("i", F.col("v").alias("x"))).collect()}
    assert np.allclose([y[k] for k in range(60)], dense @ x[:, 0])
    two = {(r.i, r.j): r.l for r in laplacian.two_i_minus(lap).collect()}
    assert two[5, 5] == 1 and all(two[r.i, r.j] == -r.l for r in lap.where("i <> j").collect())
    assert {r.l for r in laplacian.shifted(lap, 0.5).where("i = j").collect()} == {1.5}


def test_selection_signs_scale_noise(spark):
    v = np.array([[0.1, -3.0, 0.5], [0.2, 3.0, -0.5], [0.3, 1.0, 0.0]])
    long = spark.createDataFrame([(i, c, float(v[i, c])) for i in range(3) for c in range(3)], "i long, c int, v double")
    lam = spark.createDataFrame([(0, 0.5), (1, 0.1), (2, 0.5)], "c int, lam double")
    got = selection.select_eigenvectors(lam, long, 2)
    assert rows(got, "c", "i", "v") == [(0, i, v[i, 0]) for i in range(3)] + [(1, i, v[i, 2]) for i in range(3)]
    with pytest.raises(ValueError):
        selection.select_eigenvectors(lam, long, 3)
    signed = {(r.i, r.c): r.v for r in selection.normalize_signs(long).collect()}
    assert signed[0, 1] == 3.0 and signed[1, 1] == -3.0 and signed[0, 2] == 0.5  # the first of equal sizes decides
    scaled = selection.scale_coords(long)
    assert max(abs(r.v) for r in scaled.collect()) == 10 and scaled.schema["v"].dataType.simpleString() == "float"
    with pytest.raises(Exception, match="all coordinates are zero"):
        selection.scale_coords(long.withColumn("v", F.lit(0.0))).collect()
    flat = spark.range(4000).select(F.col("id").alias("i"), F.lit(0).alias("c"), F.lit(0.0).cast("float").alias("v"))
    noise = selection.add_noise(flat, 1e-2)
    s = noise.agg(F.avg("v"), F.stddev("v")).first()
    assert abs(s[0]) < 3e-2 / math.sqrt(4000) and abs(s[1] / 1e-2 - 1) < 0.2
    assert rows(noise, "i", "v") == rows(selection.add_noise(flat.repartition(7), 1e-2), "i", "v") != rows(selection.add_noise(flat, 1e-2, seed=1), "i", "v")
    for bad in (0, -1, math.nan, math.inf, 1e-60):
        with pytest.raises(ValueError):
            selection.add_noise(flat, bad)
    spans = selection.min_max(long).groupBy("c").agg(F.min("v"), F.max("v")).collect()
    assert all((r[1], r[2]) == (0, 10) for r in spans)
    assert {r.i: r.coords for r in selection.wide(long, "double").collect()} == {i: v[i].tolist() for i in range(3)}
    assert rows(selection.long(selection.wide(long, "double")), "i", "c", "v") == rows(long, "i", "c", "v")


def test_placing_components(spark):
    labels = spark.createDataFrame([(i, i // 2) for i in range(10)], "i long, label int")
    meta = {(r.label, r.c): r.v for r in multi.orthogonal_meta(labels, 3).collect()}
    assert [[meta[r, c] for c in range(3)] for r in range(5)] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0], [0, -1, 0]]
    x = np.random.default_rng(4).normal(size=(10, 2))
    cents = multi.centroids(points(spark, x), labels)
    want = x.reshape(5, 2, 2).mean(1)
    assert np.allclose([r[2] for r in rows(cents, "label", "f", "v")], want.ravel())
    aff = {(r.a, r.b): r.w for r in multi.affinity(cents).collect()}
    assert aff[1, 1] == 1 and aff[0, 3] == pytest.approx(math.exp(-((want[0] - want[3]) ** 2).sum()))
    w = np.array([[aff[a, b] * (a != b) for b in range(5)] for a in range(5)])
    lap = {(r.i, r.j): r.l for r in multi.meta_laplacian(multi.affinity(cents)).collect()}
    d = w.sum(1)
    assert lap[2, 2] == 1 and lap[0, 1] == pytest.approx(-w[0, 1] / math.sqrt(d[0] * d[1]))
    at = spark.createDataFrame([(0, 0, 0.0), (1, 0, 0.0), (2, 0, 3.0), (3, 0, 3.0)], "label int, c int, v double")
    assert rows(multi.data_ranges(at), "label", "range") == [(k, 1.5) for k in range(4)]
    assert rows(multi.data_ranges(at.where("label = 0")), "label", "range") == [(0, 1.0)]
    assert multi.spectral_meta_needed(5, 2) and not multi.spectral_meta_needed(4, 2)


def test_preparation(spark):
    t = spark.createDataFrame([(c, f, float((c * 7 + f * 3) % 5)) for c in range(20) for f in range(4)], "cell long, feature long, value double")
    assert all(abs(r.s - 1000) < 1e-9 for r in prep.normalize_total(t).groupBy("cell").agg(F.sum("value").alias("s")).collect())
    z = prep.zscore_clip(t).groupBy("feature").agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).collect()
    assert all(abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9 for r in z)
    clipped = prep.zscore_clip(spark.createDataFrame([(c, 0, 1e6 if c == 0 else 0.0) for c in range(1000)], "cell long, feature long, value double"))
    assert clipped.agg(F.max("value")).first()[0] == 10
    runs = prep.run_mean_normalize(t.withColumn("run", F.col("cell") % 3)).groupBy("run").agg(F.avg("value").alias("m")).collect()
    assert max(r.m for r in runs) - min(r.m for r in runs) < 1e-9
    assert [r.feature for r in prep.highly_variable(t.withColumn("value", F.col("value") * F.col("feature")), 2, bins=1).collect()] == [3, 2]
    x = np.random.default_rng(6).normal(size=(80, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    got = np.array([r.x for r in prep.pca(points(spark, x), 2).orderBy("i").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :2]), atol=1e-8)
    cells = spark.range(500).select(F.col("id").alias("i"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    s = prep.stratified_sample(cells, 100, grid=5)
    assert s.count() == 100 and s.select("gx", "gy").distinct().count() == 25
    assert rows(s, "i") == rows(prep.stratified_sample(cells.repartition(9), 100, grid=5), "i")
    assert prep.random_sample(cells, 30).count() == 30 and rows(prep.random_sample(cells, 30), "i") == rows(prep.random_sample(cells.repartition(5), 30), "i")
    sweep = spark.createDataFrame([("a", 0.9, 0.3, 1.0), ("b", 0.8, 0.9, 9.0)], "run string, trustworthiness double, silhouette double, spectral_gap double")
    assert prep.sweep_winner(sweep).first()["run"] == "a"
