import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import spectral
from lumenfold.operators import fuzzy
from lumenfold.operators.laplacian import degrees, laplacian
from lumenfold.operators.lineage import cut
from lumenfold.plans import embed
from lumenfold.plans.config import ComputeMode, InvalidGraph, SpectralConfig, TooFewNodes
from lumenfold.plans.distributed import smallest_pairs
from lumenfold.sources import generators as gen


def coords(df):
    got = sorted(df.collect(), key=lambda r: r.i)
    return np.array([r.coords for r in got])


GRAPHS = {
    "path": lambda s: gen.path(s, 100), "ring": lambda s: gen.ring(s, 100), "complete": lambda s: gen.complete(s, 20), "star": lambda s: gen.star(s, 50), "bipartite": lambda s: gen.bipartite(s, 10, 10),
    "barbell": lambda s: gen.bridged_cliques(s, 20), "bridge": lambda s: gen.bridged_cliques(s, 20, 1e-6), "exponential": lambda s: gen.exponential_path(s, 100), "lollipop": lambda s: gen.lollipop(s, 10, 20),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_connected_graphs(spark, name):
    e, v = GRAPHS[name](spark)
    x = coords(embed.spectral_coordinates(e, v, 2))
    assert x.shape == (v.count(), 2) and np.isfinite(x).all() and abs(np.abs(x).max() - 10) < 0.01
    if name in ("barbell", "bridge"):
        a, b = x[:20, 0], x[20:, 0]
        assert abs(a.mean() - b.mean()) > max(np.ptp(a), np.ptp(b))


def test_result_does_not_depend_on_partitions(spark):
    e, v = gen.lollipop(spark, 8, 9)
    one = coords(embed.spectral_coordinates(e, v, 2))
    two = coords(embed.spectral_coordinates(e.repartition(7), v.repartition(3), 2))
    assert (one == two).all()
    assert not (coords(embed.spectral_coordinates(e, v, 2, seed=1)) == one).all()


def test_few_components_are_placed_at_unit_vectors(spark):
    e, v = gen.two_paths(spark, 30)
    x = coords(embed.spectral_coordinates(e, v, 2))
    assert (np.abs(x).sum(1) > 0).all() and np.isfinite(x).all()
    centre = x.reshape(2, 30, 2).mean(1)
    spread = max(np.linalg.norm(x[:30] - centre[0], axis=1).max(), np.linalg.norm(x[30:] - centre[1], axis=1).max())
    assert np.linalg.norm(centre[0] - centre[1]) > spread
    e, v = gen.cliques(spark, 3, 3)  # each smaller than 2 * dims: at its position
    raw = embed.raw_coordinates(e, v, 2).collect()
    assert {(r.i, r.c): r.v for r in raw} == {(i, c): [[1, 0], [0, 1], [-1, 0]][i // 3][c] for i in range(9) for c in range(2)} and {r.level for r in raw} == {-1}


def test_many_components_need_data(spark):
    e, v = gen.cliques(spark, 10, 5)
    with pytest.raises(InvalidGraph):
        embed.spectral_coordinates(e, v, 2)
    data = v.select("i", F.array((F.floor(F.col("i") / 5) * 0.4).cast("float"), (F.floor(F.col("i") / 5) % 4 * 0.3).cast("float")).alias("x"))
    x = coords(embed.spectral_coordinates(e, v, 2, data=data))
    assert x.shape == (50, 2) and np.isfinite(x).all()
    got = spectral.separation_ratio(embed.raw_coordinates(e, v, 2, data=data).select("i", "c", "v"), v.select("i", F.floor(F.col("i") / 5).alias("label"))).first()[0]
    assert got > 0


def test_what_is_refused(spark):
    e, v = gen.single_edge(spark)
    with pytest.raises(TooFewNodes):
        embed.spectral_coordinates(e, v, 2)
    for dims, error in ((0, InvalidGraph), (-1, InvalidGraph), (5, TooFewNodes)):
        with pytest.raises(error):
            embed.spectral_coordinates(e, v, dims)
    with pytest.raises(InvalidGraph):
        embed.spectral_coordinates(e, v.limit(0), 1)
    for w in (-1.0, math.nan, None):
        with pytest.raises(InvalidGraph):
            embed.spectral_coordinates(spark.createDataFrame([(0, 1, w), (1, 0, 1.0)], "i long, j long, w float"), spark.range(3).withColumnRenamed("id", "i"), 1)
    with pytest.raises(InvalidGraph):
        embed.spectral_coordinates(e, spark.range(5, 9).withColumnRenamed("id", "i"), 1)


def test_distributed_solver_matches_the_dense_one(spark):
    e, v = gen.bridged_cliques(spark, 12, 0.3)
    degs = cut(degrees(e, v))
    lap = cut(laplacian(e, degs))
    values, vectors, worst, _ = smallest_pairs(lap, degs, 3, tol=1e-6, rounds=60)
    dense = np.zeros((24, 24))
    for r in lap.collect():
        dense[r.i, r.j] = r.l
    want, x = np.linalg.eigh(dense)
    assert worst < 1e-6 and np.allclose(values, want[:3], atol=1e-9)
    got = np.array([r.x for r in vectors.orderBy("i").collect()])
    assert abs(got[:, 1] @ x[:, 1]) / np.linalg.norm(got[:, 1]) > 0.9999


def test_large_components_take_the_distributed_way(spark):
    e, v = gen.bridged_cliques(spark, 10, 0.3)
    near, far = (embed.raw_coordinates(e, v, 1, config=SpectralConfig(local_edges=k)).collect() for k in (10**6, 10))
    assert {r.level for r in near} == {0} and {r.level for r in far} == {9}
    a, b = (np.array([r.v for r in sorted(x, key=lambda r: r.i)]) for x in (near, far))
    assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) > 0.9999


def test_points_to_coordinates(spark):
    p = gen.dataset(spark, "blobs_connected_200")
    g = cut(fuzzy.fuzzy_graph(p.select("i", "x"), 15, "exact"))
    x = coords(embed.spectral_coordinates(g, p.select("i"), 2, data=p.select("i", "x")))
    assert x.shape == (200, 2) and np.isfinite(x).all()
    lap, values, vectors = embed.eigenpairs(g, p.select("i"), 2, config=SpectralConfig(compute_mode=ComputeMode.NATIVE))
    report = spectral.assess("blobs", 200, lap, values.select("c", "lam"), vectors, components=1, expected_components=1)
    assert report.where("not passed").count() == 0
    clusters = spectral.compare_eigenvectors(values, vectors, vectors.withColumn("v", -F.col("v")))
    assert all(c["error"] < 1e-6 for c in clusters.collect())
