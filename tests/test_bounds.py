"""What is refused, or goes another way, beyond a counted bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import quality
from lumenfold.operators import components, knn, laplacian, lineage, multi
from lumenfold.plans import embed, solvers
from lumenfold.plans.config import ComputeMode, ConvergenceFailure, InvalidGraph, SpectralConfig
from lumenfold.sources import generators as gen


def test_hubs_are_refused_in_compat_mode(spark, monkeypatch):
    e, v = gen.star(spark, 30)
    assert laplacian.degrees(e, v, "compat").where("i = 0").first()["deg"] == 29
    monkeypatch.setattr(laplacian, "COMPAT_EDGES", 20)
    with pytest.raises(ValueError):
        laplacian.degrees(e, v, "compat")
    assert laplacian.degrees(e, v).where("i = 0").first()["deg"] == 29


def test_large_components_are_not_listed(spark):
    labels = spark.range(9).select(F.col("id").alias("i"), F.when(F.col("id") < 6, 0).otherwise(1).alias("label"))
    assert [r.members for r in components.component_members(labels).orderBy("label").collect()] == [[0, 1, 2, 3, 4, 5], [6, 7, 8]]
    with pytest.raises(ValueError):
        components.component_members(labels, most=5)


def test_the_last_level_is_bounded():
    n = 40
    lap, root = solvers.laplacian_of(np.arange(n), (np.arange(n) + 1) % n, np.ones(n), n)
    low = SpectralConfig(dense_below=0, dense_most=10)
    broken = solvers.Csr(lap.rows, lap.cols, np.where(lap.rows == 0, np.nan, lap.data), n)
    with pytest.raises((ConvergenceFailure, np.linalg.LinAlgError, ValueError)):
        solvers.solve(broken, 2, 1, root, low)


def test_many_components_are_not_placed_by_affinity(spark):
    e, v = gen.cliques(spark, 9, 5)
    data = v.select("i", F.array(F.floor(F.col("i") / 5).cast("double")).alias("x"))
    with pytest.raises(InvalidGraph):
        embed.raw_coordinates(e, v, 2, data=data, config=SpectralConfig(most_placed=8))


def test_eigenpairs_beyond_a_task(spark):
    e, v = gen.torus(spark, 6, 9)
    near, far = (embed.eigenpairs(e, v, 2, config=SpectralConfig(compute_mode=ComputeMode.NATIVE, local_edges=k))[1].orderBy("c").collect() for k in (10**6, 10))
    assert [r.level for r in near] == [0] * 3 and [r.level for r in far] == [9] * 3
    assert [r.lam for r in far] == pytest.approx([r.lam for r in near], abs=1e-6) and all(r.residual < 1e-3 for r in far)


def test_torus_has_its_closed_spectrum(spark):
    e, v = gen.torus(spark, 5, 7)
    assert e.count() == 4 * 35 and v.count() == 35
    lap = np.zeros((35, 35))
    for r in laplacian.laplacian(e, laplacian.degrees(e, v)).collect():
        lap[r.i, r.j] += r.l
    want = sorted(1 - (np.cos(2 * np.pi * a / 5) + np.cos(2 * np.pi * b / 7)) / 2 for a in range(5) for b in range(7))
    assert np.linalg.eigvalsh(lap) == pytest.approx(want)


def test_trees_take_equal_points_and_samples(spark):
    rows = [(k, [1.0, 2.0]) for k in range(300)] + [(k, [float(k % 17), float(k % 5)]) for k in range(300, 500)]
    p = spark.createDataFrame(rows, "i long, x array<double>")
    for options in ({"bucket": 20, "tables": 4}, {"bucket": 20, "tables": 4, "sample": 50}, {"bucket": 1000}):
        got = knn.knn_approx(p, 5, **options).collect()
        assert all(r.i != r.j and 1 <= r.rank <= 5 for r in got) and len({(r.i, r.j) for r in got}) == len(got)
        assert len({r.i for r in got}) >= 495
    tree = knn.Tree(np.ones((50, 3)), 5, np.random.default_rng(0))
    assert tree.sizes == [50] and set(tree.leaves(np.random.default_rng(1).normal(size=(9, 3)))) == {0}
    x = np.random.default_rng(2).normal(size=(400, 3))
    tree = knn.Tree(x, 25, np.random.default_rng(0))
    assert np.bincount(tree.leaves(x)).tolist() == tree.sizes and max(tree.sizes) <= 25
    assert knn.knn_approx(p.limit(0), 5).count() == 0


def test_recall_of_trees(spark):
    p = gen.blobs(spark, 6000, 16, 5).select("i", "x")
    true = knn.knn_exact(p, 10, queries=p.where("i % 30 = 0"))
    assert true.select("i").distinct().count() == 200
    assert knn.recall(knn.knn_approx(p, 10, tables=6, bucket=200).where("i % 30 = 0"), true).first()["recall"] > 0.95


def test_ranks_count_ties_by_id(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (40, 2)).astype(float)
    p = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "i long, x array<double>")
    pairs = [(i, j) for i in range(40) for j in range(40) if i != j and (i + j) % 3 == 0]
    got = {(r.i, r.j): r.r for r in quality.neighbour_ranks(p, spark.createDataFrame(pairs, "i long, j long"), block=9).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i, j in pairs:
        order = sorted((k for k in range(40) if k != i), key=lambda k: (d[i, k], k))
        assert got[i, j] == order.index(j) + 1


def test_positions_and_ranges_by_blocks(spark):
    cents = spark.createDataFrame([(a, f, float((a * 7 + f * 3) % 5)) for a in range(6) for f in range(3)], "label int, f int, v double")
    x = np.array([[(a * 7 + f * 3) % 5 for f in range(3)] for a in range(6)], dtype=float)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert {(r.a, r.b): r.w for r in multi.affinity(cents).collect()} == pytest.approx({(a, b): np.exp(-d2[a, b]) for a in range(6) for b in range(6)})
    got = {r.label: r.range for r in multi.data_ranges(cents.withColumnRenamed("f", "c")).collect()}
    assert got == pytest.approx({a: np.sqrt(d2[a][d2[a] > 0].min()) / 2 for a in range(6)})


def test_intermediate_tables_are_deleted(spark):
    before = lineage.made()
    a, b = lineage.written(spark.range(5), "one"), lineage.written(spark.range(6), "two")
    new = [p for p in lineage.made() if p not in before]
    assert len(new) == 2 and lineage.clear(spark, new[:1]) == 1 and b.count() == 6 and lineage.made() == [*before, new[1]]
    with pytest.raises(Exception):
        a.count()
    assert lineage.clear(spark, new) == 1 and lineage.made() == before
