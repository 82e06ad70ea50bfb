import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators.lineage import cut, shared_dir, written
from lumenfold.sources import generators as gen
from lumenfold.sources import report, stores
from lumenfold.streaming.degrees import running_degrees, windowed_degrees


def edges(df):
    return {(r.i, r.j): r.w for r in df.collect()}


def test_graph_tables(spark, tmp_path):
    e, v = gen.lollipop(spark, 4, 3)
    stores.write_table(e, str(tmp_path / "e"))
    stores.write_table(v, str(tmp_path / "v"))
    a, b = stores.read_graph(spark, str(tmp_path / "e"), str(tmp_path / "v"))
    assert edges(a) == edges(e) and b.count() == 7
    assert stores.read_graph(spark, str(tmp_path / "e"))[1].count() == 7


def test_npz(spark, tmp_path):
    e, v = gen.star(spark, 5)
    path = str(tmp_path / "g.npz")
    stores.write_csr(e, 6, path)
    a, b = stores.read_csr(spark, path)
    assert edges(a) == edges(e) and b.count() == 6
    for f, i in ((np.float64, np.int64), (np.float32, np.int32)):
        np.savez(path, data=np.array([2.0], f), indices=np.array([1], i), indptr=np.array([0, 1, 1], i), shape=np.array([2, 2]))
        assert edges(stores.read_csr(spark, path, "double")[0]) == {(0, 1): 2.0}
    np.savez(path, data=np.array([2]), indices=np.array([1]), indptr=np.array([0, 1, 1]), shape=np.array([2, 2]))
    with pytest.raises(TypeError):
        stores.read_csr(spark, path)
    np.savez(path, X=np.arange(6.0).reshape(3, 2), n=np.int32(3))
    assert [r.x for r in stores.read_dense(spark, path, "X").orderBy("i").collect()] == [[0, 1], [2, 3], [4, 5]]
    assert stores.read_dense(spark, path, "n").first()["x"] == [3]
    for f in (lambda: stores.read_dense(spark, path, "Y"), lambda: stores.read_csr(spark, path)):
        with pytest.raises(KeyError):
            f()


def test_metadata_manifest_validation(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"dataset": "a", "params": {"k": 15}}, indent=1))
    assert stores.read_metadata(spark, str(tmp_path / "m.json")).first()["params"]["k"] == 15
    stores.write_metadata(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "t.csv").write_text("h\n1\n2\n")
    good, bad = stores.validate_files(spark, {str(tmp_path / "t.csv"): 2}).first(), stores.validate_files(spark, {str(tmp_path / "t.csv"): 3}).first()
    assert good["ok"] and not bad["ok"]
    old = spark.createDataFrame([("a", 1), ("b", 1)], "dataset string, v int")
    assert sorted(map(tuple, stores.upsert_manifest(old, spark.createDataFrame([("b", 2), ("c", 2)], "dataset string, v int")).collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_timings_of_test_cases(spark, tmp_path):
    from lumenfold.functions.quality import slowest

    (tmp_path / "j.xml").write_text('<testsuites><testsuite name="s"><testcase classname="a" name="x" time="0.5"/><testcase classname="a" name="y" time="2.25"><failure/></testcase></testsuite></testsuites>')
    assert [tuple(r) for r in slowest(stores.read_test_timings(spark, str(tmp_path / "j.xml"))).collect()] == [("a::y", 2.25), ("a::x", 0.5)]


def test_export_all_collects_failures(spark, tmp_path):
    def embed(e, v, dims):
        if v.count() < 3:
            raise ValueError("too small")
        return v.select("i", F.array(F.lit(0.0)).alias("coords"))

    with pytest.raises(RuntimeError, match="b: too small"):
        stores.export_all({"a": gen.ring(spark, 5), "b": gen.single_edge(spark), "c": gen.star(spark, 4)}, str(tmp_path), embed)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 4
    assert stores.export_all({"a": gen.ring(spark, 5)}, str(tmp_path / "x"), embed) == ["a"]


def test_reports(spark, tmp_path):
    r = spark.createDataFrame([report.metric_row("d", 5, "b", 0.5, 1, True), report.metric_row("d", 5, "a", 2, 0, False)])
    assert [m["name"] for m in json.loads(report.to_json(r).first()["json"])["metrics"]] == ["a", "b"]
    assert report.to_markdown(r).splitlines()[2].startswith("| d | 5 | a | 0 | 2 | 0 | False")
    with pytest.raises(ValueError):
        report.to_markdown(r, most=1)
    report.write_json(r, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1


def test_generators(spark):
    for name in gen.DATASETS:
        d = gen.dataset(spark, name)
        assert d.count() == gen.DATASETS[name][1]["n"] and d.where(F.exists("x", lambda v: v.isNull() | F.isnan(v))).count() == 0
    assert sorted(map(str, gen.moons(spark, 50).collect())) == sorted(map(str, gen.moons(spark, 50).repartition(7).collect()))
    near = gen.near_duplicates(spark, 100).where("label = 1").select(F.abs(F.col("x")[0] - 50).alias("d"))
    assert near.count() == 10 and near.agg(F.max("d")).first()[0] <= 3e-7
    apart = gen.disconnected(spark, 200).groupBy("label").agg(F.avg(F.col("x")[0]).alias("m"), F.count("*").alias("n")).orderBy("label").collect()
    assert [r.n for r in apart] == [50] * 4 and all(abs(r.m - 100 * r.label) < 1 for r in apart)
    assert {r["count"] for r in gen.swiss_roll(spark, 1000).groupBy("label").count().collect()} >= set() and gen.swiss_roll(spark, 1000).select("label").distinct().count() == 5
    with pytest.raises(KeyError):
        gen.dataset(spark, "single_cell")
    sizes = {"ring": (gen.ring(spark, 10, 2), 40), "complete": (gen.complete(spark, 6), 30), "cliques": (gen.cliques(spark, 3, 4), 36), "two_paths": (gen.two_paths(spark, 5), 16), "bipartite": (gen.bipartite(spark, 2, 3), 12), "lollipop": (gen.lollipop(spark, 4, 2), 16), "bridge": (gen.bridged_cliques(spark, 3, 0.1), 14)}
    for (e, _), n in sizes.values():
        got = edges(e)
        assert len(got) == e.count() == n and all(got[j, i] == w for (i, j), w in got.items())
    assert gen.ring_laplacian(spark, 6).count() == 18 and gen.identity_laplacian(spark, 4).count() == 4


def test_lineage_uses_the_shared_folder(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert cut(spark.range(5)).count() == 5
    back = written(spark.range(5), "numbers")
    from pathlib import Path

    from lumenfold.operators.lineage import clear

    assert back.count() == 5 and back.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark))
    folder = Path(back.inputFiles()[0].removeprefix("file://")).parent
    assert clear(spark) >= 1 and not folder.exists()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 1.0, "2024-01-01 00:01:00"), (0, 2, 2.0, "2024-01-01 00:02:00"), (1, 2, 4.0, "2024-01-01 00:30:00")], "i long, j long, w double, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for df, name in ((running_degrees(stream), "running"), (windowed_degrees(stream), "windowed")):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert {r.i: r.deg for r in spark.table("running").collect()} == {0: 3.0, 1: 4.0}
    assert sorted((r.i, r.deg) for r in spark.table("windowed").collect()) == [(0, 3.0), (1, 4.0)]
