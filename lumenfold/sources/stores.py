"""Reading and writing graphs, points, coordinates and metadata."""

from __future__ import annotations

import io
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_graph(spark: SparkSession, edges: str, vertices: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges (i, j, w) and vertices (i) from Parquet; without a vertex table, the ends of edges,
    which leaves isolated nodes out."""
    e = spark.read.parquet(edges).select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("w").cast("float"))
    if vertices:
        return e, spark.read.parquet(vertices).select(F.col("i").cast("long"))
    return e, e.select("i").unionByName(e.select(F.col("j").alias("i"))).distinct()


def _npz(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """Arrays of an npz file, through Spark's own reader, so that any store will do."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    with zipfile.ZipFile(io.BytesIO(row["content"])) as z:
        return {name.removesuffix(".npy"): np.lib.format.read_array(io.BytesIO(z.read(name)), allow_pickle=False) for name in z.namelist()}


def read_dense(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(i, x array<double>) from one array of an npz file; a vector has arrays of one."""
    a = _npz(spark, path)
    if key not in a:
        raise KeyError(f"{path} has no {key}")
    x = np.atleast_1d(a[key])
    x = x.reshape(len(x), -1).astype(np.float64)
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, x array<double>")


def read_csr(spark: SparkSession, path: str, kind: str = "float") -> tuple[DataFrame, DataFrame]:
    """Edges and vertices from a CSR npz (data, indices, indptr, shape) of 32- or 64-bit numbers.

    The arrays become one row of arrays, and Spark explodes them.
    """
    a = _npz(spark, path)
    for name in ("data", "indices", "indptr", "shape"):
        if name not in a:
            raise KeyError(f"{path} has no {name}")
    if a["data"].dtype.kind != "f" or a["indices"].dtype.kind not in "iu" or a["indptr"].dtype.kind not in "iu":
        raise TypeError("data must be floats, indices and indptr whole numbers")
    n = int(a["shape"][0])
    ptr = a["indptr"].astype(int)
    rows = [(i, a["indices"][ptr[i] : ptr[i + 1]].astype(int).tolist(), a["data"][ptr[i] : ptr[i + 1]].astype(float).tolist()) for i in range(n)]
    table = spark.createDataFrame(rows, "i long, js array<long>, ws array<double>")
    edges = table.select("i", F.inline(F.arrays_zip("js", "ws"))).select("i", F.col("js").alias("j"), F.col("ws").cast(kind).alias("w"))
    return edges, table.select("i")


def to_csr(edges: DataFrame, n: int) -> dict[str, np.ndarray]:
    """CSR arrays of a graph that fits the driver: the form in which other tools take graphs."""
    p = edges.orderBy("i", "j").toPandas()
    return {"data": p["w"].to_numpy(np.float32), "indices": p["j"].to_numpy(np.int32), "indptr": np.searchsorted(p["i"], np.arange(n + 1)).astype(np.int32), "shape": np.array([n, n], dtype=np.int32), "format": np.array("csr")}


def write_npz(spark: SparkSession, path: str, arrays: dict[str, np.ndarray]) -> None:
    """An npz file through Spark's file systems, so that any store will do."""
    out = io.BytesIO()
    np.savez(out, **arrays)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # A local file goes without Hadoop's checksum beside it, which another writer would not renew.
    stream = (fs.getRaw() if fs.getScheme() == "file" else fs).create(target, True)
    try:
        stream.write(out.getvalue())
    finally:
        stream.close()


def write_csr(edges: DataFrame, n: int, path: str) -> None:
    write_npz(edges.sparkSession, path, to_csr(edges, n))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Points, edges or coordinates as Parquet, one folder for each value of ``by``."""
    out = df.write.mode("overwrite")
    (out.partitionBy(by) if by else out).parquet(path)


def write_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_all(graphs: dict[str, tuple[DataFrame, DataFrame]], folder: str, embed, dims: int = 2) -> list[str]:
    """Embed each named graph into folder/name; the names that failed, if any, end in an error
    after all have been tried."""
    done, failed = [], []
    for name, (edges, vertices) in graphs.items():
        try:
            write_table(embed(edges, vertices, dims), f"{folder}/{name}")
            done.append(name)
        except ValueError as e:
            failed.append(f"{name}: {e}")
    if failed:
        raise RuntimeError("; ".join(failed))
    return done


def validate_files(spark: SparkSession, expected: dict[str, int], least_bytes: int = 1, header: bool = True) -> DataFrame:
    """(path, rows, expected, bytes, ok) of text files against the rows that they should have."""
    rows = []
    for path, want in expected.items():
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
        n = spark.read.text(path).count() - header
        rows.append((path, n, want, size, n == want and size >= least_bytes))
    return spark.createDataFrame(rows, "path string, rows long, expected long, bytes long, ok boolean")


def read_test_timings(spark: SparkSession, path: str) -> DataFrame:
    """(name, seconds) of the test cases of JUnit XML files."""
    fields = "_classname string, _name string, _time double"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(fields).load(path)
    return cases.select(F.concat_ws("::", "_classname", "_name").alias("name"), F.col("_time").alias("seconds"))


def upsert_manifest(old: DataFrame, new: DataFrame, key: str = "dataset") -> DataFrame:
    """New entries, and the old ones that have not been made again."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
