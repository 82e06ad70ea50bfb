"""Registered queries over the test tables, each with SQL for a second engine where SQL can express it.

The points are ``embeddings``: x is the whole vector, y its first two numbers (a stand-in for an
embedding), z the third and fourth (for places).  Figures are rounded to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import quality, spectral
from lumenfold.operators import components as comp
from lumenfold.operators import fuzzy, knn, laplacian, multi, prep, selection
from lumenfold.operators.lineage import cut, shared_path
from lumenfold.plans import embed, solvers
from lumenfold.plans.config import ComputeMode, SpectralConfig
from lumenfold.sources import generators, report, stores

K = 15
#: Degrees in double precision, with which the least eigenvalue is 0 to 1e-15.
NATIVE = SpectralConfig(compute_mode=ComputeMode.NATIVE)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(name: str, alias: str | None = None):
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[_r(c) if c in names else F.col(c) for c in df.columns])


def _points(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = F.transform("embedding", lambda v: v.cast("double"))
    return t.select(F.col("vec_id").alias("i"), x.alias("x"), F.slice(x, 1, 2).alias("y"), F.slice(x, 3, 2).alias("z"), F.col("label").cast("int").alias("label"))


def _x(p: DataFrame) -> DataFrame:
    return p.select("i", "x")


def _y(p: DataFrame) -> DataFrame:
    return p.select("i", F.col("y").alias("x"))


def _z(p: DataFrame) -> DataFrame:
    return p.select("i", F.col("z").alias("x"))


def _labels(p: DataFrame) -> DataFrame:
    return p.select("i", "label")


def _graph(p: DataFrame) -> DataFrame:
    return fuzzy.fuzzy_graph(_x(p), K, "exact")


def _nearest_graph(p: DataFrame) -> DataFrame:
    """Edges between nearest neighbours in y: many small components."""
    near = cut(knn.knn_exact(_y(p), 1)).select("i", "j", F.lit(1.0).cast("float").alias("w"))
    return near.unionByName(fuzzy.transpose(near)).distinct()


def _vectors(p: DataFrame, n: int = 4) -> DataFrame:
    """(i, c, v): the first n numbers of each point."""
    return p.select("i", F.posexplode(F.slice("x", 1, n)).alias("c", "v"))


# Pieces of SQL that stand for the operators above, each resting on those before it.
_PTS = """pts AS (SELECT vec_id AS i, list_transform(embedding, lambda v: v::DOUBLE) AS x, list_transform(embedding[1:2], lambda v: v::DOUBLE) AS y,
  list_transform(embedding[3:4], lambda v: v::DOUBLE) AS z, label::INTEGER AS label FROM embeddings)"""


def _knn_sql(name: str, column: str, k: int) -> str:
    return f"""{name} AS (SELECT i, rank, j, dist FROM (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank
  FROM (SELECT a.i, b.i AS j, list_distance(a.{column}, b.{column}) AS dist FROM pts a JOIN pts b ON a.i <> b.i)) WHERE rank <= {k})"""


_SEARCH = f"""gaps AS (SELECT i, min(dist) AS rho, avg(dist) AS mean, list(dist ORDER BY dist) AS d FROM knn GROUP BY i),
search AS (SELECT i, rho, mean, list_transform(d, lambda v: v - rho) AS g, 0 AS step, 0.0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS mid FROM gaps
  UNION ALL SELECT i, rho, mean, g, step + 1, CASE WHEN s > log2({K}) THEN lo ELSE mid END, CASE WHEN s > log2({K}) THEN mid ELSE hi END,
    CASE WHEN s > log2({K}) THEN (lo + mid) / 2 WHEN isinf(hi) THEN mid * 2 ELSE (mid + hi) / 2 END
  FROM (SELECT *, list_sum(list_transform(g, lambda v: CASE WHEN v > 0 THEN exp(-v / mid) ELSE 1.0 END)) AS s FROM search WHERE step < {fuzzy.STEPS})),
smooth AS (SELECT i, rho, greatest(mid, {fuzzy.FLOOR} * CASE WHEN rho > 0 THEN mean ELSE (SELECT avg(dist) FROM knn) END) AS sigma FROM search WHERE step = {fuzzy.STEPS})"""
_DIRECTED = "directed AS (SELECT k.i, k.j, CASE WHEN dist <= rho THEN 1.0 ELSE exp(-(dist - rho) / sigma) END AS w FROM knn k JOIN smooth s ON k.i = s.i)"
_UNION = """fuzzy AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0) AS w
  FROM directed a FULL JOIN directed b ON a.i = b.j AND a.j = b.i)"""
_PRUNED = "pruned AS (SELECT i, j, w::FLOAT AS w FROM fuzzy WHERE w >= (SELECT max(w) FROM fuzzy) / (SELECT CASE WHEN count(*) <= 10000 THEN 500 ELSE 200 END FROM pts))"
_DEG = "deg AS (SELECT p.i, coalesce(d, 0) AS deg, sqrt(coalesce(d, 0)) AS sqrt_deg, CASE WHEN coalesce(d, 0) > 0 THEN 1 / sqrt(d) ELSE 0 END AS inv FROM pts p LEFT JOIN (SELECT i, sum(w::DOUBLE) AS d FROM pruned GROUP BY i) s ON p.i = s.i)"
_LAP = "lap AS (SELECT e.i, e.j, -a.inv * e.w::DOUBLE * b.inv AS l FROM pruned e JOIN deg a ON e.i = a.i JOIN deg b ON e.j = b.i WHERE e.i <> e.j UNION ALL SELECT i, i, 1.0 FROM pts)"
_NEAREST = _knn_sql("one", "y", 1) + ", near AS (SELECT i, j FROM one UNION SELECT j, i FROM one)"
_REACH = """reach AS (SELECT i, i AS r FROM pts UNION SELECT n.j, c.r FROM reach c JOIN near n ON c.i = n.i),
least AS (SELECT i, min(r) AS least FROM reach GROUP BY i), comp AS (SELECT i, (dense_rank() OVER (ORDER BY least) - 1)::INTEGER AS label FROM least)"""
_VEC = "vec AS (SELECT i, unnest(range(0, 4))::INTEGER AS c, unnest(x[1:4]) AS v FROM pts)"
_GRAPH_PARTS = [_PTS, _knn_sql("knn", "x", K), _SEARCH, _DIRECTED, _UNION, _PRUNED, _DEG, _LAP]


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def _to(n: int) -> str:
    return _with(*_GRAPH_PARTS[:n])


_Y_KNN, _X_KNN, _Z_KNN = _knn_sql("ky", "y", K), _knn_sql("kx", "x", K), _knn_sql("kz", "z", K)


# Neighbour graphs.


@_query(_to(2) + "SELECT i, rank::INTEGER AS rank, j, round(dist, 6) AS dist FROM knn")
def knn_exact(spark, sf):
    return _rounded(knn.knn_exact(_x(_points(spark, sf)), K), "dist")


_MANY = 20_000


@_query(f"SELECT {_MANY}::BIGINT AS points, {_MANY // 20 * K}::BIGINT AS pairs, true AS recall_ok")
def knn_approx_recall(spark, sf):
    """Default parameters over 20,000 points, far beyond a bucket; every twentieth is held against exact search."""
    p = cut(generators.blobs(spark, _MANY, 64, 10).select("i", "x"))
    asked = F.col("i") % 20 == 0
    true = cut(knn.knn_exact(p, K, queries=p.where(asked)))
    found = knn.recall(knn.knn_approx(p, K).where(asked), true)
    return found.select(F.lit(p.count()).alias("points"), F.lit(true.count()).alias("pairs"), (F.col("recall") >= 0.9).alias("recall_ok"))


@_query(_to(2) + "SELECT i, rank::INTEGER AS rank, j, round(dist, 6) AS dist FROM knn")
def knn_auto(spark, sf):
    return _rounded(knn.knn(_x(_points(spark, sf)), K), "dist")


@_query(_to(3) + "SELECT i, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM smooth")
def smooth_knn(spark, sf):
    return _rounded(fuzzy.smooth_knn(cut(knn.knn_exact(_x(_points(spark, sf)), K)), K), "rho", "sigma")


def _directed(p: DataFrame) -> DataFrame:
    near = cut(knn.knn_exact(_x(p), K))
    return fuzzy.membership(near, fuzzy.smooth_knn(near, K))


@_query(_to(4) + "SELECT i, j, round(w, 6) AS w FROM directed WHERE w > 0")
def membership(spark, sf):
    return _rounded(_directed(_points(spark, sf)), "w")


@_query(_to(5) + "SELECT i, j, round(w, 6) AS w FROM fuzzy WHERE w > 0")
def fuzzy_union(spark, sf):
    return _rounded(fuzzy.fuzzy_union(_directed(_points(spark, sf))), "w")


@_query(_to(6) + "SELECT i, j, round(w::DOUBLE, 5) AS w FROM pruned")
def prune_edges(spark, sf):
    return _graph(_points(spark, sf)).select("i", "j", F.round(F.col("w").cast("double"), 5).alias("w"))


@_query(_to(4) + "SELECT j AS i, i AS j, round(w, 6) AS w FROM directed WHERE w > 0")
def transpose_edges(spark, sf):
    return _rounded(fuzzy.transpose(_directed(_points(spark, sf))), "w")


@_query(_to(4) + "SELECT i, j, round(sum(w), 6) AS w FROM (SELECT i, j, w FROM directed UNION ALL SELECT j, i, w FROM directed) GROUP BY i, j")
def coalesce_duplicates(spark, sf):
    d = cut(_directed(_points(spark, sf)))
    return _rounded(fuzzy.coalesce_duplicates(d.unionByName(fuzzy.transpose(d))), "w")


@_query(_to(6) + "SELECT round(max(abs(a.w::DOUBLE - coalesce(b.w::DOUBLE, 0))), 6) AS max_diff, max(abs(a.w::DOUBLE - coalesce(b.w::DOUBLE, 0))) < 1e-10 AS symmetric FROM pruned a LEFT JOIN pruned b ON a.i = b.j AND a.j = b.i")
def symmetry_check(spark, sf):
    return _rounded(fuzzy.asymmetry(_graph(_points(spark, sf))), "max_diff")


@_query(_to(6) + "SELECT i, count(*) AS degree, string_agg(j::VARCHAR, ',' ORDER BY j) AS js FROM pruned GROUP BY i")
def adjacency_rows(spark, sf):
    a = fuzzy.adjacency(_graph(_points(spark, sf)))
    return a.select("i", F.size("nbrs").cast("bigint").alias("degree"), F.array_join(F.transform("nbrs", lambda e: e["j"].cast("string")), ",").alias("js"))


@_query(_to(4) + "SELECT i, round(sum(w), 5) AS total, abs(sum(w) - log2(15)) < 1e-6 AS on_target FROM directed GROUP BY i")
def bandwidth_targets(spark, sf):
    """The weights of every point's neighbours add up to log2(k)."""
    sums = _directed(_points(spark, sf)).groupBy("i").agg(F.sum("w").alias("s"))
    return sums.select("i", F.round("s", 5).alias("total"), (F.abs(F.col("s") - F.log2(F.lit(float(K)))) < 1e-6).alias("on_target"))


# Laplacians.


@_query(_to(7) + "SELECT i, round(deg, 6) AS deg, round(sqrt_deg, 6) AS sqrt_deg FROM deg")
def degrees_native(spark, sf):
    p = _points(spark, sf)
    return _rounded(laplacian.degrees(_graph(p), p), "deg", "sqrt_deg")


@_query(_to(6) + "SELECT i, round(d, 5) AS deg, round(sqrt(d), 5) AS sqrt_deg FROM (SELECT p.i, coalesce(d, 0)::DOUBLE AS d FROM pts p LEFT JOIN (SELECT j, list_reduce(list(w ORDER BY i), lambda a, b: (a + b)::FLOAT) AS d FROM pruned GROUP BY j) s ON p.i = s.j)")
def degrees_compat(spark, sf):
    p = _points(spark, sf)
    return laplacian.degrees(_graph(p), p, "compat").select("i", F.round("deg", 5).alias("deg"), F.round("sqrt_deg", 5).alias("sqrt_deg"))


@_query(_to(7) + "SELECT i, round(inv, 6) AS inv FROM deg")
def inverse_sqrt_degrees(spark, sf):
    p = _points(spark, sf)
    return _rounded(laplacian.with_inverse(laplacian.degrees(_graph(p), p)), "inv")


def _lap(p: DataFrame) -> DataFrame:
    e = cut(_graph(p))
    return laplacian.laplacian(e, laplacian.degrees(e, p))


@_query(_to(8) + "SELECT i, j, round(l, 6) AS l FROM lap")
def normalized_laplacian(spark, sf):
    return _rounded(_lap(_points(spark, sf)), "l")


@_query(_to(8) + "SELECT i, j, round(CASE WHEN i = j THEN 2 - l ELSE -l END, 6) AS l FROM lap")
def two_i_minus_laplacian(spark, sf):
    return _rounded(laplacian.two_i_minus(_lap(_points(spark, sf))), "l")


@_query(_to(8) + "SELECT i, j, round(CASE WHEN i = j THEN l + 0.0001 ELSE l END, 6) AS l FROM lap")
def shifted_laplacian(spark, sf):
    return _rounded(laplacian.shifted(_lap(_points(spark, sf)), 1e-4), "l")


@_query(_to(8) + "SELECT l.i, round(sum(l * p.x[1]), 6) AS y FROM lap l JOIN pts p ON l.j = p.i GROUP BY l.i")
def spmv(spark, sf):
    p = _points(spark, sf)
    return _rounded(laplacian.spmv(_lap(p), p.select("i", F.col("x")[0].alias("x"))), "y")


@_query(_to(8) + ", " + _VEC + "SELECT l.i, v.c, round(sum(l * v.v), 6) AS y FROM lap l JOIN vec v ON l.j = v.i GROUP BY l.i, v.c")
def spmm(spark, sf):
    p = _points(spark, sf)
    y = laplacian.spmm(_lap(p), p.select("i", F.slice("x", 1, 4).alias("x")), 4)
    return y.select("i", F.posexplode("y").alias("c", "y")).select("i", "c", _r("y"))


# Connectivity.


@_query(_with(_PTS, _NEAREST, _REACH) + "SELECT i, label FROM comp")
def connected_components(spark, sf):
    p = _points(spark, sf)
    return comp.components(_nearest_graph(p), p)


@_query(_with(_PTS, _NEAREST, _REACH) + "SELECT label, count(*) AS members, string_agg(i::VARCHAR, ',' ORDER BY i) AS ids FROM comp GROUP BY label")
def component_members(spark, sf):
    p = _points(spark, sf)
    m = comp.component_members(comp.components(_nearest_graph(p), p))
    return m.select("label", F.size("members").cast("bigint").alias("members"), F.array_join("members", ",").alias("ids"))


@_query(_with(_PTS, _NEAREST, _REACH) + ", loc AS (SELECT i, label, row_number() OVER (PARTITION BY label ORDER BY i) - 1 AS li FROM comp) SELECT a.label, a.li, b.li AS lj, 1.0::DOUBLE AS w FROM near n JOIN loc a ON n.i = a.i JOIN loc b ON n.j = b.i WHERE a.label = b.label")
def component_subgraphs(spark, sf):
    p = _points(spark, sf)
    e = cut(_nearest_graph(p))
    return comp.subgraphs(e, comp.components(e, p)).select("label", "li", "lj", F.col("w").cast("double").alias("w"))


_SAME = "(SELECT count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) FROM (SELECT DISTINCT {x} AS x, {y} AS y FROM comp JOIN pts USING (i)))"
_PARTITIONS = {"renamed": "(comp.label * 7919) % 1000003", "halved": "comp.label // 2", "classes": "pts.label", "least moved": "CASE WHEN i = (SELECT min(i) FROM pts) THEN -1 ELSE comp.label END"}


@_query(_with(_PTS, _NEAREST, _REACH) + " UNION ALL ".join(f"SELECT '{name}' AS other, {_SAME.format(x='comp.label', y=y)} AS same" for name, y in _PARTITIONS.items()))
def partition_equality(spark, sf):
    """Components against other labellings of the same nodes, only the first of which is the same partition."""
    p = cut(_points(spark, sf))
    a = cut(comp.components(_nearest_graph(p), p))
    least = p.agg(F.min("i")).first()[0]
    others = {
        "renamed": a.select("i", (F.col("label") * 7919 % 1000003).alias("label")),
        "halved": a.select("i", F.floor(F.col("label") / 2).alias("label")),
        "classes": _labels(p),
        "least moved": a.select("i", F.when(F.col("i") == least, -1).otherwise(F.col("label")).alias("label")),
    }
    parts = [comp.same_partition(a, b).select(F.lit(name).alias("other"), "same") for name, b in others.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Placing components.


@_query("WITH l AS (SELECT DISTINCT label::INTEGER AS label FROM embeddings) SELECT label, c::INTEGER AS c, (CASE WHEN c = label % 5 THEN CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END ELSE 0.0 END)::DOUBLE AS v FROM l, range(0, 5) t(c)")
def orthogonal_meta(spark, sf):
    return multi.orthogonal_meta(_labels(_points(spark, sf)), 5)


_CENT = "cent AS (SELECT label, f::INTEGER AS f, avg(v) AS v FROM (SELECT label, unnest(range(0, len(x))) AS f, unnest(x) AS v FROM pts) GROUP BY label, f)"


@_query(_with(_PTS, _CENT) + "SELECT label, f, round(v, 6) AS v FROM cent")
def component_centroids(spark, sf):
    p = _points(spark, sf)
    return _rounded(multi.centroids(_x(p), _labels(p)), "v")


_AFF = "aff AS (SELECT a.label AS a, b.label AS b, exp(-sum((a.v - b.v) * (a.v - b.v))) AS w FROM cent a JOIN cent b ON a.f = b.f GROUP BY a.label, b.label)"


@_query(_with(_PTS, _CENT, _AFF) + "SELECT a, b, round(w, 6) AS w FROM aff")
def centroid_affinity(spark, sf):
    p = _points(spark, sf)
    return _rounded(multi.affinity(multi.centroids(_x(p), _labels(p))), "w")


@_query(_with(_PTS, _CENT, _AFF) + ", d AS (SELECT a, sum(w) AS d FROM aff WHERE a <> b GROUP BY a) SELECT f.a AS i, f.b AS j, round(-w / sqrt(p.d) / sqrt(q.d), 6) AS l FROM aff f JOIN d p ON f.a = p.a JOIN d q ON f.b = q.a WHERE f.a <> f.b UNION ALL SELECT a, a, 1.0 FROM d")
def meta_laplacian(spark, sf):
    p = _points(spark, sf)
    return _rounded(multi.meta_laplacian(multi.affinity(multi.centroids(_x(p), _labels(p)))), "l")


@_query(_with(_PTS, _CENT) + ", d AS (SELECT a.label, b.label AS other, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM cent a JOIN cent b ON a.f = b.f AND a.label <> b.label GROUP BY a.label, b.label) SELECT label, round(min(d) FILTER (WHERE d > 0) / 2, 6) AS range FROM d GROUP BY label")
def data_ranges(spark, sf):
    p = _points(spark, sf)
    meta = multi.centroids(_x(p), _labels(p)).select("label", F.col("f").alias("c"), "v")
    return _rounded(multi.data_ranges(meta), "range")


# Coordinates.

_LAM = [(0, 0.3), (1, 0.1), (2, 0.4), (3, 0.2)]
_LAM_SQL = "lam AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, {v}::DOUBLE)" for c, v in _LAM) + ") t(c, lam))"


def _lam(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LAM, "c int, lam double")


@_query(_with(_PTS, _VEC, _LAM_SQL) + "SELECT v.i, (o.rank - 2)::INTEGER AS c, round(v.v, 6) AS v FROM vec v JOIN (SELECT c, row_number() OVER (ORDER BY lam, c) AS rank FROM lam) o ON v.c = o.c WHERE o.rank BETWEEN 2 AND 3")
def select_eigenvectors(spark, sf):
    return _rounded(selection.select_eigenvectors(_lam(spark), _vectors(_points(spark, sf)), 2), "v")


@_query(_with(_PTS, _VEC) + "SELECT v.i, v.c, round(CASE WHEN lead < 0 THEN -v ELSE v END, 6) AS v FROM vec v JOIN (SELECT DISTINCT c, first_value(v) OVER (PARTITION BY c ORDER BY abs(v) DESC, i) AS lead FROM vec) l ON v.c = l.c")
def normalize_signs(spark, sf):
    return _rounded(selection.normalize_signs(_vectors(_points(spark, sf))), "v")


@_query(_with(_PTS, _VEC) + "SELECT i, c, round((v * (10.0::DOUBLE / (SELECT max(abs(v)) FROM vec)))::FLOAT::DOUBLE, 5) AS v FROM vec")
def scale_coordinates(spark, sf):
    return selection.scale_coords(_vectors(_points(spark, sf))).select("i", "c", F.round(F.col("v").cast("double"), 5).alias("v"))


@_query()
def noisy_coordinates(spark, sf):
    return selection.add_noise(selection.scale_coords(_vectors(_points(spark, sf))))


@_query(_with(_PTS, _VEC) + "SELECT i, v.c, round((v - lo) * 10 / (hi - lo), 6) AS v FROM vec v JOIN (SELECT c, min(v) AS lo, max(v) AS hi FROM vec GROUP BY c) m ON v.c = m.c")
def min_max_coordinates(spark, sf):
    return _rounded(selection.min_max(_vectors(_points(spark, sf))), "v")


# Spectral metrics.

_RES = "prod AS (SELECT l.i, v.c, sum(l.l * v.v) AS y FROM lap l JOIN vec v ON l.j = v.i GROUP BY l.i, v.c), res AS (SELECT v.c, sqrt(sum((y - lam * v) * (y - lam * v))) / greatest(sqrt(sum(v * v)), 1e-300) AS residual FROM vec v JOIN prod p ON v.i = p.i AND v.c = p.c JOIN lam ON lam.c = v.c GROUP BY v.c)"


@_query(_with(*_GRAPH_PARTS, _VEC, _LAM_SQL, _RES) + "SELECT c, round(residual, 6) AS residual FROM res")
def eigenpair_residuals(spark, sf):
    p = _points(spark, sf)
    return _rounded(spectral.residuals(_lap(p), _lam(spark), _vectors(p)), "residual")


@_query(_with(*_GRAPH_PARTS, _VEC, _LAM_SQL, _RES) + "SELECT round(max(residual), 6) AS max_residual FROM res")
def max_eigenpair_residual(spark, sf):
    p = _points(spark, sf)
    return _rounded(spectral.max_residual(_lap(p), _lam(spark), _vectors(p)), "max_residual")


@_query(_with(_PTS, _VEC) + "SELECT round(sqrt(sum(d * d)), 6) AS orthogonality_error FROM (SELECT a.c, b.c, sum(a.v * b.v) - CASE WHEN a.c = b.c THEN 1 ELSE 0 END AS d FROM vec a JOIN vec b ON a.i = b.i GROUP BY a.c, b.c)")
def orthogonality_error(spark, sf):
    return _rounded(spectral.orthogonality_error(_vectors(_points(spark, sf))), "orthogonality_error")


@_query(_with(_LAM_SQL) + "SELECT bool_and(lam BETWEEN -1e-12 AND 2 + 1e-12) AS in_bounds, bool_and(coalesce(lam >= b - 1e-12, true)) AS is_sorted FROM (SELECT lam, lag(lam) OVER (ORDER BY c) AS b FROM lam)")
def eigenvalue_bounds(spark, sf):
    return spectral.eigenvalue_bounds(_lam(spark))


@_query(_with(_PTS) + """, long AS (SELECT i, label, unnest(range(0, 2)) AS c, unnest(y) AS v FROM pts), cents AS (SELECT label, c, avg(v) AS m FROM long GROUP BY label, c),
spread AS (SELECT max(d) AS s FROM (SELECT i, sqrt(sum((v - m) * (v - m))) AS d FROM long l JOIN cents USING (label, c) GROUP BY i)),
gap AS (SELECT min(d) AS g FROM (SELECT a.label, b.label, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM cents a JOIN cents b ON a.c = b.c AND a.label < b.label GROUP BY a.label, b.label))
SELECT round(g / s, 6) AS separation_ratio FROM spread, gap""")
def separation_ratio(spark, sf):
    p = _points(spark, sf)
    return _rounded(spectral.separation_ratio(p.select("i", F.posexplode("y").alias("c", "v")), _labels(p)), "separation_ratio")


@_query(_with(_LAM_SQL) + "SELECT c, round(abs(lam - (lam * 1.01 + 0.001)), 6) AS abs_error, round(abs(lam - (lam * 1.01 + 0.001)) / abs(lam * 1.01 + 0.001), 6) AS rel_error FROM lam")
def eigenvalue_errors(spark, sf):
    lam = _lam(spark)
    return _rounded(spectral.eigenvalue_errors(lam, lam.select("c", (F.col("lam") * 1.01 + 0.001).alias("lam"))), "abs_error", "rel_error")


_GRAM = "n AS (SELECT c, sqrt(sum(v * v)) AS n FROM vec GROUP BY c), g AS (SELECT a.c AS a, b.c - 2 AS b, sum(a.v * b.v) / (any_value(p.n) * any_value(q.n)) AS g FROM vec a JOIN vec b ON a.i = b.i JOIN n p ON a.c = p.c JOIN n q ON b.c = q.c WHERE a.c < 2 AND b.c >= 2 GROUP BY a.c, b.c)"


@_query(_with(_PTS, _VEC, _GRAM) + "SELECT round(abs(sum(g) FILTER (WHERE a = 0 AND b = 0) * sum(g) FILTER (WHERE a = 1 AND b = 1) - sum(g) FILTER (WHERE a = 0 AND b = 1) * sum(g) FILTER (WHERE a = 1 AND b = 0)), 6) AS det FROM g")
def subspace_gram_det(spark, sf):
    v = _vectors(_points(spark, sf))
    return _rounded(spectral.subspace_det(v.where("c < 2"), v.where("c >= 2").select("i", (F.col("c") - 2).alias("c"), "v")), "det")


@_query(_with(_PTS, _VEC, _GRAM) + """, m AS (SELECT sum(g * g) AS f, abs(sum(g) FILTER (WHERE a = 0 AND b = 0) * sum(g) FILTER (WHERE a = 1 AND b = 1) - sum(g) FILTER (WHERE a = 0 AND b = 1) * sum(g) FILTER (WHERE a = 1 AND b = 0)) AS d FROM g)
SELECT round(d, 6) AS det_kd, round(acos(sqrt((f - sqrt(f * f - 4 * d * d)) / 2)), 5) AS max_angle FROM m""")
def subspace_angles(spark, sf):
    """For two columns the singular values follow from the sum of squares and the determinant."""
    v = _vectors(_points(spark, sf))
    a, b = v.where("c < 2"), v.where("c >= 2").select("i", (F.col("c") - 2).alias("c"), "v")
    return spark.createDataFrame([(round(spectral.subspace_det_kd(a, b), 6), round(spectral.max_principal_angle(a, b), 5))], "det_kd double, max_angle double")


@_query(_with(_PTS, _VEC) + "SELECT round(max(e), 6) AS max_error FROM (SELECT a.c, least(max(abs(a.v - b.v)), max(abs(a.v + b.v))) AS e FROM vec a JOIN vec b ON a.i = b.i AND b.c = a.c + 2 GROUP BY a.c)")
def sign_agnostic_error(spark, sf):
    v = _vectors(_points(spark, sf))
    return _rounded(spectral.sign_agnostic_error(v.where("c < 2"), v.where("c >= 2").select("i", (F.col("c") - 2).alias("c"), "v")), "max_error")


@_query(_with(_LAM_SQL) + "SELECT round(max(lam) FILTER (WHERE c = 1) - max(lam) FILTER (WHERE c = 0), 6) AS spectral_gap, round(max(lam) FILTER (WHERE c = 3) / max(lam) FILTER (WHERE c = 1), 6) AS condition_number FROM lam")
def spectrum(spark, sf):
    return _rounded(spectral.spectrum(_lam(spark)), "spectral_gap", "condition_number")


@_query(_with(*_GRAPH_PARTS) + "SELECT round(max(abs(y - z)), 6) AS max_abs, round(sqrt(avg((y - z) * (y - z))), 6) AS rms FROM (SELECT l.i, sum(l * p.x[1]) AS y, sum(l * p.x[2]) AS z FROM lap l JOIN pts p ON l.j = p.i GROUP BY l.i)")
def product_divergence(spark, sf):
    p = _points(spark, sf)
    lap = cut(_lap(p))
    y = [laplacian.spmv(lap, p.select("i", F.col("x")[c].alias("x"))) for c in (0, 1)]
    return _rounded(spectral.product_divergence(*y), "max_abs", "rms")


@_query(_with(*_GRAPH_PARTS, _VEC, _LAM_SQL, _RES) + "SELECT c, round(1e-5::DOUBLE / residual, 9) AS margin FROM res")
def tolerance_margins(spark, sf):
    p = _points(spark, sf)
    return spectral.margins(spectral.residuals(_lap(p), _lam(spark), _vectors(p)), spectral.LOBPCG_GATE).select("c", F.round("margin", 9).alias("margin"))


_SOLVES = [("ring", 900, 10_000, 4.9e-6), ("blobs", 120, 75_000, 0.01)]


@_query("SELECT name, iterations * nnz * 2.220446049250313e-16::DOUBLE / gap AS bound FROM (VALUES " + ", ".join(f"('{a}', {b}, {c}, {d}::DOUBLE)" for a, b, c, d in _SOLVES) + ") t(name, iterations, nnz, gap)")
def rotation_bounds(spark, sf):
    return spectral.rotation_bounds(spark.createDataFrame(_SOLVES, "name string, iterations long, nnz long, gap double"))


@_query("SELECT vec_id AS i, 1::BIGINT AS ulps FROM embeddings")
def ulp_distances(spark, sf):
    """One step up from each number is one double away."""
    p = _points(spark, sf).select("i", F.abs(F.col("x")[0]).alias("a"))
    return spectral.ulp_distances(p.select("i", "a", _next_up("a").alias("b")))


def _next_up(name: str):
    @F.pandas_udf("double")
    def up(v: pd.Series) -> pd.Series:
        return pd.Series(np.nextafter(v.to_numpy(), np.inf))

    return up(name)


# Embedding quality.


def _ranks_sql(space: str, near: str, name: str) -> str:
    return f""", d AS (SELECT a.i, b.i AS j, list_distance(a.{space}, b.{space}) AS dist FROM pts a JOIN pts b ON a.i <> b.i),
r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM d), n AS (SELECT count(*) AS n FROM pts)
SELECT round(1 - 2.0::DOUBLE / (max(n) * {K} * (2 * max(n) - 3 * {K} - 1)) * sum(greatest(r - {K}, 0)), 6) AS {name} FROM {near} k JOIN r ON k.i = r.i AND k.j = r.j, n"""


@_query(_with(_PTS, _Y_KNN) + _ranks_sql("x", "ky", "trustworthiness"))
def trustworthiness(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.trustworthiness(_x(p), knn.knn_exact(_y(p), K), K), "trustworthiness")


@_query(_with(_PTS, _X_KNN) + _ranks_sql("y", "kx", "continuity"))
def continuity(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.continuity(_y(p), knn.knn_exact(_x(p), K), K), "continuity")


@_query(_with(_PTS) + """, d AS (SELECT a.i, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM pts a JOIN pts b ON true GROUP BY a.i, a.label, b.label),
e AS (SELECT i, max(s / (n - 1)) FILTER (WHERE other = label) AS a, min(s / n) FILTER (WHERE other <> label) AS b, max(n) FILTER (WHERE other = label) AS size FROM d GROUP BY i)
SELECT round(avg(CASE WHEN size < 2 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM e""")
def silhouette(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.silhouette(_x(p), _labels(p)), "silhouette")


_PAIRS = "pairs AS (SELECT list_distance(a.x, b.x) AS da, list_distance(a.y, b.y) AS db FROM pts a JOIN pts b ON a.i < b.i)"
_RANKS = "ranked AS (SELECT da, db, rank() OVER (ORDER BY da) + (count(*) OVER (PARTITION BY da) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY db) + (count(*) OVER (PARTITION BY db) - 1) / 2.0::DOUBLE AS rb FROM pairs)"


@_query(_with(_PTS, _PAIRS) + "SELECT round(corr(da, db), 6) AS distance_correlation FROM pairs")
def distance_correlation(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.distance_correlation(_x(p), _y(p)), "distance_correlation")


@_query(_with(_PTS, _PAIRS, _RANKS) + "SELECT round(corr(ra, rb), 6) AS distance_rank_correlation FROM ranked")
def distance_rank_correlation(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.distance_rank_correlation(_x(p), _y(p)), "distance_rank_correlation")


@_query(_with(_PTS, _PAIRS, _RANKS) + "SELECT round(corr(da, db), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM ranked")
def shepard(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.shepard(_x(p), _y(p)), "pearson", "spearman")


@_query(_with(_PTS) + """, m AS (SELECT avg(y[1]) AS a, avg(y[2]) AS b, avg(z[1]) AS c, avg(z[2]) AS d FROM pts), q AS (SELECT y[1] - a AS a, y[2] - b AS b, z[1] - c AS c, z[2] - d AS d FROM pts, m),
s AS (SELECT sum(a * c) AS ac, sum(a * d) AS ad, sum(b * c) AS bc, sum(b * d) AS bd, sum(a * a + b * b) AS p, sum(c * c + d * d) AS q FROM q)
SELECT round(1 - (ac * ac + ad * ad + bc * bc + bd * bd + 2 * abs(ac * bd - ad * bc)) / (p * q), 6) AS procrustes FROM s""")
def procrustes(spark, sf):
    """In two dimensions the square of the sum of singular values is the sum of squares and twice the determinant."""
    p = _points(spark, sf)
    return spark.createDataFrame([(round(quality.procrustes(_y(p), _z(p)), 6),)], "procrustes double")


_SETS = ", s AS (SELECT a.i, list(a.j) AS p FROM kz a GROUP BY a.i), t AS (SELECT i, list(j) AS q FROM ky GROUP BY i)"


@_query(_with(_PTS, _Z_KNN, _Y_KNN) + _SETS + "SELECT round(avg(len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q)))), 6) AS neighbour_agreement FROM s JOIN t ON s.i = t.i")
def neighbour_agreement(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.neighbour_agreement(knn.knn_exact(_z(p), K), knn.knn_exact(_y(p), K), K), "neighbour_agreement")


@_query(_with(_PTS, _Z_KNN, _Y_KNN) + _SETS + f"SELECT round(avg(len(list_intersect(p, q)) / {K}.0::DOUBLE), 6) AS neighbour_preservation FROM s JOIN t ON s.i = t.i")
def neighbour_preservation(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.neighbour_preservation(knn.knn_exact(_z(p), K), knn.knn_exact(_y(p), K), K), "neighbour_preservation")


@_query(_with(_PTS, _knn_sql("k6", "z", 6)) + """, v AS (SELECT i, unnest(range(0, 2))::INTEGER AS c, unnest(y) AS v FROM pts), m AS (SELECT c, avg(v) AS m, count(*) AS n FROM v GROUP BY c),
q AS (SELECT i, v.c, n, v - m AS z FROM v JOIN m ON v.c = m.c), num AS (SELECT a.c, sum(a.z * b.z) AS num, count(*) AS w FROM k6 k JOIN q a ON k.i = a.i JOIN q b ON k.j = b.i AND a.c = b.c GROUP BY a.c)
SELECT num.c, round(max(n)::DOUBLE / max(w) * max(num) / sum(z * z), 6) AS morans_i FROM num JOIN q ON num.c = q.c GROUP BY num.c""")
def morans_i(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.morans_i(_y(p), knn.knn_exact(_z(p), 6)), "morans_i")


@_query(_with(_PTS) + "SELECT round(avg(d), 6) AS chaos FROM (SELECT a.i, min(list_distance(a.z, b.z)) AS d FROM pts a JOIN pts b ON a.label = b.label AND a.i <> b.i GROUP BY a.i)")
def chaos(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.chaos(_z(p), _labels(p)), "chaos")


@_query(_with(_PTS, _knn_sql("k10", "z", 10)) + "SELECT round(avg(CASE WHEN s < 1 - 0.6::DOUBLE THEN 1.0 ELSE 0.0 END), 6) AS pas FROM (SELECT k.i, avg(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0.0 END) AS s FROM k10 k JOIN pts a ON k.i = a.i JOIN pts b ON k.j = b.i GROUP BY k.i)")
def pas(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.pas(knn.knn_exact(_z(p), 10), _labels(p)), "pas")


def _clusters(p: DataFrame) -> DataFrame:
    """A second labelling: the quadrant of y."""
    return p.select("i", (F.when(F.col("y")[0] > 0, 1).otherwise(0) + F.when(F.col("y")[1] > 0, 2).otherwise(0)).alias("label"))


_TAB = "tab AS (SELECT label AS a, CASE WHEN y[1] > 0 THEN 1 ELSE 0 END + CASE WHEN y[2] > 0 THEN 2 ELSE 0 END AS b, count(*) AS n FROM pts GROUP BY ALL)"


@_query(_with(_PTS, _TAB) + """, s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM tab) AS ij, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM tab GROUP BY a)) AS ra,
(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM tab GROUP BY b)) AS rb, (SELECT sum(n) FROM tab) AS n)
SELECT round((ij - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)), 6) AS ari FROM s""")
def adjusted_rand_index(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.adjusted_rand(_labels(p), _clusters(p)), "ari")


@_query(_with(_PTS, _TAB) + """, t AS (SELECT sum(n) AS t FROM tab), ha AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT sum(n) AS n FROM tab GROUP BY a), t), hb AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT sum(n) AS n FROM tab GROUP BY b), t),
hab AS (SELECT -sum(n / t * ln(n / t)) AS h FROM tab, t) SELECT round(2 * (ha.h + hb.h - hab.h) / (ha.h + hb.h), 6) AS nmi FROM ha, hb, hab""")
def normalized_mutual_information(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.normalized_mutual_information(_labels(p), _clusters(p)), "nmi")


@_query(_with(_PTS, _TAB) + "SELECT round(sum(top) / sum(n), 6) AS purity FROM (SELECT max(n) AS top, sum(n) AS n FROM tab GROUP BY b)")
def cluster_purity(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.purity(_clusters(p), _labels(p)), "purity")


@_query(_with(_PTS, _TAB) + "SELECT round(sum(top) / sum(n), 6) AS purity FROM (SELECT max(n) AS top, sum(n) AS n FROM tab GROUP BY a)")
def type_purity(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.purity(_clusters(p), _labels(p), by="type"), "purity")


def _hash_sql(key: str, seed: int = 42) -> str:
    return f"((((({key}) % {prep.HASH_MOD}) + {seed} + 1) * {prep.HASH_MUL}) % {prep.HASH_MOD}) * {prep.HASH_MUL} % {prep.HASH_MOD}"


@_query(_with(_PTS) + f""", num AS (SELECT x, y, row_number() OVER (ORDER BY i) - 1 AS k, least(5000, count(*) OVER ()) AS n FROM pts QUALIFY k < 5000),
t AS (SELECT {_hash_sql('id * 3')} % n AS p, {_hash_sql('id * 3 + 1')} % n AS q, {_hash_sql('id * 3 + 2')} % n AS r FROM range(0, 50000) g(id), (SELECT max(n) AS n FROM num))
SELECT round(avg(CASE WHEN (list_distance(a.x, b.x) < list_distance(a.x, c.x)) = (list_distance(a.y, b.y) < list_distance(a.y, c.y)) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS triplet_accuracy
FROM t JOIN num a ON t.p = a.k JOIN num b ON t.q = b.k JOIN num c ON t.r = c.k WHERE p <> q AND p <> r AND q <> r""")
def triplet_accuracy(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.triplet_accuracy(_x(p), _y(p)), "triplet_accuracy")


@_query(_with(_PTS) + """, c AS (SELECT label, 0 AS s, f, avg(v) AS m FROM (SELECT label, unnest(range(0, len(x))) AS f, unnest(x) AS v FROM pts) GROUP BY label, f
UNION ALL SELECT label, 1, f, avg(v) FROM (SELECT label, unnest(range(0, 2)) AS f, unnest(y) AS v FROM pts) GROUP BY label, f),
d AS (SELECT a.s, a.label, b.label AS other, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM c a JOIN c b ON a.s = b.s AND a.f = b.f AND a.label < b.label GROUP BY a.s, a.label, b.label),
r AS (SELECT s, label, other, rank() OVER (PARTITION BY s ORDER BY d) + (count(*) OVER (PARTITION BY s, d) - 1) / 2.0::DOUBLE AS r FROM d)
SELECT round(corr(p.r, q.r), 6) AS centroid_correlation FROM r p JOIN r q ON p.label = q.label AND p.other = q.other AND p.s = 0 AND q.s = 1""")
def centroid_correlation(spark, sf):
    p = _points(spark, sf)
    return _rounded(quality.centroid_correlation(_x(p), _y(p), _labels(p)), "centroid_correlation")


_RUNS = [("a", "ours", 0.01, 0.995, 0.002, 0.01), ("a", "random", 0.2, 0.4, 0.3, 0.2), ("b", "ours", 0.02, 0.999, -0.004, -0.02), ("b", "random", 0.01, 0.992, 0.001, 0.0), ("c", "ours", 0.06, 0.999, 0.0, 0.0)]
_RUNS_SQL = "runs AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE, {e}::DOUBLE, {f}::DOUBLE)" for a, b, c, d, e, f in _RUNS) + ") t(dataset, init, procrustes, distance_correlation, trust_drift, silhouette_drift)), judged AS (SELECT *, procrustes < 0.05 AS procrustes_ok, distance_correlation > 0.99 AS correlation_ok, abs(trust_drift) < 0.01 AS trust_ok, abs(silhouette_drift) < 0.05 AS silhouette_ok, procrustes < 0.05 AND distance_correlation > 0.99 AND abs(trust_drift) < 0.01 AND abs(silhouette_drift) < 0.05 AS overall FROM runs)"


def _judged(spark: SparkSession) -> DataFrame:
    return quality.verdicts(spark.createDataFrame(_RUNS, "dataset string, init string, procrustes double, distance_correlation double, trust_drift double, silhouette_drift double"))


@_query("WITH " + _RUNS_SQL + " SELECT * FROM judged")
def comparison_verdicts(spark, sf):
    return _judged(spark)


@_query("WITH " + _RUNS_SQL + " SELECT dataset FROM judged GROUP BY dataset HAVING bool_or(overall AND init <> 'random') AND bool_or(overall AND init = 'random')")
def too_easy_datasets(spark, sf):
    return quality.too_easy(_judged(spark))


_TIMES = [(200, 1531.6, 1289.5, 5000.0), (2000, 14900.9, 13569.5, 60000.0), (5000, 37573.7, 39349.8, 90000.0)]


@_query("SELECT *, round(baseline_ns / variant_ns, 6) AS speedup, CASE WHEN baseline_ns > variant_ns THEN ceil(setup_ns / (baseline_ns - variant_ns))::DOUBLE END AS break_even FROM (VALUES " + ", ".join(f"({n}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in _TIMES) + ") t(n, baseline_ns, variant_ns, setup_ns)")
def benchmark_speedups(spark, sf):
    return _rounded(quality.speedups(spark.createDataFrame(_TIMES, "n int, baseline_ns double, variant_ns double, setup_ns double")), "speedup")


@_query("SELECT (l_linenumber % 6)::BIGINT AS level, round(count(*)::DOUBLE / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1")
def solver_level_shares(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_linenumber") % 6).cast("bigint").alias("level"))
    return _rounded(quality.level_shares(t), "share")


@_query("SELECT n_name AS name, n_nationkey * 0.5::DOUBLE AS seconds FROM nation ORDER BY seconds DESC, name")
def slowest_first(spark, sf):
    t = spark.read.parquet(f"{sf}/nation.parquet")
    return quality.slowest(t.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 0.5).alias("seconds")))


# Preparation of feature tables: cells are orders, features line numbers or suppliers.


def _values(spark: SparkSession, sf: str, feature: str = "l_linenumber") -> DataFrame:
    """One row for each cell and feature."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet")
    return t.groupBy(F.col("l_orderkey").cast("bigint").alias("cell"), F.col(feature).cast("bigint").alias("feature")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def _vals_sql(feature: str = "l_linenumber") -> str:
    return f"WITH vals AS (SELECT l_orderkey::BIGINT AS cell, {feature}::BIGINT AS feature, sum(l_quantity::DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"


@_query(_vals_sql() + " SELECT cell, feature, round(CASE WHEN s <> 0 THEN value * 1000 / s ELSE value END, 6) AS value FROM (SELECT *, sum(value) OVER (PARTITION BY cell) AS s FROM vals)")
def normalize_total(spark, sf):
    return _rounded(prep.normalize_total(_values(spark, sf)), "value")


@_query(_vals_sql() + " SELECT cell, feature, round(ln(1 + value), 6) AS value FROM vals")
def log1p_values(spark, sf):
    return _rounded(prep.log1p(_values(spark, sf)), "value")


@_query(_vals_sql() + " SELECT cell, feature, round(log2(1 + value), 6) AS value FROM vals")
def log2_values(spark, sf):
    return _rounded(prep.log1p(_values(spark, sf), base2=True), "value")


@_query(_vals_sql() + " SELECT cell, feature, round(least(CASE WHEN coalesce(s, 0) > 0 THEN (value - m) / s ELSE 0 END, 10), 6) AS value FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_samp(value) OVER (PARTITION BY feature) AS s FROM vals)")
def zscore_clip(spark, sf):
    return _rounded(prep.zscore_clip(_values(spark, sf)), "value")


@_query(_vals_sql() + " SELECT cell, run, feature, round(value * o / r, 6) AS value FROM (SELECT *, cell % 5 AS run, avg(value) OVER (PARTITION BY cell % 5) AS r, avg(value) OVER () AS o FROM vals)")
def run_mean_normalize(spark, sf):
    return _rounded(prep.run_mean_normalize(_values(spark, sf).withColumn("run", F.col("cell") % 5)), "value")


@_query(_vals_sql("l_suppkey") + """, d AS (SELECT feature, avg(value) AS mean, CASE WHEN avg(value) <> 0 THEN var_samp(value) / avg(value) ELSE 0 END AS dispersion FROM vals GROUP BY feature),
b AS (SELECT *, ntile(20) OVER (ORDER BY mean, feature) AS bin FROM d), s AS (SELECT bin, avg(dispersion) AS m, stddev_samp(dispersion) AS s FROM b GROUP BY bin),
n AS (SELECT feature, dispersion, CASE WHEN coalesce(s, 0) > 0 THEN (dispersion - m) / s ELSE 0 END AS norm_dispersion FROM b JOIN s ON b.bin = s.bin)
SELECT feature, round(dispersion, 6) AS dispersion, round(norm_dispersion, 6) AS norm_dispersion FROM n ORDER BY norm_dispersion DESC, feature LIMIT 50""")
def highly_variable(spark, sf):
    top = prep.highly_variable(_values(spark, sf, "l_suppkey"), 50)
    return _rounded(top, "dispersion", "norm_dispersion")


@_query()
def principal_components(spark, sf):
    return prep.pca(_x(_points(spark, sf)), 10)


@_query(_with(_PTS) + ", o AS (SELECT x AS o FROM pts ORDER BY i LIMIT 1) SELECT i, round(list_distance(x, o), 6) AS dist FROM pts, o")
def principal_components_isometry(spark, sf):
    """All components together keep every distance from the first point."""
    p = cut(prep.pca(_x(_points(spark, sf)), 64))
    first = p.orderBy("i").limit(1).select(F.col("x").alias("o"))
    d = F.aggregate(F.zip_with("x", "o", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    return p.join(F.broadcast(first)).select("i", F.round(F.sqrt(d), 6).alias("dist"))


@_query(_with(_PTS) + """, f AS (SELECT i, unnest(range(0, len(x))) AS f, unnest(x) AS v FROM pts), t AS (SELECT sum(s) AS t FROM (SELECT var_samp(v) AS s FROM f GROUP BY f))
SELECT round(t, 6) AS total, 0.0::DOUBLE AS worst_correlation, true AS descending FROM t""")
def principal_components_variance(spark, sf):
    """The variances of the components descend and add up to those of the features; components are uncorrelated."""
    long = cut(prep.pca(_x(_points(spark, sf)), 64).select("i", F.posexplode("x").alias("c", "v")))
    each = long.groupBy("c").agg(F.var_samp("v").alias("s"))
    total = each.agg(F.round(F.sum("s"), 6).alias("total"))
    ordered = each.agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("o")).select(
        F.forall(F.sequence(F.lit(1), F.size("o") - 1), lambda k: F.col("o")[k - 1]["s"] >= F.col("o")[k]["s"] - 1e-9).alias("descending")
    )
    near = long.select("i", (F.col("c") + 1).alias("c"), F.col("v").alias("u"))
    pairs = long.join(near, ["i", "c"]).groupBy("c").agg(F.abs(F.corr("u", "v")).alias("r")).agg(F.round(F.max("r"), 6).alias("worst_correlation"))
    return total.join(pairs).join(ordered)


@_query(_with(_PTS) + f"SELECT i FROM (SELECT i, row_number() OVER (ORDER BY {_hash_sql('i')}, i) AS k FROM pts) WHERE k <= 100")
def random_sample(spark, sf):
    return prep.random_sample(_points(spark, sf).select("i"), 100)


@_query(_with(_PTS) + f""", s AS (SELECT min(y[1]) AS x0, max(y[1]) AS x1, min(y[2]) AS y0, max(y[2]) AS y1, count(*) AS n FROM pts),
g AS (SELECT i, n, least(9, floor((y[1] - x0) / (x1 - x0) * 10))::INTEGER AS gx, least(9, floor((y[2] - y0) / (y1 - y0) * 10))::INTEGER AS gy, {_hash_sql('i')} AS h FROM pts, s),
r AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY h, i) AS k, count(*) OVER (PARTITION BY gx, gy) AS m FROM g)
SELECT i, gx, gy FROM (SELECT *, row_number() OVER (ORDER BY h, i) AS o FROM r WHERE k <= greatest(1, round(m * 120::DOUBLE / n))) WHERE o <= 120""")
def stratified_sample(spark, sf):
    cells = _points(spark, sf).select("i", F.col("y")[0].alias("x"), F.col("y")[1].alias("y"))
    return prep.stratified_sample(cells, 120, grid=10).select("i", "gx", "gy")


_SWEEP = [("k5", 0.9, 0.3, 0.02), ("k10", 0.95, 0.1, 0.5), ("k15", 0.88, 0.25, 0.04), ("k30", 0.5, 0.5, 0.9)]


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _SWEEP) + ") t(run, trustworthiness, silhouette, spectral_gap) WHERE trustworthiness > 0.85 AND silhouette > 0.2 ORDER BY spectral_gap DESC, run LIMIT 1")
def sweep_winner(spark, sf):
    return prep.sweep_winner(spark.createDataFrame(_SWEEP, "run string, trustworthiness double, silhouette double, spectral_gap double"))


# Sources.


def _both_ways(once: str) -> str:
    return f"WITH e AS ({once}) SELECT i, j, w FROM e UNION ALL SELECT j, i, w FROM e"


def _edges(graph: generators.Graph) -> DataFrame:
    return graph[0].select("i", "j", F.round(F.col("w").cast("double"), 6).alias("w"))


@_query(_both_ways("SELECT i, (i + d) % 100 AS j, 1.0::DOUBLE AS w FROM range(0, 100) a(i), range(1, 3) b(d)"))
def ring_graph(spark, sf):
    return _edges(generators.ring(spark, 100, 2))


@_query(_both_ways("SELECT i, i + 1 AS j, 1.0::DOUBLE AS w FROM range(0, 99) a(i)"))
def path_graph(spark, sf):
    return _edges(generators.path(spark, 100))


@_query(_both_ways("SELECT i, i + 1 AS j, round(greatest(pow(0.5, i), 1e-6)::FLOAT::DOUBLE, 6) AS w FROM range(0, 99) a(i)"))
def exponential_path_graph(spark, sf):
    return _edges(generators.exponential_path(spark, 100))


@_query(_both_ways("SELECT i, j, 1.0::DOUBLE AS w FROM range(0, 20) a(i), range(0, 20) b(j) WHERE i < j"))
def complete_graph(spark, sf):
    return _edges(generators.complete(spark, 20))


@_query(_both_ways("SELECT i, j, CASE WHEN i = 19 AND j = 20 THEN 0.25 ELSE 1.0 END::DOUBLE AS w FROM range(0, 40) a(i), range(0, 40) b(j) WHERE i < j AND (i // 20 = j // 20 OR (i = 19 AND j = 20))"))
def bridged_cliques_graph(spark, sf):
    return _edges(generators.bridged_cliques(spark, 20, 0.25))


@_query(_both_ways("SELECT 0::BIGINT AS i, j, 1.0::DOUBLE AS w FROM range(1, 50) a(j)"))
def star_graph(spark, sf):
    return _edges(generators.star(spark, 50))


@_query(_both_ways("SELECT i, j, 1.0::DOUBLE AS w FROM range(0, 10) a(i), range(10, 20) b(j)"))
def bipartite_graph(spark, sf):
    return _edges(generators.bipartite(spark, 10, 10))


@_query(_both_ways("SELECT i, j, 1.0::DOUBLE AS w FROM range(0, 30) a(i), range(0, 30) b(j) WHERE i < j AND (j < 10 OR (j = i + 1 AND i >= 9))"))
def lollipop_graph(spark, sf):
    return _edges(generators.lollipop(spark, 10, 20))


@_query(_both_ways("SELECT i, j, 1.0::DOUBLE AS w FROM range(0, 30) a(i), range(0, 30) b(j) WHERE i < j AND i // 3 = j // 3"))
def cliques_graph(spark, sf):
    return _edges(generators.cliques(spark, 10, 3))


@_query(_both_ways("SELECT 0::BIGINT AS i, 1::BIGINT AS j, 1.0::DOUBLE AS w"))
def single_edge_graph(spark, sf):
    return _edges(generators.single_edge(spark))


@_query(_both_ways("SELECT i, i + 1 AS j, 1.0::DOUBLE AS w FROM range(0, 99) a(i) WHERE i <> 49"))
def two_paths_graph(spark, sf):
    return _edges(generators.two_paths(spark, 50))


_ROOTED = "e AS (SELECT i, j FROM ring UNION ALL SELECT j, i FROM ring), d AS (SELECT i, count(*)::DOUBLE AS deg FROM e GROUP BY i)"


@_query("WITH ring AS (SELECT i, (i + d) % 2500 AS j FROM range(0, 2500) a(i), range(1, 4) b(d)), " + _ROOTED + " SELECT e.i, e.j, round(-1 / sqrt(a.deg * b.deg), 9) AS l, round(sqrt(a.deg), 9) AS root FROM e JOIN d a ON e.i = a.i JOIN d b ON e.j = b.i UNION ALL SELECT i, i, 1.0, round(sqrt(deg), 9) FROM d")
def laplacian_with_roots(spark, sf):
    """A Laplacian of 2,500 nodes and the square roots of its degrees."""
    lap, degs = generators.laplacian_with_roots(generators.ring(spark, 2500, 3))
    return lap.join(degs, "i").select("i", "j", F.round("l", 9).alias("l"), F.round("sqrt_deg", 9).alias("root"))


@_query("SELECT i, true AS on_sheet, true AS in_class FROM range(0, 400) t(i)")
def swiss_roll(spark, sf):
    """Without noise the radius is the angle, and a class is a fifth of the angle's range."""
    p = generators.swiss_roll(spark, 400, noise=0.0)
    x, y, z = (F.col("x")[k] for k in range(3))
    r = F.sqrt(x * x + z * z)
    angle = F.abs(F.cos(r) * r - x) + F.abs(F.sin(r) * r - z) < 1e-9
    fifth = F.floor((r / (1.5 * math.pi) - 1) / 2 * 5)
    return p.select("i", (angle & y.between(0, 21)).alias("on_sheet"), (fifth == F.col("label")).alias("in_class"))


@_query("SELECT i, (i + d + 50) % 50 AS j, CASE WHEN d = 0 THEN 1.0 ELSE -0.5 END::DOUBLE AS l FROM range(0, 50) a(i), range(-1, 2) b(d)")
def ring_laplacian(spark, sf):
    return generators.ring_laplacian(spark, 50)


@_query()
def synthetic_datasets(spark, sf):
    out = None
    for name in ("blobs_50", "moons_200", "circles_300", "near_dupes_100", "disconnected_200"):
        d = generators.dataset(spark, name).select(F.lit(name).alias("dataset"), "i", "x", "label")
        out = d if out is None else out.unionByName(d)
    return out.unionByName(generators.swiss_roll(spark, 200).select(F.lit("swiss_roll_200").alias("dataset"), "i", "x", "label"))


@_query("SELECT n_name AS dataset, 'old' AS made FROM nation WHERE n_nationkey >= 5 UNION ALL SELECT n_name, 'new' FROM nation WHERE n_nationkey < 5")
def manifest_upsert(spark, sf):
    old = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_name").alias("dataset"), F.lit("old").alias("made"), "n_nationkey")
    return stores.upsert_manifest(old.drop("n_nationkey"), old.where("n_nationkey < 5").select("dataset", F.lit("new").alias("made")))


# Files: written to the shared folder and read again.


@_query(_with(_PTS, _NEAREST) + "SELECT i, j, 1.0::DOUBLE AS w FROM near")
def graph_round_trip(spark, sf):
    """Edges and vertices as Parquet."""
    p, at = _points(spark, sf), shared_path(spark, "graph")
    stores.write_table(_nearest_graph(p), f"{at}/edges")
    stores.write_table(p.select("i"), f"{at}/vertices")
    edges, vertices = stores.read_graph(spark, f"{at}/edges", f"{at}/vertices")
    return edges.join(vertices, "i", "left_semi").select("i", "j", F.col("w").cast("double").alias("w"))


@_query("WITH e AS (SELECT i, (i + d) % 100 AS j, (1.0 / d)::FLOAT::DOUBLE AS w FROM range(0, 100) a(i), range(1, 4) b(d)) SELECT i, j, round(w, 6) AS w FROM e UNION ALL SELECT j, i, round(w, 6) FROM e")
def csr_round_trip(spark, sf):
    """A weighted ring as compressed rows in an npz file."""
    edges, _ = generators.ring(spark, 100, 3)
    d = F.least(F.pmod(F.col("j") - F.col("i"), F.lit(100)), F.pmod(F.col("i") - F.col("j"), F.lit(100)))
    path = f"{shared_path(spark, 'npz')}/graph.npz"
    stores.write_csr(edges.select("i", "j", (1 / d).cast("float").alias("w")), 100, path)
    return stores.read_csr(spark, path)[0].select("i", "j", F.round(F.col("w").cast("double"), 6).alias("w"))


@_query(_with(_PTS) + "SELECT row_number() OVER (ORDER BY i) - 1 AS i, round(y[1], 6) AS a, round(y[2], 6) AS b FROM pts")
def dense_npz_round_trip(spark, sf):
    """The points' first two numbers as a dense array in an npz file."""
    y = np.array([r["y"] for r in _points(spark, sf).orderBy("i").select("y").collect()])
    path = f"{shared_path(spark, 'npz')}/points.npz"
    stores.write_npz(spark, path, {"X": y, "n_samples": np.array(len(y))})
    x = stores.read_dense(spark, path, "X")
    return x.select("i", F.round(F.col("x")[0], 6).alias("a"), F.round(F.col("x")[1], 6).alias("b"))


@_query("SELECT n_name AS dataset, n_nationkey::BIGINT AS n, n_regionkey::BIGINT AS seed FROM nation")
def metadata_round_trip(spark, sf):
    at = f"{shared_path(spark, 'meta')}/meta"
    t = spark.read.parquet(f"{sf}/nation.parquet")
    stores.write_metadata(t.select(F.col("n_name").alias("dataset"), F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("seed")).coalesce(1), at)
    return spark.read.json(at).select("dataset", F.col("n").cast("bigint").alias("n"), F.col("seed").cast("bigint").alias("seed"))


@_query("SELECT 'nation' AS name, count(*) AS rows, count(*) AS expected, true AS ok FROM nation UNION ALL SELECT 'region', count(*), 7, count(*) = 7 FROM region")
def file_validation(spark, sf):
    """Text files with a header against the rows that they should have; the second claim is wrong."""
    at = shared_path(spark, "files")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").coalesce(1).write.csv(f"{at}/{name}", header=True)
    rows = spark.read.parquet(f"{sf}/nation.parquet").count()
    found = stores.validate_files(spark, {f"{at}/nation": rows, f"{at}/region": 7})
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "rows", "expected", "ok")


@_query("SELECT 'suite::' || n_name AS name, n_nationkey * 0.25::DOUBLE AS seconds FROM nation")
def junit_timings(spark, sf):
    """Test cases of JUnit XML."""
    at = f"{shared_path(spark, 'junit')}/xml"
    t = spark.read.parquet(f"{sf}/nation.parquet")
    case = F.concat(F.lit('<testcase classname="suite" name="'), F.col("n_name"), F.lit('" time="'), (F.col("n_nationkey") * 0.25).cast("string"), F.lit('"/>'))
    one = t.agg(F.concat(F.lit("<testsuite>"), F.array_join(F.collect_list(case), ""), F.lit("</testsuite>")).alias("value"))
    one.write.text(at)
    return stores.read_test_timings(spark, at)


@_query("SELECT dataset, i, true AS placed FROM (VALUES ('ring', 30), ('star', 12)) t(dataset, n), range(0, 30) r(i) WHERE i < n")
def embedding_sink(spark, sf):
    """Coordinates of named graphs, a folder for each."""
    at = shared_path(spark, "coordinates")
    graphs = {"ring": generators.ring(spark, 30, 2), "star": generators.star(spark, 12)}
    stores.export_all(graphs, at, lambda e, v, dims: embed.spectral_coordinates(cut(e), v, dims))
    parts = [spark.read.parquet(f"{at}/{name}").select(F.lit(name).alias("dataset"), "i", (F.size("coords") == 2).alias("placed")) for name in graphs]
    return parts[0].unionByName(parts[1])


@_query("SELECT r_name AS dataset, '{\"dataset\":\"' || r_name || '\",\"n\":' || count(*) || ',\"metrics\":[{\"name\":\"nations\",\"dimension\":0,\"value\":' || count(*) || '.0,\"threshold\":5.0,\"passed\":' || (count(*) <= 5) || '}]}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def report_json(spark, sf):
    t = spark.read.parquet(f"{sf}/nation.parquet").join(spark.read.parquet(f"{sf}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.groupBy("r_name").count().collect()
    return report.to_json(spark.createDataFrame([report.metric_row(r["r_name"], r["count"], "nations", r["count"], 5.0, r["count"] <= 5) for r in rows]))


# Solvers, on graphs whose spectrum is known.

_A, _B = 40, 51
_TORUS = f"torus AS (SELECT 1 - (cos(2 * pi() * i / {_A}) + cos(2 * pi() * j / {_B})) / 2 AS lam FROM range(0, {_A}) a(i), range(0, {_B}) b(j)), first AS (SELECT (row_number() OVER (ORDER BY lam) - 1)::INTEGER AS c, lam FROM torus)"


def _torus(spark: SparkSession) -> generators.Graph:
    edges, vertices = generators.torus(spark, _A, _B)
    return cut(edges), vertices


#: A graph of two sides, for the randomised solver, which needs a gap behind the first pair: 0, then 1 many times.
_SIDES = (4, 2044)
_BIPARTITE = "first AS (SELECT c::INTEGER AS c, CASE WHEN c = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS lam FROM range(0, 5) t(c))"


def _level_query(level: int) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        edges, vertices = _torus(spark) if level != 4 else generators.bipartite(spark, *_SIDES)
        n = _A * _B if level != 4 else sum(_SIDES)

        def solved(lap, root):
            pairs = solvers.run_level(level, lap, 4, 42, root, SpectralConfig(rsvd_power_iterations=8))
            return solvers.Solved(*pairs, level, solvers.worst_residual(lap, pairs))

        values, vectors = embed.level_pairs(cut(edges), vertices, n, solved, NATIVE)
        ortho = spectral.orthogonality_error(vectors)
        in_gate = F.col("residual") < float(min(solvers.GATES[level], solvers.RSVD_GATE))
        return values.join(ortho).select("c", F.abs(F.round("lam", 6)).alias("lam"), in_gate.alias("in_gate"), (F.col("orthogonality_error") < 1e-8).alias("orthonormal"), "level")

    run.__doc__ = f"Five smallest pairs of a graph of over 2,000 nodes by solver {level} alone."
    QUERIES[f"solver_level_{level}"] = run
    known = _TORUS if level != 4 else _BIPARTITE
    SQL[f"solver_level_{level}"] = f"WITH {known} SELECT c, abs(round(lam, 6)) AS lam, true AS in_gate, true AS orthonormal, {level} AS level FROM first WHERE c < 5"


for _level in range(6):
    _level_query(_level)


@_query(f"WITH {_TORUS} SELECT c, abs(round(lam, 6)) AS lam, 1 AS level FROM first WHERE c < 10")
def baseline_spectrum_torus(spark, sf):
    """The ten smallest eigenvalues by the chain, which settles at the block iteration."""
    edges, vertices = _torus(spark)
    _, values, _ = embed.eigenpairs(edges, vertices, 9, config=NATIVE)
    return values.select("c", F.abs(F.round("lam", 6)).alias("lam"), "level")


@_query("WITH cube AS (SELECT bit_count(i) / 4.0::DOUBLE AS lam FROM range(0, 256) t(i)), first AS (SELECT (row_number() OVER (ORDER BY lam) - 1)::INTEGER AS c, lam FROM cube) SELECT c, abs(round(lam, 5)) AS lam, true AS converged, 9 AS level FROM first WHERE c < 4")
def solver_in_dataframes(spark, sf):
    """The solver for graphs beyond a task, on a hypercube of 256 nodes."""
    v = spark.range(256).withColumnRenamed("id", "i")
    edges = v.select("i", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.col("i").bitwiseXOR(F.pow(F.lit(2), k).cast("long")))).alias("j"), F.lit(1.0).cast("float").alias("w"))
    _, values, _ = embed.eigenpairs(cut(edges), v, 3, config=SpectralConfig(compute_mode=ComputeMode.NATIVE, local_edges=100))
    return values.select("c", F.abs(F.round("lam", 5)).alias("lam"), (F.col("residual") < 1e-4).alias("converged"), "level")


@_query(f"""WITH {_TORUS}, s AS (SELECT max(lam) FILTER (WHERE c = 0) AS a, max(lam) FILTER (WHERE c = 1) AS b, max(lam) FILTER (WHERE c = 2) AS z FROM first)
SELECT name, round(value, 5) AS value, threshold, true AS passed FROM s, LATERAL (VALUES ('component_count_match', 1.0::DOUBLE, 1.0::DOUBLE), ('eigenvalues_in_bounds', 1.0, 1.0), ('eigenvalues_sorted', 1.0, 1.0),
('max_eigenpair_residual', 0.0, 0.01), ('orthogonality_error', 0.0, 1e-8), ('spectral_gap', b - a, 0.0)) t(name, value, threshold)""")
def accuracy_report_torus(spark, sf):
    """The gated report of a solve whose figures are known; the condition number and the margin depend on rounding and are left out."""
    edges, vertices = _torus(spark)
    lap, values, vectors = embed.eigenpairs(edges, vertices, 2, config=NATIVE)
    count = comp.components(edges, vertices).select("label").distinct().count()
    found = spectral.assess("torus", _A * _B, lap, values.select("c", "lam"), vectors, components=count, expected_components=1)
    known = F.when(F.col("name") == "max_eigenpair_residual", F.round("value", 4)).otherwise(F.round("value", 5))
    return found.where(~F.col("name").isin("condition_number", "residual_margin")).select("name", known.alias("value"), "threshold", "passed")


_ANGLE = 0.4


@_query("SELECT * FROM (VALUES ('0', 'vector', 0.0::DOUBLE), ('1,2', 'subspace', 0.0), ('3', 'vector', 0.001), ('4,5', 'subspace', 0.4)) t(columns, kind, error)")
def gap_aware_comparison(spark, sf):
    """Vectors of a ring against others: one negated, a pair turned within its plane, one moved, a pair turned out of it."""
    n = 64
    wave = lambda f, k: f(F.col("i") * (2 * math.pi * k / n)) * math.sqrt(2 / n)
    base = [F.lit(1 / math.sqrt(n)), wave(F.cos, 1), wave(F.sin, 1), wave(F.cos, 2), wave(F.cos, 3), wave(F.sin, 3)]
    c, s = math.cos(_ANGLE), math.sin(_ANGLE)
    turned = [-base[0], c * base[1] + s * base[2], c * base[2] - s * base[1], base[3] + F.when(F.col("i") == 5, 1e-3).otherwise(0.0), c * base[4] + s * wave(F.cos, 9), base[5]]
    rows = spark.range(n).withColumnRenamed("id", "i")
    a, b = (rows.select("i", F.posexplode(F.array(*v)).alias("c", "v")) for v in (base, turned))
    lam = spark.createDataFrame([(0, 0.0), (1, 0.1), (2, 0.1 + 1e-9), (3, 0.2), (4, 0.3), (5, 0.3 + 1e-8)], "c int, lam double")
    got = spectral.compare_eigenvectors(lam, a, b)
    return got.select(F.array_join(F.transform("columns", lambda x: x.cast("string")), ",").alias("columns"), "kind", F.round("error", 6).alias("error"))


# Embeddings.

_N = 200
_LINE = f"line AS (SELECT i, c::INTEGER AS c, CASE WHEN i IN (0, {_N - 1}) THEN 1 ELSE sqrt(2) END * cos(pi() * (c + 1) * i / {_N - 1}) AS v FROM range(0, {_N}) t(i), range(0, 2) u(c))"


@_query(f"WITH {_LINE} SELECT i, c, abs(round(v * 10 / (SELECT max(abs(v)) FROM line), 4)) AS v, sign(v) = sign(first_value(v) OVER (PARTITION BY c ORDER BY i)) AS like_first FROM line")
def spectral_coordinates_path(spark, sf):
    """Coordinates of a path, whose eigenvectors are cosines times roots of degrees, without noise.
    Odd ones have two entries of the largest size, so signs are told against the first node's."""
    edges, vertices = generators.path(spark, _N)
    x = embed.spectral_coordinates(cut(edges), vertices, 2, config=SpectralConfig(noise=1e-30))
    long = cut(x.select("i", F.posexplode("coords").alias("c", "v")))
    first = long.where("i = 0").select("c", F.signum("v").alias("s"))
    return long.join(first, "c").select("i", "c", F.abs(F.round(F.col("v").cast("double"), 4)).alias("v"), (F.signum("v") == F.col("s")).alias("like_first"))


_M = 60
_HALVES = f"""half AS (SELECT label, c::INTEGER AS c, i, CASE WHEN c = 1 THEN -1 ELSE 1 END * CASE WHEN i IN (0, {_M - 1}) THEN 1 ELSE sqrt(2) END * cos(pi() * (c + 1) * i / {_M - 1}) AS v FROM range(0, 2) l(label), range(0, {_M}) t(i), range(0, 2) u(c)),
put AS (SELECT label, c, v / (SELECT max(abs(v)) FROM half) * sqrt(2) / 2 + CASE WHEN c = label THEN 1 ELSE 0 END AS v FROM half)"""


@_query(f"WITH {_HALVES} SELECT label::INTEGER AS label, c, row_number() OVER (PARTITION BY label, c ORDER BY v)::INTEGER AS r, round(v * 10 / (SELECT max(abs(v)) FROM put), 3) AS v FROM put")
def spectral_coordinates_two_paths(spark, sf):
    """Two components at unit vectors, each within half their distance; sorted, since the signs of odd columns are open.  Those of even
    ones are not: the nodes in the middle, the largest, are positive."""
    edges, vertices = generators.two_paths(spark, _M)
    x = embed.spectral_coordinates(cut(edges), vertices, 2, config=SpectralConfig(noise=1e-30))
    long = x.select(F.floor(F.col("i") / _M).cast("int").alias("label"), F.posexplode("coords").alias("c", "v"))
    order = Window.partitionBy("label", "c").orderBy("v")
    return long.select("label", "c", F.row_number().over(order).alias("r"), F.round(F.col("v").cast("double"), 3).alias("v"))


@_query("SELECT count(*) AS nodes, 10.0::DOUBLE AS largest, true AS sign_ok, true AS repeatable, true AS finite FROM embeddings")
def spectral_coordinates_invariants(spark, sf):
    """On the data: every node is placed, the largest coordinate is 10 in size, each column's largest is
    positive, and another partitioning and order of the edges gives the same."""
    p = cut(_points(spark, sf))
    e, plain = cut(_graph(p)), SpectralConfig(noise=1e-30)
    a = cut(embed.spectral_coordinates(e, p.select("i"), 2, data=_x(p), config=plain))
    b = embed.spectral_coordinates(e.repartition(7, "w").sortWithinPartitions("w"), p.select("i").repartition(3), 2, data=_x(p), config=plain)
    long = a.select("i", F.posexplode("coords").alias("c", "v"))
    lead = long.groupBy("c").agg(F.max_by("v", F.abs("v")).alias("lead"))
    ok = lead.agg(F.bool_and(F.col("lead") > 0).alias("sign_ok"))
    size = long.agg(F.countDistinct("i").alias("nodes"), F.round(F.max(F.abs(F.col("v").cast("double"))), 4).alias("largest"), F.bool_and(~F.isnan("v")).alias("finite"))
    same = a.join(b.select("i", F.col("coords").alias("other")), "i", "full").agg(F.bool_and(F.col("coords") == F.col("other")).alias("repeatable"))
    return size.join(ok).join(same).select("nodes", "largest", "sign_ok", "repeatable", "finite")


@_query("SELECT n AS components, d::INTEGER AS dims, n > 2 * d AS by_affinity FROM range(1, 30) t(n), range(1, 5) u(d)")
def placement_rule(spark, sf):
    pairs = [(n, d, multi.spectral_meta_needed(n, d)) for n in range(1, 30) for d in range(1, 5)]
    return spark.createDataFrame(pairs, "components long, dims int, by_affinity boolean")


@_query("SELECT vec_id AS i, c::INTEGER AS c, true AS near, true AS repeatable FROM embeddings, range(0, 4) t(c)")
def noise_bounds(spark, sf):
    """Noise stays within a few of its deviations, and is the same for the same seed, node and column."""
    v = cut(selection.scale_coords(_vectors(_points(spark, sf))))
    a, b = selection.add_noise(v), selection.add_noise(v.repartition(5, "v"))
    both = a.join(b.select("i", "c", F.col("v").alias("u")), ["i", "c"]).join(v.select("i", "c", F.col("v").alias("o")), ["i", "c"])
    return both.select("i", "c", (F.abs(F.col("v") - F.col("o")) < 1e-3).alias("near"), (F.col("u") == F.col("v")).alias("repeatable"))


@_query()
def spectral_coordinates(spark, sf):
    p = _points(spark, sf)
    return embed.spectral_coordinates(cut(_graph(p)), p.select("i"), 2)


@_query()
def spectral_coordinates_disconnected(spark, sf):
    e, v = generators.cliques(spark, 10, 12)
    data = v.select("i", F.array((F.floor(F.col("i") / 12) * 0.3).cast("double"), (F.floor(F.col("i") / 12) % 3 * 0.2).cast("double")).alias("x"))
    return embed.spectral_coordinates(e, v, 2, data=data)


@_query("SELECT true AS residual_ok, true AS in_bounds, true AS is_sorted, true AS orthonormal, 3::BIGINT AS pairs")
def eigenpairs(spark, sf):
    p = _points(spark, sf)
    lap, values, vectors = embed.eigenpairs(cut(_graph(p)), p.select("i"), 2, config=NATIVE)
    worst = spectral.max_residual(lap, values.select("c", "lam"), vectors)
    ortho = spectral.orthogonality_error(vectors)
    bounds = spectral.eigenvalue_bounds(values, 1e-9)
    n = values.agg(F.count(F.lit(1)).alias("pairs"))
    return worst.join(ortho).join(bounds).join(n).select((F.col("max_residual") < 1e-4).alias("residual_ok"), "in_bounds", "is_sorted", (F.col("orthogonality_error") < 1e-8).alias("orthonormal"), "pairs")


@_query()
def baseline_spectrum(spark, sf):
    p = _points(spark, sf)
    _, values, _ = embed.eigenpairs(cut(_graph(p)), p.select("i"), 9, config=NATIVE)
    return values.select("c", "lam", "level")


@_query()
def accuracy_report(spark, sf):
    p = _points(spark, sf)
    e = cut(_graph(p))
    lap, values, vectors = embed.eigenpairs(e, p.select("i"), 2, config=NATIVE)
    count = comp.components(e, p).select("label").distinct().count()
    return spectral.assess("embeddings", p.count(), lap, values.select("c", "lam"), vectors, components=count, expected_components=1)


@_query()
def accuracy_report_json(spark, sf):
    return report.to_json(accuracy_report(spark, sf))
