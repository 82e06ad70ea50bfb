import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lumenfold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ["nation", "lineitem", "embeddings", "documents", "pages", "labels"]


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(repr([float(f"{v:.9g}") if isinstance(v, float) else v for v in row]) for row in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["i", "coords"] and got.count() == 500


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.QUERIES) >= 80


#: A query of each kind; tools/compare.py holds all of them against their SQL.
SOME = ["smooth_knn", "degrees_compat", "connected_components", "data_ranges", "eigenpair_residuals", "silhouette", "cluster_purity", "zscore_clip", "stratified_sample", "lollipop_graph", "manifest_upsert", "csr_round_trip", "solver_level_4", "solver_in_dataframes", "spectral_coordinates_two_paths", "partition_equality", "gap_aware_comparison"]


@pytest.mark.parametrize("name", SOME)
def test_queries_match_their_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[1]
    for p in (root / "lumenfold").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"lumenfold[.\s]*(import\s+)?llm", p.read_text()), p
