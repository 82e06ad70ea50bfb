"""The pipeline against a plain version of each stage, over all that its predecessor kept."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

import __spark_entry__ as entry
import corpus_pipeline
from lumenfold.llm import arrow, bpe_agenda, mixing, quality_fm
from lumenfold.llm.queries import LINE_PAGES, LINE_RATIO

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        if k < 4:
            assert docs.columns == COLUMNS
    return out


def test_quality_keeps_what_scores(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    fm = quality_fm.fit(spark.read.parquet(f"{SF}/documents.parquet"), labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0))
    f = quality_fm.Features(quality_fm.FMConfig())
    raw = quality_fm.raw_scores(fm, [f.of(r.text, r.n_chars) for r in stages[0]])
    assert sorted(r.doc_id for r in stages[1]) == sorted(r.doc_id for r, s in zip(stages[0], raw, strict=True) if 1 / (1 + np.exp(-s)) >= 0.3)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & {r.doc_id for r in stages[1]}) >= 0.97 * len(good)


def test_lines(stages):
    pages, count = Counter(), Counter()
    for r in stages[1]:
        pages[r.source] += 1
        for line in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
            count[r.source, line] += 1
    bad = {k for k, n in count.items() if n >= LINE_PAGES and n > LINE_RATIO * pages[k[0]]}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad) for r in stages[1]}
    assert {r.doc_id: r.text for r in stages[2]} == want
    assert all(r.n_chars == len(r.text) for r in stages[2])


def test_copies_are_no_boilerplate(spark):
    """A text that holds a third of a site's pages comes out whole, and one of its copies stays."""
    copied = "first copied line of many words\nsecond copied line of many words"
    rows = [(k, copied, "en", "s", len(copied)) for k in range(60)]
    rows += [(k, f"menu\nown line {k} with words {k * 7} and {k * 11}", "en", "s", 1) for k in range(100, 220)]
    rows += [(k, "menu\n" * (k % 2) + "shared", "en", "t", 1) for k in range(300, 304)] + [(400, None, "en", "s", None), (401, "menu", "en", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.lines(spark, docs, SF)
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {k: t if t is None or s is None or t == copied or s == "t" else t.removeprefix("menu\n") for k, t, _, s, _ in rows}
    assert [r.text for r in corpus_pipeline.near_duplicates(spark, out, SF).where("doc_id < 100").collect()] == [copied]


def test_near_duplicates(stages):
    from test_free import brute_classes

    classes = brute_classes([(r.doc_id, r.text) for r in stages[2]])
    assert sorted(r.doc_id for r in stages[3]) == sorted(i for i, c in classes.items() if i == c)


def test_mixture(stages):
    from test_native import water_filling

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in stages[3]}
    times = Counter(r.doc_id for r in stages[4])
    assert set(times) <= set(size) and max(times.values()) <= 2
    sources = sorted({r.source for r in stages[3]})
    total = [sum(size[r.doc_id] for r in stages[3] if r.source == s) for s in sources]
    goal = water_filling(total)
    for s, t in zip(sources, goal, strict=True):
        taken = sum(size[r.doc_id] for r in stages[4] if r.source == s)
        assert abs(taken - t) <= max(0.05 * t, 5)


def test_mixture_is_written_by_shard_and_place(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 9 + 1), "en", "abc"[k % 3], 1) for k in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixture(spark, docs, SF)
    want = [r.doc_id for r in mixing.mix(docs).orderBy("shard", "place").collect()]
    assert [r.doc_id for r in out.collect()] == want
    assert out.columns == COLUMNS


def test_tokens(stages):
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = []
    for r in stages[4]:
        ids = library.encode(r.text or "")
        rows.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[5]) == sorted(rows)


def test_run_is_the_stages(spark, stages):
    got = entry.queries()["pipeline"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[5]))


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and extra columns go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "text without an id " * 9, None, None, None), (5000, None, "en", "s", 3), (5001, "", None, "s", 0), (5002, "w " * 50000, "en", None, 100000), (5002, "w " * 50000, "en", None, 100000)], docs.schema)
    for table in (docs.unionByName(odd).withColumns({"score": F.lit(1), "size": F.lit(2), "label": F.lit(3)}), docs.limit(0)):
        df = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{k}-{table.count()}")
            stage(spark, df, SF).write.parquet(path)
            df = spark.read.parquet(path)
        assert df.count() > 0 or not table.count()


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name in ("op4_line_dedup", "op5_url_filter", "op10_quality_rules"):
        got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        show = lambda df: sorted(repr([None if v != v else v for v in row]) for row in df[sorted(df.columns)].itertuples(index=False, name=None))
        assert show(got) == show(want)


def test_url_and_crc_of_the_contract(spark):
    row = spark.range(1).select(F.crc32(F.lit("17")).alias("c")).first()
    assert row.c == zlib.crc32(b"17")


def test_the_last_stage_holds_little(monkeypatch):
    """Workers of the last stage stand beside executors that the stages before have filled."""
    fn = {}
    monkeypatch.setattr(bpe_agenda, "map_rows", lambda df, columns, schema, make, *_, **k: fn.update(k, make=make))
    corpus_pipeline.tokens(None, None, SF)
    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(5)
    texts = [" ".join(f"word{x:x}" for x in rng.integers(0, 1 << 40, 80).tolist()) for _ in range(3072)]
    arrow.release()
    run = fn["make"]()
    tracemalloc.start()
    try:
        for at in range(0, len(texts), fn["rows"]):
            lengths, digests, _ = run([texts[at : at + fn["rows"]]])
            assert lengths[-1] == len(ids := library.encode(texts[at + len(lengths) - 1]))
            assert digests[-1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
        arrow.release()
