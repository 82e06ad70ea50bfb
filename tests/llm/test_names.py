"""Extra columns whose names clash with results or working columns, in either case, through every operator and stage."""

import re
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import avi, bpe_agenda, langid, line_dedup, mixing, order_minhash, quality_fm, quality_rules, token_index, url_filter
from lumenfold.llm.names import Working, others
from lumenfold.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
HERE = Path(line_dedup.__file__).parent
OWN = {"doc_id", "text", "lang", "source", "n_chars", "url", "page_id"}


def clashing() -> list[str]:
    """Every name that a module makes a column of: working names behind their prefix, names in quotes, results."""
    found = set()
    for path in HERE.glob("*.py"):
        code = path.read_text()
        found |= {f"__{n}" for n in re.findall(r"\b(?:w|names)\.([a-z_0-9]+)", code)}
        found |= set(re.findall(r'(?:alias|withColumn|name=)\(?"([A-Za-z_0-9]+)"', code)) | set(re.findall(r"\b(?:RESULTS|schema)\b.*?\"([a-z_0-9, ]+)\"", code))
        found |= {w for m in re.findall(r"^(?:RESULTS|RULE_COLUMNS) = [(\[](.*?)[)\]]$", code, re.S | re.M) for w in re.findall(r'"(\w+)"', m)}
    found |= {"score", "predicted", "lang_pred", "id", "row", "digest", "bands", "words", "rep", "feature", "start", "n_tokens", "__text", "__n", "__key", "__part", "a.b", "with space"}
    return sorted(n for n in found if n.lower() not in OWN)


NAMES = clashing()


def with_clashes(df, upper):
    return df.select("*", *[F.lit(f"x{k}").alias(n.upper() if upper else n) for k, n in enumerate(NAMES)])


def rows_of(df, columns):
    return sorted((tuple(repr(r[c]) for c in columns) for r in df.collect()))


def test_the_list_is_long():
    assert len(NAMES) > 60 and {"__row", "__site", "__bad", "host", "taken", "shards", "n_words", "__words"} <= set(NAMES)


OPERATORS = {
    "line_dedup": (lambda d: line_dedup.drop_boilerplate(d, ratio=0.1, min_pages=2), ["doc_id", "text", "n_lines", "n_dropped"]),
    "line_dedup_broadcast": (lambda d: line_dedup.drop_boilerplate(d, ratio=0.1, min_pages=2, force="broadcast"), ["doc_id", "text", "n_lines", "n_dropped"]),
    "line_dedup_shuffle": (lambda d: line_dedup.drop_boilerplate(d, ratio=0.1, min_pages=2, force="shuffle", salts=3, per_text=True), ["doc_id", "text", "n_lines", "n_dropped"]),
    "urls": (lambda d: url_filter.filter_urls(d, d.sparkSession.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)), ["doc_id", "host", "path", "rule", "verdict"]),
    "urls_shuffle": (lambda d: url_filter.filter_urls(d, d.sparkSession.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA), force="shuffle", salts=3), ["doc_id", "host", "path", "rule", "verdict"]),
    "takes": (lambda d: mixing.takes(d), ["doc_id", "size", "source_size", "target", "taken", "shards"]),
    "takes_salted": (lambda d: mixing.takes(d, mixing.MixConfig(broadcast_rows=0, salts=3)), ["doc_id", "size", "source_size", "target", "taken", "shards"]),
    "mix": (lambda d: mixing.mix(d), ["doc_id", "round", "shard", "place"]),
    "rules": (lambda d: quality_rules.apply_rules(d), ["doc_id", "n_words", "n_repeat_words", "kept"]),
    "keep_one": (lambda d: order_minhash.keep_one(d), ["doc_id", "text"]),
}


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_pass_through(spark, name, upper):
    run, results = OPERATORS[name]
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(50).withColumn("url", F.concat(F.lit("http://a.example.com/en/"), "doc_id"))
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    full = with_clashes(plain, upper)
    got = run(full)
    assert rows_of(got, results) == rows_of(run(plain), results)
    replaced = {c.lower() for c in results} - {"doc_id", "text"}
    lower = [c.lower() for c in got.columns]
    assert len(lower) == len(set(lower))
    if name != "mix":
        kept = [c for c in full.columns if c.lower() in lower and c.lower() not in replaced]
        assert len([n for n in NAMES if n.lower() in lower]) > 40
        named = {n.lower(): f"x{k}" for k, n in enumerate(NAMES)}
        made = set(got.columns) - set(full.columns)
        first = got.first()
        assert all(first[c] == named[c.lower()] for c in kept if c.lower() in named and c not in made and c in full.columns and c.lower() not in {x.lower() for x in RESULTS[name.split("_")[0]]})


RESULTS = {"line": line_dedup.RESULTS, "urls": url_filter.RESULTS, "takes": mixing.RESULTS, "mix": mixing.RESULTS, "rules": quality_rules.RESULTS, "keep": ()}


@pytest.mark.parametrize("upper", [False, True])
def test_operators_that_ignore_other_columns(spark, upper):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    full = with_clashes(plain, upper)
    for run in (
        lambda d: langid.predict(d, langid.fit(d, langid.LangConfig(steps=3)), langid.LangConfig()),
        lambda d: quality_fm.score(d, quality_fm.fit(d, labels)),
        lambda d: avi.media_digests(d),
        lambda d: order_minhash.classes(d),
        lambda d: token_index.token_digests(spark, d, public_tokenizers.path("word_bpe_49k.json"), shards=2),
        lambda d: bpe_agenda.encode_decode(d, public_tokenizers.path("piece_bpe_32k.model")),
    ):
        a, b = run(full), run(plain)
        assert a.columns == b.columns and rows_of(a, a.columns) == rows_of(b, b.columns)


@pytest.mark.parametrize("upper", [False, True])
def test_every_stage_takes_clashing_columns(spark, upper):
    plain = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    plain = spark.createDataFrame(plain.collect(), plain.schema)
    full = with_clashes(plain, upper)
    for _, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, full, SF), stage(spark, plain, SF)
        assert a.columns == b.columns and rows_of(a, a.columns) == rows_of(b, b.columns)


def test_working_names_meet_no_column():
    assert Working(["a"]).row == "__row" and Working(["a"], ["__X"]).row == "___row" and Working(["___y", "__z"]).row == "____row"
    assert others(["Host", "a", "RULE"], ("host", "rule")) == ["a"]
