"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import avi, bpe_agenda, langid, line_dedup, mixing, order_minhash, quality_fm, quality_rules, token_index, url_filter

#: Share of a site's documents above which a line is boilerplate, and the least number of them.
LINE_RATIO, LINE_PAGES = 0.02, 3

# The rules of the URL query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of up to so many stored bytes is dealt anew to all cores: it may lie in one row group,
#: which a single task would read.  Larger tables are read as they lie, without a shuffle.
SMALL_TABLE = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    small = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE
    return docs.repartition(spark.sparkContext.defaultParallelism) if small else docs


def _crc_mod(key: str, n: int):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_crc_mod("doc_id", 4) == 2, F.lit(False))
    net = langid.fit(docs.where(~held_out))
    out = langid.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_bytes", "top_bytes")


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(_crc_mod("doc_id", 5) == 0, F.lit(False))
    fm = quality_fm.fit(docs, labels.where(~held_out))
    return quality_fm.score(docs.select("doc_id", "text", "n_chars"), fm).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_media_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digests(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents"), ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


OP4_SQL = f"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, ' ') AS bare
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), totals AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
counts AS (SELECT source, bare, count(DISTINCT doc_id) AS n FROM lines WHERE bare <> '' AND source IS NOT NULL GROUP BY source, bare),
bad AS (SELECT c.source, c.bare FROM counts c JOIN totals t ON c.source = t.source WHERE c.n >= {LINE_PAGES} AND c.n > {LINE_RATIO} * t.pages),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.bare IS NULL) AS text, count(*) AS n_lines, count(b.bare) AS n_dropped
  FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.bare = b.bare GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(coalesce(k.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_dropped, 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def _op5_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
parts AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), ranked AS (
  SELECT page_id, host, path, h || p AS rule, v,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM ranked WHERE k = 1
"""


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.takes(docs).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.classes(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "kept")


def op8_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_index.token_digests(spark, docs, _tokenizer("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_agenda.encode_decode(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


RULE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir).select("doc_id", "text")).select(*RULE_COLUMNS)


def _op10_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(quality_rules.STOP_WORDS)))
    checks = []
    for r in quality_rules.RULES:
        for sign, bound in ((">=", r.low), ("<=", r.high)):
            if bound is not None:
                checks.append(f"(n_words < {r.words} OR {r.metric} {sign} {bound})")
    return f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(list_filter(w, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper_words
  FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id
), ratios AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
    coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_upper_words / nullif(n_words, 0), 0) AS upper_word_ratio FROM counts
)
SELECT {', '.join(RULE_COLUMNS[:-1])}, NOT base_failed AND {' AND '.join(checks)} AS kept FROM ratios
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_quality_fm": op2_quality_fm,
        "op3_media_avi": op3_media_avi,
        "op4_line_dedup": op4_line_dedup,
        "op5_url_filter": op5_url_filter,
        "op6_mix_sources": op6_mix_sources,
        "op7_order_minhash": op7_order_minhash,
        "op8_token_index": op8_token_index,
        "op9_piece_bpe": op9_piece_bpe,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op5_url_filter": _op5_sql(), "op10_quality_rules": _op10_sql()}
