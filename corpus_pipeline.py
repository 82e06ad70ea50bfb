"""A corpus pipeline of five stages, each a DataFrame of the columns of ``documents``.

The stages are run over all that their predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe_agenda, line_dedup, mixing, order_minhash, quality_fm
from lumenfold.llm.queries import LINE_PAGES, LINE_RATIO, documents
from lumenfold.operators.lineage import clear, made, written

#: Words remembered and rows of a block in the last stage: executors still hold heap and buffers of
#: the stages before, which leave its workers less memory than the query alone leaves them.
TOKEN_WORDS, TOKEN_ROWS = 75_000, 256

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = labels.where(F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0, F.lit(False)))
    fm = quality_fm.fit(docs, train)
    return quality_fm.score(docs, fm, keep=COLUMNS).where(F.col("predicted") == 1).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; n_chars follows the text.

    Lines are counted over distinct texts, since copies are still there.
    """
    out = line_dedup.drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES, per_text=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return order_minhash.keep_one(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix draws them, by shard and shuffled within it."""
    return mixing.shuffled(mixing.mix(docs)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every mixed row by the agenda, checked by the library, and decoded."""
    import public_tokenizers

    return bpe_agenda.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), remembered=TOKEN_WORDS, rows=TOKEN_ROWS)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_duplicates),
    ("mixing to target weights", mixture),
    ("sentencepiece", tokens),
]

#: The trained and hashed stages have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, used = documents(spark, sf_dir), []
    for name, stage in STAGES[:-1]:
        before = made()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        # What the stage read and made on the way is no longer needed.
        new = [p for p in made() if p not in before]
        clear(spark, [*used, *new[:-1]])
        used = new[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
