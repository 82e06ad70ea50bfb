"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are summed by source and block; a block is a hash class of a source's
   documents.  Sources get blocks in proportion to their rows, one at least, so that this table
   has at most ``most_blocks`` rows and one for each source.
2. Targets: sources, in code-point order with null last, weigh 3, 1, 2, repeating, and share
   ``share`` times all sizes; a target stops at ``most`` times its source's size, and the
   excess is shared again by weight until none is above.
3. A source's quota is a set of block draws: every block as often as it goes in whole, then
   blocks in a seeded order, each taken if it still fits, so that the words taken fall short
   of the target by less than the smallest block left; one more block is taken where that
   comes nearer.  Small sources try several orders and keep the nearest.
4. What remains is settled within one block of several documents: of that block a prefix of its
   documents in a hashed order is drawn, the order and prefix of several that come nearest.  So
   a target is missed by less than documents are long.
5. The exact quotas are split over the output shards by a binary tree: at each node the left
   half's draws of each group of sources come from a multivariate hypergeometric distribution;
   a group is one source, or several where there are more than ``groups``, and deals its shares
   to its sources by the same distribution given those shares.  Shards then take disjoint ranges
   of each source's permuted draws, and rows are shuffled within their shard by a hash of
   document and round.

Sources, blocks and draws stay in DataFrames.  The driver gets one row of sums for each round of
step 2 and the quotas of at most ``groups`` groups, however many sources there are.

Defined results: a null text has size 0; a null source is a source of its own; sources of
size 0 have target 0; an empty table gives an empty mix; rows with equal ids share their
block and so are taken alike; other columns pass through, but for those with the names of
results in any case, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.names import Working, col, others
from lumenfold.operators.lineage import cut, written
from lumenfold.operators.numbering import number_rows

SOURCE_WEIGHTS = (3, 1, 2)
#: Names of results, which replace columns of the input.
RESULTS = ("size", "source_size", "target", "taken", "shards", "round", "shard", "place")


@dataclass(frozen=True)
class MixConfig:
    share: float = 1.5
    most: float = 2.0
    #: Blocks that a source has at most, but for one for each ``block_rows`` of its rows.
    blocks: int = 1024
    block_rows: int = 1 << 20
    #: Bound on the blocks of all sources beyond one for each.
    most_blocks: int = 1 << 18
    shards: int = 64
    #: Groups of sources whose quotas the tree splits on the driver.
    groups: int = 4096
    seed: int = 23
    #: Tables by source or draw are broadcast up to so many rows, counted; beyond that they are joined by shuffle.
    broadcast_rows: int = 500_000
    #: Parts of a source in a join by source that is not broadcast.
    salts: int = 64


def word_count(text: Column) -> Column:
    """Runs of other characters than space and 0x09 to 0x0D; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, cfg: MixConfig) -> DataFrame:
    """``sizes`` (source, source_size) with target: ``share`` of all sizes by weight, none above ``most`` times its size.

    A target is min(most * size, level * weight).  The level is that of the sources under their
    bound, given those at it; each round has one row of sums, and the level only rises.
    """
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in SOURCE_WEIGHTS]), (F.col("source") % len(SOURCE_WEIGHTS) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cfg.most).alias("most"))
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        total, held, free = weighed.agg(
            F.sum(F.col("source_size") * cfg.share), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - held) / free if free else level
        if new <= level:
            break
        level = new
    return weighed.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def draw_quota(words: np.ndarray, target: float, rounds: int, rng: np.random.Generator, tries: int = 200) -> np.ndarray:
    """How often each block is drawn, at most ``rounds`` times, to come near ``target`` words.

    Of several seeded orders the one that comes nearest is taken; the first that is within a
    thousandth ends the search, which sources with many blocks reach at once.
    """
    total = int(words.sum())
    whole = min(rounds, int(target // total)) if total else 0
    times = np.full(len(words), whole)
    if whole >= rounds or not total:
        return times
    goal, best, miss = target - whole * total, np.zeros(len(words), dtype=bool), float("inf")
    for _ in range(min(tries, math.factorial(min(len(words), 6)))):
        left, used = goal, np.zeros(len(words), dtype=bool)
        for k in rng.permutation(len(words)).tolist():
            if words[k] <= left:
                used[k] = True
                left -= int(words[k])
        rest = np.flatnonzero(~used)
        if len(rest):
            k = rest[np.argmin(np.abs(words[rest] - left))]
            if abs(words[k] - left) < left:
                used[k] = True
                left -= int(words[k])
        if abs(left) < miss:
            best, miss = used, abs(left)
        if miss <= target / 1000:
            break
    return times + best


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) blocks of each source for each shard; columns add up to the quotas."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    share = int(round(int(quotas.sum()) * left / shards))
    drawn = rng.multivariate_hypergeometric(quotas, share, method="marginals")
    return np.concatenate([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def _cut_block(words: np.ndarray, rows: np.ndarray, times: np.ndarray, target: float, rounds: int) -> tuple[int, float] | None:
    """A block of which only a part should be drawn once more than ``times``, and the words of that part.

    Where ``times`` overshoots, one block is first taken back, in ``times`` itself.
    """
    miss = target - float(words @ times)
    whole = int(target // words.sum()) if words.sum() else 0
    some = (rows > 1) & (words > abs(miss)) & ((times < rounds) if miss > 0 else (times > whole))
    if not miss or not some.any():
        return None
    k = int(np.flatnonzero(some)[np.argmin(words[some])])
    if miss < 0:
        times[k] -= 1
        miss += float(words[k])
    return k, miss


def nearest_prefix(keys: np.ndarray, size: np.ndarray, goal: float, rng: np.random.Generator, tries: int = 64) -> tuple[int, int]:
    """(modulus, limit): documents with key % modulus <= limit have near ``goal`` words.

    Each modulus gives an order; limit -1 takes none.  Equal keys go together.
    """
    best, out = float("inf"), (1, -1)
    for _ in range(tries):
        modulus = int(rng.integers(1 << 43, 1 << 44)) | 1
        place = np.mod(keys, modulus)
        order = np.argsort(place, kind="stable")
        place, sums = place[order], np.cumsum(size[order])
        ends = np.append(place[1:] != place[:-1], True)
        limits, sums = np.append(-1, place[ends]), np.append(0, sums[ends])
        k = int(np.argmin(np.abs(sums - goal)))
        if abs(sums[k] - goal) < best:
            best, out = abs(sums[k] - goal), (modulus, int(limits[k]))
        if best <= 0.5:
            break
    return out


def _draws(blocks: DataFrame, totals: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, block, first, times, goal): blocks drawn whole in rounds 0 to times - 1, and with a
    goal those of which a part with so many words is drawn in round ``first``."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for source, own in pdf.sort_values(["source", "block"]).groupby("source", sort=True):
            ids, words, rows, target = own["block"].to_numpy(), own["words"].to_numpy(), own["rows"].to_numpy(), float(own["target"].iloc[0])
            times = draw_quota(words, target, int(cfg.most), np.random.default_rng([cfg.seed, int(source)]))
            part = _cut_block(words, rows, times, target, int(cfg.most))
            out += [(source, int(ids[k]), 0, int(times[k]), None) for k in np.flatnonzero(times)]
            if part:
                out.append((source, int(ids[part[0]]), int(times[part[0]]), 1, float(part[1])))
        return pd.DataFrame(out, columns=["source", "block", "first", "times", "goal"])

    grouped = blocks.join(totals, "source").withColumn("group", F.col("source") % cfg.groups)
    return grouped.groupBy("group").applyInPandas(draw, "source long, block int, first int, times int, goal double")


def _prefixes(sizes: DataFrame, parts: DataFrame, n: int, cfg: MixConfig) -> DataFrame:
    """(source, block, round, modulus, limit) of parts of blocks; ``sizes`` has source, block, key and size."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"])
        first = pdf.iloc[0]
        rng = np.random.default_rng([cfg.seed, 1, int(first["source"])])
        modulus, limit = nearest_prefix(pdf["key"].to_numpy(), pdf["size"].to_numpy(), float(first["goal"]), rng)
        return pd.DataFrame({"source": [int(first["source"])], "block": [int(first["block"])], "round": [int(first["first"])], "modulus": [modulus], "limit": [limit]})

    met = sizes.join(_maybe_broadcast(parts.select("source", "block", "first", "goal"), n, cfg.broadcast_rows), ["source", "block"])
    return met.groupBy("source", "block").applyInPandas(one, "source long, block int, round int, modulus long, limit long").where("limit >= 0")


def _dealt(draws: DataFrame, cfg: MixConfig) -> DataFrame:
    """Draws with their shard: quotas of groups by the tree, and those of a group's sources given their sum."""
    spark = draws.sparkSession
    grouped = draws.withColumn("group", F.col("source") % cfg.groups)
    quotas = sorted((r["group"], r["count"]) for r in grouped.groupBy("group").count().collect())
    if sum(n for _, n in quotas) >= 10**9:
        raise ValueError("more draws than the distribution takes: use fewer blocks")
    split = split_quotas(np.array([n for _, n in quotas], dtype=np.int64), cfg.shards, np.random.default_rng([cfg.seed, 1 << 20])) if quotas else np.zeros((cfg.shards, 0))
    shares = spark.createDataFrame([(g, [int(x) for x in split[:, k]]) for k, (g, _) in enumerate(quotas)], "group long, shares array<long>")

    def deal(pdf: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "block", "round"]).reset_index(drop=True)
        rng = np.random.default_rng([cfg.seed, 2, int(pdf["group"].iloc[0])])
        left, shard = np.array(share["shares"].iloc[0], dtype=np.int64), np.empty(len(pdf), dtype=np.int64)
        for _, at in pdf.groupby("source", sort=True).indices.items():
            own = rng.multivariate_hypergeometric(left, len(at), method="marginals")
            left -= own
            shard[rng.permutation(at)] = np.repeat(np.arange(cfg.shards), own)
        return pdf.drop(columns="group").assign(shard=shard)

    schema = "source long, block int, round int, modulus long, limit long, shard int"
    return grouped.groupBy("group").cogroup(shares.groupBy("group")).applyInPandas(deal, schema)


def plan(sizes: DataFrame, cfg: MixConfig) -> tuple[DataFrame, DataFrame]:
    """(source, block, draws) of all drawn blocks, and (source, source_size, target).

    ``sizes``: source, block, key and size of each document.  A draw has round, shard, modulus and
    limit; one with a modulus is of those documents whose key % modulus <= limit.
    """
    blocks = cut(sizes.groupBy("source", "block").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    totals = cut(targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), cfg))
    drawn = cut(_draws(blocks, totals.select("source", "target"), cfg))
    whole = drawn.where(F.col("goal").isNull()).select("source", "block", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("round"))
    whole = whole.withColumns({"modulus": F.lit(None).cast("long"), "limit": F.lit(None).cast("long")})
    parts = drawn.where(F.col("goal").isNotNull())
    dealt = _dealt(cut(whole.unionByName(_prefixes(sizes, parts, parts.count(), cfg))), cfg)
    draws = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("round", "shard", "modulus", "limit"))).alias("draws"))
    return cut(draws), totals


def _maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def _by_source(rows: DataFrame, table: DataFrame, on: Column, n: int, key: str, salt: str, cfg: MixConfig) -> DataFrame:
    """``rows`` with the row of ``table`` of their source; beyond a broadcast, sources are met in parts by ``key``."""
    if n <= cfg.broadcast_rows:
        return rows.join(F.broadcast(table), on)
    salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    return rows.join(salted, on & (F.pmod(F.col(key), F.lit(cfg.salts)) == F.col(salt)))


def _planned(docs: DataFrame, cfg: MixConfig, w: Working, key: str, text: str, source: str) -> tuple[DataFrame, DataFrame, int]:
    """``docs`` with the working columns source (a number), key and held (a row's draws), and its size; totals by source, and their number."""
    counts = docs.groupBy(col(source).alias("name")).agg(F.count(F.lit(1)).alias("rows")).withColumn("anonymous", F.col("name").isNull())
    named = cut(number_rows(counts, "anonymous", "name", name="source"))
    n, rows = named.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    most = F.greatest(F.lit(cfg.blocks), F.ceil(F.col("rows") / cfg.block_rows))
    blocks = F.least(most, F.greatest(F.lit(1), F.floor(F.col("rows") * F.lit(cfg.most_blocks / max(1, rows))))).cast("int")
    table = named.select(F.col("name").alias(w.name), F.col("source").alias(w.source), blocks.alias(w.blocks))
    keyed = docs.withColumn(w.key, F.xxhash64(F.lit(cfg.seed), col(key)))
    met = _by_source(keyed, table, col(source).eqNullSafe(F.col(w.name)), n, w.key, w.salt, cfg)
    own = [col(c) for c in others(docs.columns, RESULTS)]
    sized = met.select(*own, w.source, w.key, F.pmod(w.key, w.blocks).cast("int").alias(w.block), word_count(col(text)).alias("size"))
    sizes = written(sized.select(*[F.col(getattr(w, c)).alias(c) for c in ("source", "block", "key")], "size"), "sizes")
    draws, totals = plan(sizes, cfg)
    told = draws.select(F.col("source").alias(w.s), F.col("block").alias(w.b), F.col("draws").alias(w.draws))
    drawn = sized.join(_maybe_broadcast(told, draws.count(), cfg.broadcast_rows), (F.col(w.source) == F.col(w.s)) & (F.col(w.block) == F.col(w.b)), "left")
    held = F.filter(w.draws, lambda d: d["modulus"].isNull() | (F.pmod(F.col(w.key), d["modulus"]) <= d["limit"]))
    return drawn.withColumn(w.held, F.coalesce(held, F.array().cast(drawn.schema[w.draws].dataType))), totals, n


def takes(docs: DataFrame, cfg: MixConfig | None = None, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, taken (words that the mix takes of a row) and shards, one for each draw of it."""
    cfg, w = cfg or MixConfig(), Working(docs.columns)
    drawn, totals, n = _planned(docs, cfg, w, key, text, source)
    table = totals.select(F.col("source").alias(w.s2), "source_size", "target")
    told = _by_source(drawn, table, F.col(w.source) == F.col(w.s2), n, w.key, w.salt, cfg)
    own = [col(c) for c in others(docs.columns, RESULTS)]
    shards = F.transform(w.held, lambda d: d["shard"])
    return told.select(*own, "size", "source_size", "target", (F.col("size") * F.size(shards)).cast("bigint").alias("taken"), shards.alias("shards"))


def mix(docs: DataFrame, cfg: MixConfig | None = None, *, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed rows: ``docs`` columns with round, shard and place (order within the shard).

    A row stands once for each draw of it.  Sort by shard and place to write shards.
    """
    cfg, w = cfg or MixConfig(), Working(docs.columns)
    drawn, _, _ = _planned(docs, cfg, w, key, text, source)
    out = drawn.withColumn(w.draw, F.explode(w.held))
    round_ = F.col(w.draw)["round"]
    own = [col(c) for c in others(docs.columns, RESULTS)]
    return out.select(*own, round_.alias("round"), F.col(w.draw)["shard"].alias("shard"), F.xxhash64(F.lit(cfg.seed + 1), col(key), round_).alias("place"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` dealt by shard and in their places: partitions are ranges of the order by shard and place."""
    return mixed.repartitionByRange("shard", "place").sortWithinPartitions("shard", "place")
