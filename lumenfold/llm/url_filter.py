"""URL filters in DataFrame operations only.

Each URL is expanded into expressions, a suffix of its host and a prefix of its path; they
meet the rules in an equi-join on the first four bytes of a SHA-256 digest, and the full
digests confirm.  The longest fitting rule decides; at equal length the longer host, then
block over allow.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path:
from there up to ``?``, ``#`` or the end.  A rule fits its host and all subdomains if the
path starts with the rule's path, so the prefixes needed are those of the lengths that rule
paths have; these lengths are gathered first, a set bounded by ``MAX_PATH``, and longer rule
paths are refused.

The rules are broadcast while they number at most ``broadcast_rules``, counted; beyond that
the rules are replicated over ``salts`` and expressions dealt over them, so that a common
expression such as ``com/`` does not meet in one task.  An URL's expressions come together
again by row id after a partial maximum, so that one row for each page is shuffled.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and
the default verdict; an empty rule table leaves the default verdict everywhere; repeated
rows stay; other columns pass through, but for those with the names of results in any case,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.names import Working, col, others
from lumenfold.operators.lineage import written

MAX_PATH = 2048
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule_host string, rule_path string, verdict string"
RESULTS = ("host", "path", "rule", "verdict")
#: A rule's rank: total length, then host length, then block before allow.
_HOST_BITS = 1 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """A host and each part of it after a dot."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def filter_urls(
    pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow", broadcast_rules: int = 100_000, salts: int = 64, force: str | None = None
) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    ``rules``: rule_host, rule_path and verdict, allow or block.
    """
    w = Working(pages.columns)
    usable = rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull())
    keyed = usable.select(
        _digest(F.col("rule_host"), F.col("rule_path")).alias(w.full),
        ((F.length("rule_host") + F.length("rule_path")) * _HOST_BITS * 2 + F.length("rule_host") * 2 + (F.col("verdict") == "block").cast("int")).cast("bigint").alias(w.rank),
    ).withColumn(w.short, F.substring(w.full, 1, 8))
    known = usable.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("n"), F.count(F.lit(1)).alias("rules")).first()
    if known["n"] and known["n"][-1] > MAX_PATH:
        raise ValueError(f"a rule's path is longer than {MAX_PATH}")
    lengths = F.array(*[F.lit(n) for n in known["n"]]) if known["n"] else F.array().cast("array<int>")
    own = others(pages.columns, RESULTS)
    rows = pages.select(*[col(c) for c in own], host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    pairs = F.flatten(F.transform(_suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    # Row ids are read by two branches, which must see the same ones: they are written first.
    rows = written(rows.withColumn(w.row, F.monotonically_increasing_id()), "urls")
    expanded = rows.where(F.col("host") != "").select(w.row, F.explode(pairs).alias(w.page)).withColumn(w.short, F.substring(w.page, 1, 8))
    if (force or ("broadcast" if known["rules"] <= broadcast_rules else "shuffle")) == "broadcast":
        met = expanded.join(F.broadcast(keyed), w.short)
    else:
        spread = keyed.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(w.salt))
        met = expanded.withColumn(w.salt, F.pmod(F.hash(w.row), F.lit(salts))).join(spread.hint("merge"), [w.short, w.salt])
    hits = met.where(F.col(w.page) == F.col(w.full)).groupBy(w.row).agg(F.max(w.rank).alias(w.rank))
    best = rows.join(hits, w.row, "left")
    host_length = F.pmod(F.floor(F.col(w.rank) / 2), F.lit(_HOST_BITS)).cast("int")
    path_length = (F.floor(F.col(w.rank) / (2 * _HOST_BITS)) - host_length).cast("int")
    rule = F.concat(F.substr(F.col("host"), F.length("host") - host_length + 1), F.col("path").substr(F.lit(1), path_length))
    verdict = F.when(F.col(w.rank).isNull(), F.lit(default)).when(F.pmod(w.rank, F.lit(2)) == 1, F.lit("block")).otherwise(F.lit("allow"))
    return best.select(*[col(c) for c in own], "host", "path", F.when(F.col(w.rank).isNotNull(), rule).alias("rule"), verdict.alias("verdict"))
