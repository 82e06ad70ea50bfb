"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and
carriage return.  Base figures of a text: words, characters in words, symbols, lines that
repeat an earlier line, and words in five-word windows that occur twice or more.

Defined results: a null text counts as empty; an empty text fails the base rules; a text of
under five words has no windows; ratios over no words are 0; repeated rows are judged alike;
other columns pass through, but for those with the names of results in any case, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.names import Working, col, others

# Frequent function words of four languages.
STOP_WORDS = (
    "the of and to in that is was for on it with as be at by he this are or from had not an you "
    "der die das und ist von mit sich nicht auf ein eine den dem des für im zu als auch "
    "le la les et est un une des que qui dans pour pas sur au par du de en "
    "el los las y es por con una su para se del al lo como"
).split()
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A text of at least ``words`` words is kept while ``low <= metric <= high``."""

    metric: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: The table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=20),
    Rule("symbols_per_word", high=0.1),
    Rule("dup_line_ratio", high=0.5),
    Rule("stop_word_ratio", low=0.02, words=30),
    Rule("upper_word_ratio", high=0.5),
)


#: Names of results, which replace columns of the input.
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper_words",
    "mean_word_chars", "symbols_per_word", "dup_line_ratio", "stop_word_ratio", "upper_word_ratio", "base_failed", "failed_rules", "kept",
)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f).getItem(0)


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs twice or more, of which there are some.

    Windows are sorted by hash, so that equal ones are neighbours; their places, sorted again,
    each add the words up to the next one, five at most.
    """

    def places(ordered: Column) -> Column:
        same = lambda e, k: F.coalesce(F.get(ordered, k)["h"] == e["h"], F.lit(False))
        return F.sort_array(F.array_compact(F.transform(ordered, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))))

    def words(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))), F.lit(0), lambda s, n: s + n)

    return _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda o: _let(places(o), words))


def _repeat_words(hashes: Column) -> Column:
    """Words in five-word windows found twice or more; most texts have none and stop at the count."""
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(_covered(hashes))


def with_metrics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the base figures and ratios, in two projections and no shuffle."""
    w = Working(docs.columns)
    t = F.coalesce(col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n, hashed = F.size(w.words), F.col(w.hashed)
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW)]))
    )
    a = docs.withColumns({w.words: words, w.lines: lines})
    a = a.withColumn(w.hashed, F.transform(w.words, lambda x: F.xxhash64(x)))
    a = a.withColumn(w.windows, windows)
    whole = F.length(t)
    a = a.select(
        *[col(c) for c in others(docs.columns, RESULTS)],
        F.size(w.words).cast("bigint").alias("n_words"),
        (whole - _count_of(t, SPACE)).cast("bigint").alias("word_chars"),
        _count_of(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size(w.lines) - F.size(F.array_distinct(w.lines))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col(w.windows)).cast("bigint").alias("n_repeat_words"),
        F.size(w.lines).cast("bigint").alias("n_lines"),
        F.size(F.filter(w.words, lambda x: F.lower(x).isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter(w.words, lambda x: (F.length(x) > 1) & (F.upper(x) == x) & (F.lower(x) != x))).cast("bigint").alias("n_upper_words"),
    )
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return a.withColumns({
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "upper_word_ratio": per("n_upper_words", "n_words"),
    })


def _count_of(t: Column, chars: str) -> Column:
    return F.length(t) - F.length(F.translate(t, chars, ""))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one boolean expression."""
    ok = F.lit(True)
    for rule in rules:
        short = F.col("n_words") < rule.words
        if rule.low is not None:
            ok = ok & (short | (F.col(rule.metric) >= rule.low))
        if rule.high is not None:
            ok = ok & (short | (F.col(rule.metric) <= rule.high))
    return ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text") -> DataFrame:
    """``docs`` with metrics, base_failed, failed_rules and kept."""
    measured = with_metrics(docs, text=text).withColumn("base_failed", base_failed())
    failed = F.array_compact(F.array(*[F.when(~compiled((r,)), F.lit(r.metric)) for r in rules]))
    return measured.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))
