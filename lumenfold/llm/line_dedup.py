"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is boilerplate of a site if it stands on more than ``ratio`` of the site's pages and
on at least ``min_pages`` of them.  Lines are compared after trimming spaces; a line counts
once for each page; blank lines are never boilerplate.  Boilerplate lines are dropped, the
other lines stay as they are, in their order.

How it scales: pages send their distinct line hashes (64 bits, within a site) into one
pre-aggregated count.  A site of P pages with L distinct lines a page has under L / ratio
boilerplate lines, so what comes out is small.  If no site has more than ``site_lines`` of them
and all together, counted, are under ``broadcast_rows``, they are broadcast as an array for each
site, which every line is looked up in, and texts are never shuffled.  Beyond that page hashes
are matched by a join, broadcast up to ``broadcast_rows`` and salted over ``salts`` after that,
and a page's hits return to it by a row id.  All ways give the same rows.

With ``per_text`` a site's pages are its distinct texts: a line counts once for each of them,
and ``ratio`` is of their number.  Copies of a text then never make its lines boilerplate, so
that a later removal of copies still finds the text.

Defined results: a null text stays null and has no lines; a null site is no site, and its
pages keep every line; an empty table gives an empty table; repeated rows count as pages of
their own, but with ``per_text``, where null is no text; other columns pass through, but for
those with the names of results in any case, which are replaced.  Two different lines of a site
are mistaken for one another with a probability of 2**-64 a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.names import Working, col, others
from lumenfold.operators.lineage import cut, written

RESULTS = ("n_lines", "n_dropped")
#: Columns of the table of boilerplate lines and of those that it is counted from.
SITE, LINE_HASH, LINE_PAGES, TEXT_HASH = "site", "line_hash", "line_pages", "text_hash"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    """Null for a blank line."""
    bare = F.trim(line)
    return F.when(bare != "", F.xxhash64(bare))


def _hashes(text: Column) -> Column:
    """Distinct line hashes of a text."""
    return F.array_distinct(F.filter(F.transform(_lines(text), line_hash), lambda h: h.isNotNull()))


def boilerplate(pages: DataFrame, *, site: str, text: str, ratio: float = 0.2, min_pages: int = 3, per_text: bool = False) -> DataFrame:
    """(site, line hash, pages that contain it) of each site's boilerplate lines."""
    told = pages.where(col(site).isNotNull()).select(col(site).alias(SITE), col(text).alias("text"))
    by_text = [F.xxhash64("text").alias(TEXT_HASH)] if per_text else []
    keyed = told.select(SITE, F.explode(_hashes(F.col("text"))).alias(LINE_HASH), *by_text)
    sited = told.select(SITE)
    if per_text:
        # Distinct by all columns first: a line of many texts is then counted in many tasks.
        keyed = keyed.distinct()
        sited = told.where(F.col("text").isNotNull()).select(SITE, *by_text).distinct()
    counts = keyed.groupBy(SITE, LINE_HASH).agg(F.count(F.lit(1)).alias(LINE_PAGES)).where(F.col(LINE_PAGES) >= min_pages)
    totals = sited.groupBy(SITE).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, SITE).where(F.col(LINE_PAGES) > F.lit(ratio) * F.col("total")).drop("total")


def _strip(text: Column, bad: Column) -> tuple[Column, Column]:
    """The text without bad lines, and how many were dropped."""
    kept = F.filter(_lines(text), lambda x: F.coalesce(~F.array_contains(bad, line_hash(x)), F.lit(True)))
    some = bad.isNotNull() & F.arrays_overlap(_hashes(text), bad)
    n_kept = F.when(some, F.size(_lines(text)) - F.size(kept)).otherwise(F.lit(0))
    return F.when(some, F.array_join(kept, "\n")).otherwise(text), F.when(text.isNull(), F.lit(0)).otherwise(n_kept)


def drop_boilerplate(
    pages: DataFrame,
    *,
    site: str = "source",
    text: str = "text",
    ratio: float = 0.2,
    min_pages: int = 3,
    per_text: bool = False,
    site_lines: int = 256,
    broadcast_rows: int = 200_000,
    salts: int = 64,
    force: str | None = None,
) -> DataFrame:
    """``pages`` with ``text`` rid of boilerplate, and n_lines and n_dropped of each row.

    ``force``: "arrays", "broadcast" or "shuffle", for tests; else the measured sizes decide.
    """
    w = Working(pages.columns)
    found = cut(boilerplate(pages, site=site, text=text, ratio=ratio, min_pages=min_pages, per_text=per_text))
    n, most = found.groupBy(SITE).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    way = force or ("shuffle" if n > broadcast_rows else "broadcast" if most > site_lines else "arrays")
    given = col(text)
    n_lines = F.when(given.isNull(), F.lit(0)).otherwise(F.size(_lines(given)))
    if way == "arrays":
        by_site = F.broadcast(found.groupBy(F.col(SITE).alias(w.site)).agg(F.collect_list(LINE_HASH).alias(w.bad)))
        joined = pages.withColumn(w.site, col(site)).join(by_site, w.site, "left")
    else:
        # Row ids are read by two branches, which must see the same ones: they are written first.
        rows = written(pages.withColumn(w.row, F.monotonically_increasing_id()), "pages")
        own = rows.select(w.row, col(site).alias(SITE), F.explode(_hashes(given)).alias(LINE_HASH))
        if way == "broadcast":
            met = own.join(F.broadcast(found), [SITE, LINE_HASH])
        else:
            salted = found.select(SITE, LINE_HASH, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(w.salt))
            met = own.withColumn(w.salt, F.pmod(F.hash(w.row), F.lit(salts))).join(salted, [SITE, LINE_HASH, w.salt])
        joined = rows.join(met.groupBy(w.row).agg(F.collect_list(LINE_HASH).alias(w.bad)), w.row, "left")
    cleaned, dropped = _strip(given, F.col(w.bad))
    kept = [cleaned.alias(c) if c.lower() == text.lower() else col(c) for c in others(pages.columns, RESULTS)]
    return joined.select(*kept, n_lines.alias("n_lines"), dropped.alias("n_dropped"))
