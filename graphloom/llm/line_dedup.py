"""Line de-duplication by site-relative frequency.

A line is boilerplate of a host if the pages of the host that contain it are more than a share of all its pages (and
no fewer than a least number, since on a site of one page every line is on all pages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, col, small_enough
from .quality import BLANKS

RATIO_PERCENT, LEAST_PAGES = 5, 5
#: Boilerplate lines that may be broadcast, at 16 bytes each and some overhead for each host.
MOST_BROADCAST = 200_000

#: Line identity: 128 bits of the line without the white space around it.
_ID = "named_struct('a', xxhash64(btrim(l, {b})), 'b', xxhash64(reverse(btrim(l, {b})), length(btrim(l, {b}))))".format(b=BLANKS)
_SOLID = f"btrim(l, {BLANKS}) <> ''"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, text_col: str, host_col: str, percent: int = RATIO_PERCENT, least_pages: int = LEAST_PAGES, work: Workspace | None = None) -> DataFrame:
    """host, line (its identity), pages, host_pages for each line on more than percent of its host's pages.

    A host has at most (lines a page / share) such lines, so the table is small beside the pages.
    """
    work = work or Workspace(docs.sparkSession, "line-dedup")
    base = docs.select(col(host_col).alias("host_"), col(text_col).cast("string").alias("text_"))
    pages = work.save(base.groupBy(F.col("host_").alias("h_")).agg(F.count("*").alias("host_pages")).where(f"host_pages >= {least_pages}"), "hosts")
    on_page = base.select("host_", F.explode(F.expr(f"array_distinct(transform(filter(split(text_, '\\n'), l -> {_SOLID}), l -> {_ID}))")).alias("line"))
    counts = on_page.groupBy("host_", "line.a", "line.b").agg(F.count("*").alias("pages")).where(f"pages >= {least_pages}")
    few = F.broadcast(pages) if small_enough(pages, MOST_BROADCAST) else pages
    hot = counts.join(few, F.col("host_").eqNullSafe(F.col("h_"))).where(f"100 * pages > {percent} * host_pages")
    return work.save(hot.select(F.col("host_").alias("host"), F.struct("a", "b").alias("line"), "pages", "host_pages"), "boilerplate")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host_col: str = "source", percent: int = RATIO_PERCENT, least_pages: int = LEAST_PAGES, kept_col: str | None = None) -> DataFrame:
    """docs with boilerplate lines taken out of the text, every row and column kept, and n_lines, n_dropped behind.

    Lines are parts between newlines, compared without ASCII white space at their ends; blank lines stay.  A null text
    stays null with n_lines 0.  Rows with a null host are one host.  Equal rows count once each as pages.  Texts and lines
    of any length are taken whole.  An empty table gives an empty table.  Columns named n_lines and n_dropped are replaced
    (name others by kept_col as a prefix).  host_of() gives the hosts of URLs.
    """
    n_lines, n_dropped = f"{kept_col or ''}n_lines", f"{kept_col or ''}n_dropped"
    work = Workspace(docs.sparkSession, "line-dedup")
    lines = boilerplate(docs, text_col, host_col, percent, least_pages, work)
    by_host = lines.groupBy(F.col("host").alias("h_")).agg(F.collect_set("line").alias("drop_"))
    if small_enough(lines, MOST_BROADCAST):
        by_host = F.broadcast(by_host)
    own = [c for c in docs.columns if c.lower() not in (n_lines, n_dropped)]
    rows = docs.select(F.struct(*[col(c) for c in own]).alias("row_"), col(host_col).alias("host_"), _lines(col(text_col).cast("string")).alias("lines_"))
    rows = rows.join(by_host, F.col("host_").eqNullSafe(F.col("h_")), "left")
    kept = F.when(F.col("drop_").isNull(), F.col("lines_")).otherwise(F.expr(f"filter(lines_, l -> not ({_SOLID} and array_contains(drop_, {_ID})))"))
    rows = rows.select("row_", "lines_", kept.alias("left_"))
    at = own.index(text_col)
    out = [F.col("row_")[c].alias(c) for c in own]
    out[at] = F.array_join("left_", "\n").alias(text_col)
    solid = F.coalesce(F.size(F.expr(f"filter(lines_, l -> {_SOLID})")), F.lit(0))
    dropped = F.coalesce(F.size("lines_") - F.size("left_"), F.lit(0))
    return rows.select(*out, F.when(F.col("lines_").isNull(), F.lit(0)).otherwise(solid).cast("long").alias(n_lines), F.when(F.col("lines_").isNull(), F.lit(0)).otherwise(dropped).cast("long").alias(n_dropped))
