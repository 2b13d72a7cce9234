"""Line dedup by site-relative frequency, in DataFrame functions alone.

A line is boilerplate of a site if it stands on more than ``ratio`` of the
site's pages, on ``min_pages`` pages at least: two, as a line on one page
repeats nothing, however few pages the site has. Lines are counted once a
page; a site is the host of the page's address.

A page of n lines adds n counts, so a site whose pages have m lines on average
has at most m / ratio boilerplate lines: they go back to the pages as one
short list a site, whatever the site's size, and no line is joined.

Null addresses and those without a host share the site ''. A null text has no
line. Lines are compared and kept without ASCII white space around them; blank
ones vanish. Repeated rows
are pages of their own, an empty table gives an empty result, extra columns
pass through, whatever their names, but for those in ``into``, which are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint, columns_of, whole

#: Sites with boilerplate and marks of lines (some 50 bytes each) up to which the per-site table is broadcast.
BROADCAST_SITES, BROADCAST_MARKS = 20_000, 500_000
#: Copies of that table and parts of a site beyond it.
SALTS = 16


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def html_lines(html: Column) -> Column:
    """The lines of a page's visible text: scripts, styles, comments go; a tag ends a line."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<[^>]*>", "\n")
    return text_lines(text)


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r"))), lambda x: x != "")


def _mark(line: Column) -> Column:
    return F.md5(line.cast("binary"))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """One row a site: _site and the array _drop of its boilerplate lines' marks; from rows of (_site, _lines)."""
    totals = pages.groupBy("_site").agg(F.count("*").alias("_pages"))
    counts = pages.select("_site", F.explode(F.array_distinct(F.transform("_lines", _mark))).alias("_mark")).groupBy("_site", "_mark").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_pages)
    over = counts.join(totals, "_site").filter(F.col("_n") > F.lit(ratio) * F.col("_pages"))
    return over.groupBy("_site").agg(F.collect_list("_mark").alias("_drop"))


def dedup(pages: DataFrame, lines: Column | None = None, site: Column | None = None, ratio: float = 0.1, min_pages: int = 2, into: tuple[str, str, str] = ("site", "lines", "kept")) -> DataFrame:
    """Add the site, the array of all lines and the array of those kept."""
    df = pages.select(whole(pages).alias("_in"), (host(F.col("url")) if site is None else site).alias("_site"), (html_lines(F.col("html")) if lines is None else lines).alias("_lines"))
    drop = checkpoint(boilerplate(df.select("_site", "_lines"), ratio, min_pages))
    sites, marks = drop.agg(F.count("*"), F.coalesce(F.sum(F.size("_drop")), F.lit(0))).first()
    if sites <= BROADCAST_SITES and marks <= BROADCAST_MARKS:
        df = df.join(F.broadcast(drop), "_site", "left")
    else:
        salted = drop.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = df.withColumn("_salt", F.pmod(F.xxhash64("_in"), F.lit(SALTS)).cast("int")).join(salted, ["_site", "_salt"], "left")
    kept = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(F.filter("_lines", lambda x: ~F.array_contains(F.col("_drop"), _mark(x))))
    site_, all_, kept_ = into
    return df.select(*columns_of(pages, but=into), F.col("_site").alias(site_), F.col("_lines").alias(all_), kept.alias(kept_))


def digest(pages: DataFrame) -> DataFrame:
    df = dedup(pages.select("page_id", "url", "html"))
    return df.select("page_id", F.col("site").alias("host"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
