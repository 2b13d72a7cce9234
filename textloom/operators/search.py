"""Pattern search: over classified code lines, raw lines, or whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.patterns import groups, java
from textloom.functions.text import cut, first_group, printable, strip, without_nulls
from textloom.operators import lines as L
from textloom.operators.measure import classified
from textloom.plans.config import Param, distinct_params
from textloom.plans.profile import Profile, profile


def first_match(target: Column, params: tuple[Param, ...], ignore_case: bool = True) -> tuple[Column, Column, Column]:
    """(hit, match, pattern): the first positive in order, unless a negative matches too."""
    params = distinct_params(params)
    rx = lambda p: java(p.regex, ignore_case)
    match, raw = F.lit(None).cast("string"), F.lit(None).cast("string")
    hit, no = F.lit(False), F.lit(False)
    for p in reversed([p for p in params if p.positive]):
        own = target.rlike(rx(p))
        match = F.when(own, first_group(target, rx(p), groups(p.regex))).otherwise(match)
        raw = F.when(own, F.lit(p.raw)).otherwise(raw)
        hit |= own
    for p in params:
        if not p.positive:
            no |= target.rlike(rx(p))
    return hit & ~no, match, raw


def code_search(files: DataFrame, params: tuple[Param, ...], p: Profile | str = "Code", key: str = "path", text: str = "content") -> DataFrame:
    """(key, search_linenum, search_line, search_match, search_regex, search_total): hits on code, on comments, or both, as the profile says."""
    p = profile(p) if isinstance(p, str) else p
    df = classified(files, p, key, text, crc=False)
    eligible = F.col("in_comment") if p.only_comments else F.lit(True) if p.search_comments else ~F.col("in_comment")
    df = df.filter((F.col("block") == p.measured_block) & ~L.has(L.SKIPPED) & ~L.has(L.TRUE_BLANK) & ~L.has(L.FAUX_BLANK) & eligible)
    target = F.col("line") if p.search_strings else L.stripped(F.col("line"), p)
    df = df.withColumn("_t", target)
    if not p.search_comments:
        df = df.withColumn("_t", L.without_inlines(F.col("_t"), p))
    return _hits(df, params, p.search_ignore_case, key, cut(strip(F.col("line"))), match=lambda m: cut(strip(m)))


def raw_search(files: DataFrame, params: tuple[Param, ...], p: Profile | str = "Search", key: str = "path", text: str = "content") -> DataFrame:
    """The same over every line as it is; adds file_total."""
    p = profile(p) if isinstance(p, str) else p
    df = L.pieces(files.select(key, text), p, key, text).withColumn("_t", without_nulls(F.col("raw")))
    totals = files.select(key, F.coalesce(F.size(L.lines_of(F.col(text))), F.lit(0)).cast("long").alias("file_total"))
    clean = lambda c: printable(cut(strip(c)))
    return _hits(df, params, p.search_ignore_case, key, clean(F.col("_t")), match=clean).join(totals, key)


def _hits(df: DataFrame, params: tuple[Param, ...], ignore_case: bool, key: str, line: Column, match) -> DataFrame:
    hit, found, raw = first_match(F.col("_t"), params, ignore_case)
    df = df.filter(hit).select(key, F.col("line_no").cast("long").alias("search_linenum"), F.col("piece_no").alias("_piece"), line.alias("search_line"), match(found).alias("search_match"), F.substring(strip(raw), 1, 255).alias("search_regex"))
    return df.withColumn("search_total", F.count("*").over(Window.partitionBy(key))).drop("_piece")


def multi_line_search(files: DataFrame, params: tuple[Param, ...], p: Profile | str = "Search", key: str = "path", text: str = "content") -> DataFrame:
    """One first match a file, over the text without newlines."""
    p = profile(p) if isinstance(p, str) else p
    target = without_nulls(F.regexp_replace(text, "\r\n?", "\n"))
    df = files.select(key, target.alias("_t"))
    hit, match, raw = first_match(F.col("_t"), params, p.search_ignore_case)
    return df.filter(hit).select(key, printable(match).alias("search_match"), F.substring(strip(raw), 1, 255).alias("search_regex"), F.lit(1).cast("long").alias("search_total"))
