"""Dependencies and duplicate lines of code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import java
from textloom.functions.text import single_spaced
from textloom.operators.measure import classified, line_class
from textloom.plans.profile import Profile, profile


def _code_lines(files: DataFrame, p: Profile, key: str, text: str) -> DataFrame:
    df = classified(files, p, key, text, crc=False).withColumn("_c", line_class(p))
    return df.filter(F.col("_c").isin("N", "I") & (F.col("block") == p.measured_block)).select(key, "line_no", single_spaced(F.col("line")).alias("_norm"))


def depends(files: DataFrame, p: Profile | str = "Depends", key: str = "path", text: str = "content") -> DataFrame:
    """(key, depend_using, depend_count, depend_lines): import statements of each file with their lines, a file's side by side in the order of their lower-cased text."""
    p = profile(p) if isinstance(p, str) else p
    df = _code_lines(files, p, key, text).filter(F.col("_norm").rlike(java(p.imports, p.ignore_case)))
    # Dealt by file, so that the same partitions serve the groups and their order.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartition(n, key).groupBy(key, F.col("_norm").alias("depend_using")).agg(F.count("*").alias("depend_count"), F.sort_array(F.collect_list("line_no")).alias("depend_lines"))
    return df.sortWithinPartitions(key, F.lower("depend_using"), "depend_using")


def dupe_lines(files: DataFrame, p: Profile | str = "DupeLines", key: str = "path", text: str = "content") -> DataFrame:
    """(key, dupe_crc, dupe_count, dupe_content, dupe_lines): every distinct code line of each file; lines that share a checksum stay apart."""
    p = profile(p) if isinstance(p, str) else p
    df = _code_lines(files, p, key, text).groupBy(key, F.col("_norm").alias("dupe_content")).agg(F.count("*").alias("dupe_count"), F.sort_array(F.collect_list("line_no")).alias("dupe_lines"))
    return df.select(key, F.crc32(F.col("dupe_content").cast("binary")).alias("dupe_crc"), "dupe_count", "dupe_content", "dupe_lines")


def shared_lines(files: DataFrame, least: int = 1, p: Profile | str = "DupeLines", key: str = "path", text: str = "content") -> DataFrame:
    """(dupe_crc, dupe_count, dupe_files, dupe_content): code lines over all files that occur more than ``least`` times.

    Counts are combined before the shuffle; nothing is gathered a line.
    """
    p = profile(p) if isinstance(p, str) else p
    per = _code_lines(files, p, key, text).groupBy(F.col("_norm").alias("dupe_content"), key).agg(F.count("*").alias("_n"))
    whole = per.groupBy("dupe_content").agg(F.sum("_n").alias("dupe_count"), F.count("*").alias("dupe_files")).filter(F.col("dupe_count") > least)
    return whole.select(F.crc32(F.col("dupe_content").cast("binary")).alias("dupe_crc"), "dupe_count", "dupe_files", "dupe_content")
