"""Files to the config entries that measure them.

A file belongs to the nearest folder on its way up that has a config; all of
that config's entries whose filter the file's name matches apply, and each
makes a result of its own. Configs are small by nature: the table of folders
is broadcast up to ``BROADCAST_CONFIGS`` rows, and joined by shuffle beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.config import Entry
from textloom.sources.filters import matches

BROADCAST_CONFIGS = 10_000


def nearest(files: DataFrame, configs: DataFrame) -> DataFrame:
    """Add config_dir: the longest dir of ``configs`` (config_dir) at or above each file's dir; files without one go."""
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ways = files.select("path", "dir").withColumn("_d", F.explode(above))
    small = configs.select(F.col("config_dir").alias("_d")).distinct()
    small = F.broadcast(small) if small.count() <= BROADCAST_CONFIGS else small
    # Folders repeat over files: the nearest config is found once a folder.
    per = ways.select("dir", "_d").distinct().join(small, "_d").groupBy("dir").agg(F.max_by("_d", F.length("_d")).alias("config_dir"))
    return files.join(per, "dir")


def routed(files: DataFrame, configs: dict[str, list[Entry]]) -> DataFrame:
    """One row a file and matching entry: adds config_dir and entry_ord, the entry's place among its config's sorted entries."""
    spark = files.sparkSession
    dirs = spark.createDataFrame([(d,) for d in configs] or [("\x00",)], "config_dir string")
    df = nearest(files, dirs)
    name, ext = F.col("name"), F.col("ext")
    arrays = []
    for d, entries in configs.items():
        hits = [F.when(matches(name, ext, e.file_filters), F.lit(i)) for i, e in enumerate(sorted(entries, key=str))]
        arrays.append(F.when(F.col("config_dir") == d, F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")))
    found = F.coalesce(*arrays) if arrays else F.array().cast("array<int>")
    return df.withColumn("entry_ord", F.explode(found))


def folder_counts(files: DataFrame) -> DataFrame:
    """Add dir_files: how many of the filtered files lie in the file's folder."""
    per = files.groupBy("dir").agg(F.countDistinct("path").alias("dir_files"))
    return files.join(per, "dir")


def preview(files: DataFrame, configs: dict[str, list[Entry]]) -> DataFrame:
    """Distinct (dir, ext, config_dir, entry_ord)."""
    return routed(files, configs).select("dir", "ext", "config_dir", "entry_ord").distinct()


def entries_of(configs: dict[str, list[Entry]]) -> list[tuple[str, int, Entry]]:
    return reduce(lambda a, b: a + b, ([(d, i, e) for i, e in enumerate(sorted(es, key=str))] for d, es in configs.items()), [])
