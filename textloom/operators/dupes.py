"""Duplicate files, by size within a tolerance or by checksum of code."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.ship import ship


def by_checksum(files: DataFrame, crc: str = "nbnc_crc", entry: str | None = None, key: str = "path") -> DataFrame:
    """Add dupe_firstPath to every file whose checksum an earlier path has, under the same entry; null for the others.

    The first path is a minimum, combined before the shuffle; a checksum of any
    number of files is one row in the table that is joined back.
    """
    return _first(files, [crc, *([entry] if entry else [])], key)


def by_size(files: DataFrame, tolerance: int = 0, size: str = "length", name: str = "name", config: str | None = None, key: str = "path") -> DataFrame:
    """The same for files of one name and config whose sizes lie within ``tolerance`` bytes of a size seen before.

    Without tolerance a minimum by size decides. With one, sizes in path order
    are taken one by one: a size near an earlier bucket's belongs to it, any
    other opens a bucket.
    """
    group = [name, *([config] if config else [])]
    if tolerance <= 0:
        return _first(files, [*group, size], key)
    ship(files.sparkSession)
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Per name and size, the first path suffices: equal sizes fall into the same bucket.
    sizes = files.groupBy(*group, size).agg(F.min(key).alias("_first"))
    # Where neighbouring sizes lie further apart than the tolerance, no bucket reaches across: the stretches between are dealt out one by one.
    by_size = Window.partitionBy(*group).orderBy(size)
    apart = F.coalesce(F.col(size) - F.lag(size).over(by_size) > tolerance, F.lit(True))
    sizes = sizes.withColumn("_stretch", F.sum(F.when(apart, 1).otherwise(0)).over(by_size)).select(*group, "_stretch", size, "_first")
    sizes = sizes.repartition(n, *group, "_stretch").sortWithinPartitions(*group, "_stretch", "_first")
    at = sizes.columns.index(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, first = None, [], []
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = row[: len(group) + 1]
                if own != last:
                    last, held, first = own, [], []
                # Buckets by size; of those within reach the oldest one, whose path is the smallest, takes the size.
                i, j = bisect_left(held, row[at] - tolerance), bisect_right(held, row[at] + tolerance)
                hit = min(first[i:j], default=None)
                if hit is None:
                    held.insert(i, row[at])
                    first.insert(i, row[-1])
                out.append(hit or row[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, "_bucket"])

    found = sizes.mapInArrow(run, T.StructType([*sizes.schema.fields, T.StructField("_bucket", T.StringType())])).drop("_first", "_stretch")
    return _marked(files, found, [*group, size], "_bucket", key)


def _first(files: DataFrame, group: list[str], key: str) -> DataFrame:
    found = files.filter(F.col(group[0]).isNotNull()).groupBy(*group).agg(F.min(key).alias("_bucket"))
    return _marked(files, found, group, "_bucket", key)


def _marked(files: DataFrame, found: DataFrame, group: list[str], bucket: str, key: str) -> DataFrame:
    df = files.join(found, group, "left")
    return df.withColumn("dupe_firstPath", F.when(F.col(bucket) != F.col(key), F.col(bucket))).drop(bucket)


def suppressed(files: DataFrame, keep: tuple[str, ...] = ("path", "name", "ext", "dir", "nbnc_crc", "out_file")) -> DataFrame:
    """Duplicates lose all but ``keep``, tags and folder levels; they get dupe_nbnc, their own path as dupe_fileName and the first one's folders as dupe_dir1 to dupe_dir4."""
    is_dupe = F.col("dupe_firstPath").isNotNull()
    df = files.withColumn("dupe_nbnc", F.when(is_dupe, F.col("file_nbnc"))) if "file_nbnc" in files.columns else files
    folders = F.split(F.regexp_extract("dupe_firstPath", "^/?(.*)/[^/]*$", 1), "/")
    more = {"dupe_fileName": F.when(is_dupe, F.col("path"))} | {f"dupe_dir{i + 1}": F.when(is_dupe, F.coalesce(F.get(folders, F.lit(i)), F.lit(""))) for i in range(4)}
    df = df.withColumns(more)
    stay = {*keep, "dupe_firstPath", "dupe_nbnc", *more, *(c for c in df.columns if c.rstrip("0123456789") in ("tag", "dir"))}
    return df.select(*(F.col(c) if c in stay else F.when(F.col("dupe_firstPath").isNull(), F.col(c)).alias(c) for c in df.columns))


def statistics(files: DataFrame, group: list[str], size: str = "length") -> DataFrame:
    """One row: groups of several files, and the total size of these files, the first ones included."""
    per = files.groupBy(*group).agg(F.count("*").alias("_n"), F.sum(size).alias("_size")).filter("_n > 1")
    return per.agg(F.count("*").alias("dupe_groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("dupe_files"), F.coalesce(F.sum("_size"), F.lit(0)).alias("dupe_bytes"))


def ranked(files: DataFrame, group: list[str], key: str = "path") -> DataFrame:
    """Each file's place in its group by path, from 1."""
    return files.withColumn("dupe_place", F.row_number().over(Window.partitionBy(*group).orderBy(key)))
