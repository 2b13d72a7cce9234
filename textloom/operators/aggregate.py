"""Aggregates by an item's value, job totals, and the measures with the largest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.ShortType, T.DecimalType)
#: Measures that go into the totals.
TOTALS = ("ext", "file_nbnc", "file_comment", "file_machine", "dupe_nbnc", "length", "file_content", "file_dead", "file_ignored", "routine_complexity", "search_total")


def by_key(items: DataFrame, key: str, names: list[str] | str = "all", order: str = "path", threshold: tuple[str, float] | None = None) -> DataFrame:
    """Group items by ``key``: numbers add up, lists are joined in order, maps merge (their numbers add up, their lists are joined), others keep the last value.

    aggregate_count counts items; rows whose threshold column isn't greater go.
    """
    if key not in items.columns:
        raise ValueError(f"no item {key}")
    names = [c for c in items.columns if c not in (key, order)] if names == "all" else list(names)
    df = items
    aggs = [F.count("*").cast("long").alias("aggregate_count")]
    maps: list[str] = []
    for n in names:
        kind = items.schema[n].dataType
        if n == key:
            continue
        if isinstance(kind, NUMBERS):
            aggs.append(F.sum(n).alias(n))
        elif isinstance(kind, T.ArrayType):
            lists = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(n).alias("v"))))
            aggs.append(F.flatten(F.transform(lists, lambda x: x["v"])).alias(n))
        elif isinstance(kind, T.MapType):
            maps.append(n)
        else:
            aggs.append(F.max_by(F.col(n).cast("string"), F.col(order)).alias(n))
    out = df.groupBy(key).agg(*aggs)
    for n in maps:
        flat = df.select(key, F.col(order).alias("_o"), F.explode(n).alias("_mk", "_mv"))
        value = items.schema[n].dataType.valueType
        joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_mv"))), lambda x: x["_mv"]))
        merged = F.sum("_mv") if isinstance(value, NUMBERS) else joined if isinstance(value, T.ArrayType) else F.max_by("_mv", "_o")
        per = flat.groupBy(key, "_mk").agg(merged.alias("_mv")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_mk", "_mv")))).alias(n))
        out = out.join(per, key, "left")
    if threshold:
        if threshold[0] not in out.columns:
            raise ValueError(f"no aggregate {threshold[0]}")
        out = out.filter(F.col(threshold[0]) > threshold[1])
    return out


def unpivoted(measures: DataFrame, names: tuple[str, ...] | list[str] = TOTALS, file_type: str = "ext") -> DataFrame:
    """(measure, file_type, value): a number's value, and 1 for a label."""
    names = [n for n in names if n in measures.columns]
    number = lambda n: isinstance(measures.schema[n].dataType, NUMBERS)
    values = [F.struct(F.lit(n).alias("measure"), (F.col(n).cast("double") if number(n) else F.when(F.col(n).isNotNull(), 1.0)).alias("value")) for n in names]
    kind = F.when(F.col(file_type) == "", ".(NoExt)").otherwise(F.lower(file_type))
    return measures.select(kind.alias("file_type"), F.inline(F.array(*values))).filter("value is not null")


def totals(measures: DataFrame, names: tuple[str, ...] | list[str] = TOTALS, file_type: str = "ext") -> DataFrame:
    """(measure, file_type, total): per measure and file type, and per measure with file_type null."""
    return unpivoted(measures, names, file_type).rollup("measure", "file_type").agg(F.sum("value").alias("total"), F.grouping("measure").alias("_all"), F.grouping("file_type").alias("_each")).filter("_all = 0").select("measure", F.when(F.col("_each") == 0, F.col("file_type")).alias("file_type"), "total")


def top(totals_: DataFrame, k: int) -> DataFrame:
    """The k file types with the largest totals of each measure; equal totals by name."""
    per = totals_.filter("file_type is not null")
    place = F.row_number().over(Window.partitionBy("measure").orderBy(F.desc("total"), "file_type"))
    return per.withColumn("place", place).filter(F.col("place") <= k)


def counters(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(counter, value): folders, files, measured files, result rows."""
    named = lambda df, name, agg: df.agg(agg.cast("long").alias("value")).select(F.lit(name).alias("counter"), "value")
    out = named(files, "folders", F.countDistinct("dir"))
    for df, name, agg in ((files, "files", F.count("*")), (rows, "measured", F.countDistinct("path")), (rows, "rows", F.count("*"))):
        out = out.unionByName(named(df, name, agg))
    return out
