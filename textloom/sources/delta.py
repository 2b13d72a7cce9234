"""Lines that a newer tree adds to an older one."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import lines_of
from textloom.ship import ship


def delta(new: DataFrame, old: DataFrame, include_deleted: bool = False, key: str = "rel") -> DataFrame:
    """``new`` with content cut down to the lines of a unified difference against the file of the same relative path.

    New files keep all lines, equal files none and get dupe_firstPath, the old
    path. Only changed files are compared line by line; equality is decided
    by the engine on the contents themselves.
    """
    ship(new.sparkSession)
    o = old.select(F.col(key).alias("_key"), F.col("path").alias("_old_path"), F.col("content").alias("_old"))
    df = new.join(o, new[key] == F.col("_key"), "left").drop("_key")
    same = F.col("content").eqNullSafe(F.col("_old")) & F.col("_old_path").isNotNull()
    changes = {"dupe_firstPath": F.when(same, F.col("_old_path")), "_old": F.when(~same, F.col("_old")), "content": F.when(same, F.lit("")).otherwise(F.col("content"))}
    df = df.withColumns(changes).drop("_old_path")
    schema = T.StructType([f for f in df.schema.fields if f.name != "_old"])
    at, was = df.columns.index("content"), df.columns.index("_old")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if o is None or t is None else _changed(o, t, include_deleted) for t, o in zip(b.column(at).to_pylist(), b.column(was).to_pylist(), strict=True)]
            kept = [c for i, c in enumerate(b.columns) if i != was]
            kept[schema.names.index("content")] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=schema.names)

    return df.mapInArrow(run, schema)


def _changed(old: str, new: str, include_deleted: bool) -> str:
    signs = "+-" if include_deleted else "+"
    rows = list(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm="", n=0))[2:]
    return "".join(r[1:] + "\n" for r in rows if r[0] in signs and r[:2] != "@@")


def added_lines(new: DataFrame, old: DataFrame, key: str = "rel") -> DataFrame:
    """(key, line, n): lines that a file holds more often than its old version, as a multiset, without any Python."""
    count = lambda df, name: df.select(key, F.explode(lines_of(F.col("content"))).alias("line")).groupBy(key, "line").agg(F.count("*").alias(name))
    both = count(new, "n_new").join(count(old, "n_old"), [key, "line"], "left")
    return both.select(key, "line", (F.col("n_new") - F.coalesce("n_old", F.lit(0))).alias("n")).filter("n > 0")
