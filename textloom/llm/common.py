"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the session's spark.checkpoint.dir.

    Where the session names none (local tests), a temporary folder of this
    machine takes its place, once a session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("textloom.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("textloom.shared.dir", at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow intermediate; survives lost executors."""
    sc = df.sparkSession.sparkContext
    at = shared_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like checkpoint(), as compressed Parquet in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more: what came of them is stored itself."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def whole(df: DataFrame) -> Column:
    """The row as one column, so that an operator's own columns can't clash with it."""
    return F.struct(*(F.col(_quoted(c)).alias(c) for c in df.columns))


def columns_of(df: DataFrame, packed: str = "_in", but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``df`` out of whole(), but for those that the operator adds itself."""
    return [F.col(packed).getField(c).alias(c) for c in df.columns if c not in but]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of equal first columns, from batches sorted by them."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = [b.column(n).to_numpy() for n in names]
        last = int(np.searchsorted(c[0], c[0][-1]))
        if last or (held and held[-1][0][-1] != c[0][0]):
            yield [np.concatenate(x) for x in zip(*held, [y[:last] for y in c], strict=True)]
            held = []
        held.append([y[last:] for y in c])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


#: A key with more rows than this, and than that share of all rows, is hot: under SHARES keys are.
#: Fewer rows, of a few numbers each, are some megabytes in one task.
HOT_ROWS, SHARES = 100_000, 100_000


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, one row a key, whose column ``n`` has the key's rows in ``left``, ``total`` in all.

    Keys with very many rows stay where they are: they are few by their
    definition, so their rows of ``right`` are broadcast. Both frames are read
    twice and should be stored. ``n`` is left out of the result.
    """
    most = max(HOT_ROWS, total // SHARES)
    hot = right.filter(F.col(n) > most).drop(n)
    if total <= most or hot.isEmpty():
        return left.join(right.drop(n), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(n) <= most).drop(n), key)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
