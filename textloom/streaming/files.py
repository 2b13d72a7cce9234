"""Measures over a stream of arriving files.

A file's measures depend on that file alone, so every micro-batch is measured
like a table; what runs on between batches is only the stream's own progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.operators import measure
from textloom.plans.profile import Profile
from textloom.ship import ship
from textloom.sources.files import opened, with_path_parts


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files that come into a folder, as a corpus without roots."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return with_path_parts(raw.select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"), "content"))


def measured(stream: DataFrame, p: Profile, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand each batch's measures to ``sink``; ``once``: what is there, then stop."""
    ship(stream.sparkSession)

    def batch(files: DataFrame, number: int) -> None:
        own = opened(files, p)
        sink(measure.basic(own, p) if p.module == "NBNC" else measure.full(own, p, size="length"), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
