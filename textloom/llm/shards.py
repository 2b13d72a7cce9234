"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; row r of
n has the fractional rank (2r + 1) / 2n. Sorted by it, every stretch of the
whole holds the sources in their overall proportions, and cutting the sequence
into runs of equal length gives shards that each match the mixture.

Both rankings are exact and need no window over a source or over the whole:
rows are dealt out by ranges of the sort key, each partition counts its rows,
and the running totals of those few counts shift the positions inside the
partitions. A source of any size is spread over as many ranges as it fills.

Rows are told apart by their position, so the input is to be a stored table or
a projection of one. Null sources form a source of their own. Rows with
equal keys are interchangeable; an empty table gives an empty result. Input
columns pass through, whatever their names; those named in ``into`` are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint, columns_of, whole

#: monotonically_increasing_id() has the partition above these bits and the position in it below.
_ROW_BITS = 33


def _ranked(df: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Add each row's rank, from 0, inside its group by ``order``; and the group's size as ``into``_of."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    # The ranges come from a sample that a second run may draw differently, so the dealt rows are kept.
    dealt = checkpoint(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    parts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    if group:
        parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), f"{into}_of": F.sum("_n").over(whole)})
    else:  # one row a partition
        parts = parts.withColumns({"_before": F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), f"{into}_of": F.sum("_n").over(Window.partitionBy(F.lit(0)))})
    p = parts.select(*(F.col(c).alias(f"_p_{c}") for c in group), F.col("_part").alias("_p_part"), "_first", "_before", f"{into}_of")
    on = F.col("_part") == F.col("_p_part")
    for c in group:
        on &= F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    return dealt.join(p, on).withColumn(into, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_p_part", "_first", "_before", *(f"_p_{c}" for c in group))


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def interleave(docs: DataFrame, shards: int = 40, seed: int = 8, key: str = "doc_id", source: str = "source", into: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """Add the shard of each row, and its slot, gapless from 0 inside the shard.

    Shards differ by one row at most. Repeated keys are separate rows, ordered
    by the other columns.
    """
    rows = docs.select(whole(docs).alias("_in"), F.monotonically_increasing_id().alias("_row"))
    # The rankings move a few numbers a row; the rows themselves are moved once, to meet their places.
    df = rows.select("_row", F.col("_in").getField(source).alias("_src"), shuffle_key(F.col("_in").getField(key), seed).alias("_h"), F.xxhash64("_in").alias("_tie"))
    df = _ranked(df, ["_src"], ["_h", "_tie"], "_rank")
    df = df.withColumn("_share", (2 * F.col("_rank") + 1) / (2 * F.col("_rank_of"))).drop("_rank", "_rank_of")
    df = _ranked(df, [], ["_share", "_src", "_h", "_tie"], "_pos")
    shard = F.expr(f"cast(((_pos + 1) * {shards} - 1) div _pos_of as int)")
    start = F.expr(f"(_shard * _pos_of) div {shards}")
    places = df.withColumn("_shard", shard).select("_row", F.col("_shard").alias("_s"), (F.col("_pos") - start).alias("_p"))
    return rows.join(places, "_row").select(*columns_of(docs, but=into), F.col("_s").alias(into[0]), F.col("_p").alias(into[1]))


def write(docs: DataFrame, path: str, **options) -> None:
    """interleave() and write one folder a shard, rows in slot order."""
    df = interleave(docs, **options)
    shard, slot = options.get("into", ("shard", "slot"))
    n = options.get("shards", 40)
    df.repartition(n, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
