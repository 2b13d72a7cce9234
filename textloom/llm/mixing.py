"""Mixing sources to target weights, in DataFrame functions alone.

Tokens are summed per source. Each source's target is its weight's share of
all tokens, but no more than ``cap`` times what it has; what the cap cuts off
is shared again by weight until no target is above its cap. The repetition
rate is target / size. Every document is emitted floor(rate) times, and once
more if a hash of seed and key falls below the fraction.

Null texts have no tokens, null sources are a source of their own, last in
order. A source without tokens has rate 0. Rows with one key share the coin.
An empty table gives an empty result. Extra columns pass through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import checkpoint, columns_of, whole, word_count

#: Rows of the per-source table (under 100 bytes each) up to which it is broadcast.
BROADCAST_SOURCES = 50_000


def rank_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, over the sources in code point order."""
    return rank % 3 + 1


def targets(sizes: DataFrame, cap: int = 3, weight=rank_weight) -> DataFrame:
    """Source, source_size and target from rows of (source, size), one row a source.

    The level L at which sum(min(L * weight, cap * size)) is the total lies
    right after the sources that are capped at it; sorted by cap * size /
    weight, running sums give the level behind every prefix, and the first
    prefix whose level stays below the next source's own limit is the answer.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_w", weight(F.row_number().over(by_name) - 1).cast("long"))
    per = per.withColumns({"_cap": F.col("source_size") * cap, "_limit": F.col("source_size") * cap / F.col("_w")})
    prefix = Window.orderBy("_limit", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_capped": F.coalesce(F.sum("_cap").over(prefix), F.lit(0)),
        "_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(prefix), F.lit(0)),
    })
    per = per.withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
    per = per.withColumn("_found", F.min(F.when(F.col("_level") <= F.col("_limit"), F.col("_limit"))).over(everything))
    per = per.withColumn("_at", F.max(F.when((F.col("_limit") == F.col("_found")) & (F.col("_level") <= F.col("_limit")), F.col("_level"))).over(everything))
    target = F.when(F.col("_limit") >= F.col("_found"), F.col("_at") * F.col("_w")).otherwise(F.col("_cap"))
    return per.select("source", "source_size", F.least(target.cast("double"), F.col("_cap").cast("double")).alias("target"))


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) from seed and key: the same in every run."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def rates(docs: DataFrame, cap: int = 3, seed: int = 10, key: str = "doc_id", source: str = "source", size: Column | None = None, weight=rank_weight) -> DataFrame:
    """(_in, _key, _size, _source_size, _target, _copies) of every row; _in is the row itself."""
    size = word_count(F.col("text")) if size is None else size
    df = docs.select(whole(docs).alias("_in"), F.col(key).alias("_key"), F.col(source).alias("_src"), size.alias("_size"))
    per = checkpoint(targets(df.select(F.col("_src").alias("source"), F.col("_size").alias("size")), cap, weight))
    per = per.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    if per.count() <= BROADCAST_SOURCES:  # beyond it a shuffled join, whose hot sources AQE splits
        per = F.broadcast(per)
    df = df.join(per, F.col("_src").eqNullSafe(F.col("_source"))).drop("_source", "_src")
    rate = F.when(F.col("_source_size") > 0, F.least(F.lit(float(cap)), F.col("_target") / F.col("_source_size"))).otherwise(0.0)
    times = F.floor(rate)
    return df.withColumn("_copies", (times + F.when(coin(F.col("_key"), seed) < rate - times, 1).otherwise(0)).cast("int"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them, with the columns of the input."""
    df = rates(docs, **options).filter("_copies > 0")
    return df.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns_of(docs))
