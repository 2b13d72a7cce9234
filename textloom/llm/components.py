"""Connected components of a graph given by its edges, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import HOT_ROWS, checkpoint, join_hot


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node with an edge; label is the smallest node that it reaches.

    ``edges`` has two columns a and b of one ordered type. Alternates large-star
    and small-star steps: each hooks neighbours to the smallest one, until
    every node hangs on the smallest of its component. Steps need a minimum by
    node, which is combined before the shuffle, and a join back, in which nodes
    with very many edges are dealt with apart (join_hot()). Only counts come to
    the driver. Null ends and loops are left out.
    """
    e = checkpoint(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hooked(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        if 2 * state[0] > HOT_ROWS:
            large = checkpoint(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hooked(large, 2 * state[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = checkpoint(small)
        before, state = state, _state(e)
        if before == state:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _hooked(e: DataFrame, total: int) -> DataFrame:
    """The edges with the smallest of u and its neighbours as m."""
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    return join_hot(e, checkpoint(low) if total > HOT_ROWS else low, "u", "_n", total)


def _state(e: DataFrame) -> tuple[int, int, int]:
    """Tells whether the set of edges has changed."""
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return (r[0], r[1], r[2])
