"""Groups of texts whose word shingles have a Jaccard similarity of LEAST or more, without loss.

A text is the set of its word shingles' 64-bit hashes; texts with equal sets
are one node, which has the SimHash fingerprint of its set.

Candidates come from two sides: nodes whose fingerprints are close
(simhash.py), and nodes that meet at one of their rarest shingles, as the bits
can't find them all. Two sets at a similarity of t or more share at least
ceil(t * n) of the n members of either, so in any common order of all shingles
their first n - ceil(t * n) + 1 members meet. The order is by how often a
shingle's bucket of hashes occurs in the table, rare ones first, so that what
many texts share (a common passage) is looked up last. Counts of ``BUCKETS``
buckets have a fixed size; they only decide how much is compared.

Where many meet, each is compared with its next few in a first round, with
more in a second, and with all in a last one, each time only with those of
other groups; components of the links so far are the groups. So a large group
of near copies is joined up by few pairs, and no pair that could link two
groups is left out.

Nodes that meet are candidates unless their sizes and the places where they
meet rule the similarity out. Of the places where two similar sets meet, the
first one counts: all that they share comes from there on, so sets with many
rare members of their own are never paired. Nor are those whose fingerprints
differ in more than ``FAR`` of 256 bits: sets at 0.8 differ in a fifth of them
at most on average, so a link is lost by that with a probability under 10^-10.
A candidate is a link if the whole sets, taken from the texts again, have the
similarity. Sets of all texts are never stored.

A null text is an empty one; empty texts are one node. Texts under ``shingle``
words have a single shingle. Repeated rows are members of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import SHARES, forget, runs, stored
from textloom.llm.components import components

#: Similarity of a link, as a fraction: 0.8.
OVER, UNDER = 4, 5
#: Bits of the 256 of two fingerprints that differ at most.
FAR = 96
#: Buckets of the shingle counts, and the slices in which they are added up.
BUCKETS, SLICES = 1 << 20, 16
#: Compared nodes up to which their row numbers are broadcast, so that no other texts are shuffled.
BROADCAST_NODES = 1_000_000
#: The neighbours, in the order of those that meet, that each is compared with in each round; the last one takes all.
ROUNDS = ((1, 8), (9, 64), (65, None))
#: Copies of a text beyond which, and beyond that share of all rows, only one is looked at.
COPIES = 1000
_WORDS = 4
_F = [f"f{i}" for i in range(_WORDS)]


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of the text's shingles, as sorted 64-bit hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(parts))
    hash_ = xxhash.xxh3_64_intdigest
    return np.unique(np.array([hash_(line[a:b]) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


def node_of(members: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(members.tobytes(), 8), dtype=np.uint64).view(np.int64))


def fingerprint(members: np.ndarray) -> np.ndarray:
    """Four words of the majority of the members' hashes, bit by bit; the first of the hashes themselves, the others of what they are mixed to."""
    counts = np.zeros(64 * _WORDS, dtype=np.int64)
    for at in range(0, len(members), 4096):
        x = members[at : at + 4096]
        mixed = [x]
        for _ in range(_WORDS - 1):
            x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed.append(x ^ x >> np.uint64(32))
        counts += np.unpackbits(np.stack(mixed, axis=1).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(members), bitorder="little").view("<u8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return UNDER * shared >= OVER * (len(both) - shared)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(_row, _id, node, f0 ..) from (_row, _id, _text); and rows of (slice, part), a partition's shingle counts by bucket."""
    key_types = [docs.schema[c].dataType for c in ("_row", "_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_row", "_id", "node", *_F, "slice", "part"]
        total = np.zeros(BUCKETS, dtype=np.int64)
        types: list[pa.DataType] = []
        for whole in batches:
            types = whole.schema.types
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                sets = [shingles(t, shingle) for t in b.column(2).to_pylist()]
                total += np.bincount(np.concatenate(sets) % np.uint64(BUCKETS), minlength=BUCKETS)
                node = pa.array([node_of(x) for x in sets], pa.int64())
                f = np.stack([fingerprint(x) for x in sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, *(pa.array(np.ascontiguousarray(f[:, i])) for i in range(_WORDS)), pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
        if total.any():
            none = [pa.nulls(SLICES, t) for t in (types[0], types[1], *[pa.int64()] * (1 + _WORDS))]
            parts = [x.tobytes() for x in total.astype(np.uint32).reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)

    fields = [T.StructField(c, t) for c, t in zip(("_row", "_id"), key_types, strict=True)]
    fields += [T.StructField(c, T.LongType()) for c in ("node", *_F)] + [T.StructField("slice", T.IntegerType()), T.StructField("part", T.BinaryType())]
    return docs.select("_row", "_id", "_text").mapInArrow(run, T.StructType(fields))


def _counts(parts: DataFrame) -> np.ndarray:
    """Shingles of all rows by bucket, from (slice, part)."""
    width = BUCKETS // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total.setdefault(k, np.zeros(width, dtype=np.int64))
                total[k] += np.frombuffer(part, dtype=np.uint32 if len(part) == 4 * width else np.int64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "part"])

    counts = np.zeros((SLICES, width), dtype=np.int64)
    # Sums of some partitions each, then sums of those: no task takes the parts of all.
    some = parts.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(8))).repartition(SLICES * 8, "slice", "_s").drop("_s").mapInArrow(add, "slice int, part binary")
    for k, part in some.repartition(SLICES, "slice").mapInArrow(add, "slice int, part binary").toLocalIterator():  # one row a slice
        counts[k] += np.frombuffer(bytes(part), dtype=np.int64)
    return counts.reshape(-1)


def _entries(docs: DataFrame, shingle: int, counts: np.ndarray, hot: dict[int, int]) -> DataFrame:
    """(shingle, node, at): a node's first shingles; at: their place, below the set's size in the upper half.

    Of a hot node, {node: row}, only that row has entries.
    """
    shared = docs.sparkSession.sparkContext.broadcast((counts, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, only = shared.value
        none = np.zeros(0, dtype=np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                parts, nodes, at = [none.view(np.uint64)], [none], [none]
                for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = shingles(t, shingle)
                    node, n = node_of(x), len(x)
                    if not n or only.get(node, row) != row:
                        continue
                    k = n - -(-OVER * n // UNDER) + 1
                    parts.append(x[np.lexsort((x, counts[x % np.uint64(BUCKETS)]))[:k]])
                    nodes.append(np.full(k, node, dtype=np.int64))
                    at.append((n << 32) + np.arange(k, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(at))], names=["shingle", "node", "at"])

    return docs.select("_row", "_text").mapInArrow(run, "shingle long, node long, at long")


def _possible(at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets whose first common member has these places can have the similarity: no other lies before it."""
    n, p = at >> 32, at & 0xFFFFFFFF
    most = np.minimum(n[i] - p[i], n[j] - p[j])
    return (UNDER + OVER) * most >= OVER * (n[i] + n[j])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])


def _met(entries: DataFrame) -> DataFrame:
    """The entries whose shingle another node has too."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["shingle", "node", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, node, at in runs(batches, names):
            if not len(x):
                continue
            # Copies of a text have made equal entries.
            new = np.append(True, (x[1:] != x[:-1]) | (node[1:] != node[:-1]))
            x, node, at = x[new], node[new], at[new]
            start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            size = np.diff(np.append(start, len(x)))
            own = np.flatnonzero(np.repeat(size, size) > 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x[own], node[own], at[own])], names=names)

    return entries.repartition(n, "shingle").sortWithinPartitions("shingle", "node").mapInArrow(run, "shingle long, node long, at long")


def _across(met: DataFrame, groups: DataFrame | None, low: int, high: int | None) -> DataFrame:
    """Pairs that meet, of nodes of different groups so far, each with its ``low``-th to ``high``-th next."""
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["shingle", "node", "at", "label"]
    label = met.withColumn("label", F.col("node")) if groups is None else met.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, node, at, label in runs(batches, names):
            if not len(x):
                continue
            start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            size = np.diff(np.append(start, len(x)))
            mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
            end = np.repeat(start + size, size)
            i, gap = np.flatnonzero(np.repeat(mixed, size)), low
            while (high is None or gap <= high) and len(i := i[i + gap < end[i]]):
                j = i + gap
                ok = (label[i] != label[j]) & _possible(at, i, j)
                if ok.any():
                    yield _pairs(node[i[ok]], node[j[ok]])
                gap += 1

    return label.select(*names).repartition(n, "shingle").sortWithinPartitions("shingle", "node").mapInArrow(run, "a long, b long").distinct()


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose fingerprints don't rule the similarity out."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(f).alias(f"{side}{f}") for f in _F)), side)
    differ = sum((F.bit_count(F.col(f"a{f}").bitwiseXOR(F.col(f"b{f}"))) for f in _F), F.lit(0))
    return pairs.filter(differ <= FAR).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The pairs, a stored table, whose whole sets have the similarity."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    needed = stored(needed.join(nodes, "node").select(F.col("least._row").alias("_row"), "node"))
    few = F.broadcast(needed) if needed.count() <= BROADCAST_NODES else needed

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "set"])

    sets = stored(docs.select("_row", "_text").join(few, "_row").select("node", "_text").mapInArrow(of, "node long, set binary"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    links = stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    forget(needed, sets)
    return links


def least_rows(docs: DataFrame, shingle: int, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(_row) of each group's smallest id; from (_row, _id, _text), rows told apart by _row, null ids first.

    ``close`` gives pairs (a, b) of nodes (node, f0 ..) whose fingerprints are close.
    """
    signatures = stored(_signatures(docs, shingle))
    rows = signatures.filter("slice is null")
    nodes = stored(rows.groupBy("node").agg(F.min(F.struct(F.col("_id").alias("id"), F.col("_row"))).alias("least"), F.count("*").alias("_n"), *(F.first(f).alias(f) for f in _F)))
    most = max(COPIES, rows.count() // SHARES)
    hot = {r[0]: r[1] for r in nodes.filter(F.col("_n") > most).select("node", "least._row").toLocalIterator()}  # under SHARES
    counts = _counts(signatures.filter("slice is not null").select("slice", "part"))
    met = stored(_met(_entries(docs, shingle, counts, hot)))
    groups = links = None
    for low, high in ROUNDS:
        pairs = _near(_across(met, groups, low, high), nodes)
        if links is None:
            pairs = pairs.unionByName(close(nodes).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        pairs = stored(pairs)
        if links is None or not pairs.isEmpty():
            found = _verified(pairs, docs, nodes, shingle)
            links = found if links is None else links.unionByName(found)
            groups = stored(components(links))
        forget(pairs)
    forget(met)
    of = nodes.join(groups, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("least").alias("least"))
    kept = stored(of.select(F.col("least._row").alias("_row")))
    forget(signatures, nodes)
    return kept
