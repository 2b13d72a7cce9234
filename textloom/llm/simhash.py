"""SimHash near-dedup by anchor-point covering.

A text's fingerprint holds, bit by bit, the majority of its word shingles'
hashes. Equal fingerprints are one node. To find the nodes within ``most``
bits of each other, the fingerprint is cut into blocks of 23 bits, whose
anchors are the words of a covering code of radius 3 (golay.py): every string
has an anchor within 3 bits. Anchors are used in pairs, one for each of two
blocks, so there are 2^24 of them for each two blocks and few nodes at each.

No link is lost: of two fingerprints that differ in ``most`` bits or fewer,
some two blocks differ in t = 2 * most // blocks bits at most, taken together.
A string half way between the two differs from either in (t + 1) // 2 bits at
most, and its own pair of anchors lies no more beyond radius 3, block by block
and added up, from both. So each node is replicated to every pair of anchors
whose distances exceed 3 by (t + 1) // 2 in all, and at each pair of anchors
the nodes that reached it are compared. With 64 bits and ``most`` 4 that is
some 29 places a node, and two nodes meet at one in 120,000 by chance.

Where more than ``CHUNK`` nodes meet they are dealt to chunks, and each two
chunks are compared in a task of their own. A task hands on no link between
nodes that its links connect already, so a group of any size adds links in
proportion to its members. Components of the links give the groups.

A null text is an empty one; a text without words has fingerprint zero, and is
linked like any other. Null ids are ignored by the smallest id unless a group
has no other. Repeated rows are members of their own. An empty table gives an
empty result; other columns aren't read, or pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import golay, jaccard
from textloom.llm.common import checkpoint, columns_of, join_hot, runs, stored, whole
from textloom.llm.components import components

#: Nodes at a pair of anchors that are compared at once.
CHUNK = 4096
#: Pairs of anchors with more nodes (8 bytes each) up to which they are broadcast.
BROADCAST_BUCKETS = 1_000_000


def fingerprint(text: str | None, shingle: int = 4, words: int = 1) -> list[int]:
    """``words`` unsigned 64-bit integers, lowest bits first. One: majority of XXH64 with seed 42; more: of XXH3 with seeds from 42."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return [0] * words
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(parts))
    pieces = [line[a:b] for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    if words == 1:
        raw = np.array([xxhash.xxh64_intdigest(p, 42) for p in pieces], dtype="<u8")
    else:
        raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p, 42 + i) for p in pieces for i in range((words + 1) // 2)]), dtype="<u8").reshape(len(pieces), -1)[:, :words]
    n = len(pieces)
    counts = np.zeros(64 * words, dtype=np.int64)
    for i in range(0, n, 8192):
        part = np.ascontiguousarray(raw[i : i + 8192]).view(np.uint8).reshape(-1, 8 * words)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").view("<u8").tolist()


def fingerprints(docs: DataFrame, key: str, text: str = "text", shingle: int = 4, words: int = 1) -> DataFrame:
    """(key, f0 .. f<words - 1>): the fingerprint's words as longs."""
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle, words) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(found[:, i]).view(np.int64)) for i in range(words))], names=[key, *names])

    fields = [docs.schema[key], *(T.StructField(n, T.LongType()) for n in names)]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).view(np.uint64) for n in names]


def placed(nodes: DataFrame, words: int, most: int) -> DataFrame:
    """Rows (bucket, node, f..): every node at every pair of anchors that it reaches."""
    names = [f"f{i}" for i in range(words)]
    cut = golay.blocks(64 * words)
    two = list(combinations(range(len(cut)), 2)) if len(cut) > 1 else []
    slack = (2 * most // len(cut) + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                f, node = _columns(b, names), b.column("node").to_numpy()
                by_excess = []
                for first, length in cut:
                    rows, anchor, excess = golay.reached(golay.block_of(f, first, length), slack)
                    by_excess.append([(rows[excess == e], anchor[excess == e]) for e in range(slack + 1)])
                for k, (i, j) in enumerate(two):
                    for e in range(slack + 1):
                        for d in range(slack + 1 - e):
                            rows, x, y = _crossed(by_excess[i][e], by_excess[j][d], b.num_rows)
                            bucket = (k << 2 * golay.MESSAGE) + (x.astype(np.int64) << golay.MESSAGE) + y
                            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node[rows]), *(pa.array(c.view(np.int64)[rows]) for c in f)], names=["bucket", "node", *names])

    fields = [T.StructField("bucket", T.LongType()), T.StructField("node", T.LongType()), *(T.StructField(n, T.LongType()) for n in names)]
    return nodes.select("node", *names).mapInArrow(run, T.StructType(fields))


def _crossed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, x, y) from (row, x) and (row, y); rows are under ``n``."""
    order = np.argsort(b[0], kind="stable")
    size = np.bincount(b[0], minlength=n)
    begin = np.cumsum(size) - size
    times = size[a[0]]
    rows = np.repeat(a[0], times)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
    return rows, np.repeat(a[1], times), b[1][order][begin[rows] + inside]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the edges (a, b): the smallest one of what they connect."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, label[label]):
            label = label[label]


def close_pairs(bucket: np.ndarray, part: np.ndarray, node: np.ndarray, f: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``most`` bits that connect all such pairs of a bucket; where ``part`` isn't -1, of its different parts.

    Rows are sorted by bucket.
    """
    ids, of = np.unique(node, return_inverse=True)
    label = np.arange(len(ids))
    end = np.searchsorted(bucket, bucket, side="right")
    a, b = [], []
    i, gap = np.arange(len(bucket)), 1
    while len(i := i[i + gap < end[i]]):
        j = i + gap
        distance = np.zeros(len(i), dtype=np.uint16)
        for c in f:
            distance += np.bitwise_count(c[i] ^ c[j])
        ok = (distance <= most) & ((part[i] < 0) | (part[i] != part[j]))
        ok[ok] = label[of[i[ok]]] != label[of[j[ok]]]
        if ok.any():
            x, y = of[i[ok]], of[j[ok]]
            a.append(ids[x])
            b.append(ids[y])
            label = _joined(label, x, y)
        gap += 1
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(nodes: DataFrame, words: int, most: int) -> DataFrame:
    """Pairs (a, b) within ``most`` bits that connect all such nodes; nodes: (node, f..), one row a fingerprint."""
    names = [f"f{i}" for i in range(words)]
    rows = placed(nodes, words, most)
    full = checkpoint(rows.groupBy("bucket").agg(F.count("*").alias("_k")).filter(F.col("_k") > CHUNK).select("bucket", F.ceil(F.col("_k") / CHUNK).cast("int").alias("chunks")))
    n_full = full.count()
    if n_full:
        own = rows.join(F.broadcast(full) if n_full <= BROADCAST_BUCKETS else full, "bucket", "left")
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
        own = own.withColumn("_c", F.coalesce(chunk, F.lit(0))).withColumn("_o", F.explode(cells))
        # In the cell of one chunk all are compared, in that of two those of one with those of the other.
        rows = own.select("bucket", F.least("_c", "_o").alias("x"), F.greatest("_c", "_o").alias("y"), F.when(F.col("_c") == F.col("_o"), -1).otherwise(F.col("_c")).alias("part"), "node", *names)
    else:
        rows = rows.select("bucket", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(-1).alias("part"), "node", *names)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.xxhash64("bucket", "x", "y").alias("cell"), "part", "node", *names).repartition(n, "cell").sortWithinPartitions("cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, part, node, *f in runs(batches, ["cell", "part", "node", *names]):
            several = np.flatnonzero(np.append(False, cell[1:] == cell[:-1]) | np.append(cell[:-1] == cell[1:], False)) if len(cell) else []
            if len(several):
                x, y = close_pairs(cell[several], part[several], node[several], [c[several].view(np.uint64) for c in f], most)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, words: int = 1, most: int = 4) -> DataFrame:
    """(key, f.., component): the smallest key of all rows that links reach, itself included; one row a row of ``docs``."""
    names = [f"f{i}" for i in range(words)]
    node = F.col("f0") if words == 1 else F.xxhash64(*names)
    docs = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    rows = stored(fingerprints(docs, "_k", "_t", shingle, words).withColumn("node", node))
    # Equal fingerprints meet before anything else, so copies of a text are one node.
    nodes = stored(rows.groupBy("node", *names).agg(F.min("_k").alias("least"), F.count("*").alias("_n")))
    found = stored(components(links(nodes, words, most)))
    least = nodes.join(found, "node").groupBy("label").agg(F.min("least").alias("component"), F.count("*").alias("_m"))
    of = join_hot(found, stored(least), "label", "_m", found.count()).select("node", "component")
    of = stored(nodes.join(of, "node", "left").select("node", "_n", F.coalesce("component", "least").alias("component")))
    return join_hot(rows, of, "node", "_n", rows.count()).select(F.col("_k").alias(key), *names, "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, most: int = 4) -> DataFrame:
    """One row of each group of near copies, that with the smallest key, with the columns of the input.

    Near copies are texts whose ``shingle``-word shingles have a Jaccard
    similarity of 0.8 or more. The fingerprints within ``most`` bits, found at
    their anchors, are candidates, which are counted exactly; as no number of
    bits tells 0.8 from 0.79, an exact join of shingles finds the links that
    are left (jaccard.py). ``docs`` is to be a stored table: rows are told
    apart by their position in it.
    """
    rows = docs.select(whole(docs).alias("_in"), F.monotonically_increasing_id().alias("_row"))
    kept = jaccard.least_rows(rows.select("_row", F.col("_in").getField(key).alias("_id"), F.col("_in").getField(text).alias("_text")), shingle, lambda nodes: links(nodes.select("node", "f0"), 1, most))
    return rows.join(kept, "_row", "left_semi").select(*columns_of(docs))


def digest(docs: DataFrame) -> DataFrame:
    df = grouped(docs.select("doc_id", "text"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
