"""Quality classifier on random-indexing word vectors.

Every word has a random index vector of a few +1 and -1, drawn from its hash.
Over the whole corpus, a word's context vector sums the index vectors of the
words up to two places away; words share a table of hashed rows. Besides the
words, their shapes (case, end punctuation, sameness with the word before)
form a second stream with rows of its own. A document is pooled to means and
standard deviations of its words' and shapes' vectors, and its length.

A network with one hidden layer, in numpy on the driver, is fitted to the
pooled vectors of labelled rows, at most ``TRAIN_ROWS`` of them, the first by
a hash of their id. On rows left out of that, a temperature is fitted that
makes its probabilities honest. Scoring is one pass over all texts.

Null and empty texts pool to zeros and are scored like any text. Repeated rows
are scored each; of rows with one id the smallest text is learned from, and
labels that repeat an id count once, as the highest. A null
id counts as ''. Without both labels among the training rows the score is the
label's share, or 0.5. An empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the driver takes at most.
TRAIN_ROWS = 20_000
ROWS, DIM, SPARSE, REACH = 1 << 14, 32, 4, 2
#: The last rows belong to shapes.
SHAPES = 1 << 10
HIDDEN = 32
_SEED = 6


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's SPARSE entries."""
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, DIM, (ROWS, SPARSE)), rng.choice([-1, 1], (ROWS, SPARSE))


class _Rows(dict):
    """Word to its row and, in the upper half, the row of its shape; forgets when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        tail = word[len(word.rstrip(b".,;:!?\"')]}|*#$%&<>=_~^+-/\\")) :][-2:]
        shape = b"%d%d%s" % (word[:1].isupper(), min(len(word) // 4, 5), tail)
        value = zlib.crc32(word) % (ROWS - SHAPES) | ROWS - SHAPES + zlib.crc32(shape) % (SHAPES - 2) << 32
        self[word] = value
        return value


def _streams(text: str | None, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    both, hashes = (np.fromiter(map(of, words), dtype=np.int64, count=len(words)) for of in (rows.__getitem__, hash))
    shapes = both >> 32
    shapes[1:][hashes[1:] == hashes[:-1]] = ROWS - 1  # the word before once more
    return both & 0xFFFFFFFF, shapes


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The table of context vectors, counted over all texts; each row scaled to length 1."""
    places, signs = _index_vectors()
    blocks = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = _Rows(), np.zeros(ROWS * DIM, dtype=np.int64)
        gap = np.full(REACH, -1, dtype=np.int64)

        def add(parts: list[np.ndarray]) -> None:
            ids = np.concatenate(parts)
            for o in range(1, REACH + 1):
                a, b = ids[:-o], ids[o:]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for x, y in ((a, b), (b, a)):
                    for k in range(SPARSE):
                        total[:] += np.bincount(x * DIM + places[y, k], weights=signs[y, k], minlength=ROWS * DIM).astype(np.int64)

        parts: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                w, s = _streams(t, rows)
                parts += [w, gap, s, gap]
                n += 2 * len(w)
                if n > 400_000:
                    add(parts)
                    parts, n = [], 0
        if n:
            add(parts)
        if total.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            cut = total.reshape(blocks, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([pack(np.ascontiguousarray(c).tobytes()) for c in cut], pa.binary())], names=["block", "part"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for block, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(unpack(part), dtype=np.int64)
                found[block] = found[block] + x if block in found else x
        pack = zstandard.ZstdCompressor(level=1).compress
        for block, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(x.tobytes())], pa.binary())], names=["block", "part"])

    schema = "block int, part binary"
    parts = docs.select(text).mapInArrow(count, schema)
    # Sums of some partitions each, then sums of those: no task takes the parts of all.
    some = parts.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(8))).repartition(blocks * 8, "block", "_s").drop("_s").mapInArrow(add_up, schema)
    whole = some.repartition(blocks, "block").mapInArrow(add_up, schema)
    total = np.zeros((blocks, ROWS * DIM // blocks), dtype=np.int64)
    for block, part in whole.toLocalIterator():  # blocks of fixed size and number
        total[block] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(part)), dtype=np.int64)
    table = total.reshape(ROWS, DIM).astype(np.float32)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)


def pooled(text: str | None, table: np.ndarray, rows: _Rows) -> np.ndarray:
    words, shapes = _streams(text, rows)
    out = np.zeros(4 * DIM + 2, dtype=np.float32)
    for i, ids in enumerate((words, shapes)):
        if len(ids):
            v = table[ids]
            mean = v.mean(axis=0)
            out[2 * i * DIM : (2 * i + 1) * DIM] = mean
            out[(2 * i + 1) * DIM : (2 * i + 2) * DIM] = np.sqrt(np.maximum(np.einsum("ij,ij->j", v, v) / len(ids) - mean * mean, 0))
    out[-2] = np.log1p(len(words))
    out[-1] = (1 + np.count_nonzero(np.diff(np.sort(words)))) / len(words) if len(words) else 0
    return out


class Network:
    """Standardised input, one hidden layer of tanh, a logit and its temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60):
        rng = np.random.default_rng(_SEED)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (0.0, 1.0)
        self.constant = None if 0 < y.sum() < len(y) else float(y.mean()) if len(y) else 0.5
        if self.constant is not None:
            return
        order = rng.permutation(len(x))
        held, fit = order[: max(1, len(order) // 5)], order[max(1, len(order) // 5) :]
        z = self._standard(x)
        d = z.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for i in range(0, len(fit), 256):
                b = fit[i : i + 256]
                h = np.tanh(z[b] @ p[0] + p[1])
                e = (_sigmoid(h @ p[2] + p[3]) - y[b]) / len(b)
                back = np.outer(e, p[2]) * (1 - h * h)
                grads = [z[b].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], np.array([e.sum()])]
                step += 1
                for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, labels = self._logit(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.mean(np.logaddexp(0, logits / t) - labels * logits / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._standard(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _sigmoid(self._logit(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(_key, _label) of rows to learn from, ``rows`` at most: small enough to broadcast."""
    found = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = found.groupBy(F.col("doc_id").alias("_key")).agg(F.max(column).cast("int").alias("_label"))
    return found.orderBy(F.xxhash64("_key"), "_key").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    table = context_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    few = docs.select("doc_id", "text").join(F.broadcast(labelled(labels, label, rows)), F.col("doc_id") == F.col("_key")).groupBy("_key", "_label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Rows()
        for b in batches:
            x = [pooled(t, shared.value, cache).tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["key", "label", "x"])

    got = few.mapInArrow(run, T.StructType([T.StructField("key", few.schema["_key"].dataType), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])).toArrow()
    order = np.argsort(np.array(got.column("key").to_pylist(), dtype=object), kind="stable") if got.num_rows else []
    x = np.array([np.frombuffer(v, dtype=np.float32) for v in got.column("x").to_pylist()], dtype=np.float64).reshape(got.num_rows, -1)[order] if got.num_rows else np.zeros((0, 4 * DIM + 2))
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)[order] if got.num_rows else np.zeros(0)
    return table, Network(x, (y > 0).astype(np.float64))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], key: str = "doc_id", text: str = "text", into: str = "score") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = shared.value
        cache = _Rows()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x = np.array([pooled(t, table, cache) for t in b.column(1).to_pylist()], dtype=np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(network.score(x), pa.float64())], names=[key, into])

    return docs.select(key, text).mapInArrow(run, T.StructType([docs.schema[key], T.StructField(into, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    df = score(docs, fit(docs, labels))
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
