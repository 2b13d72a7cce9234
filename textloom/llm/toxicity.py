"""Toxicity as a severity grade, by cumulative-link ordinal regression.

A text's features are the set of its words, without signs around them, and of
their beginnings of four and six bytes, hashed. Grades run from 0 (not toxic) to 3: labels only tell toxic from not,
so toxic training texts are graded by how many telling features they have, cut
into thirds. P(grade <= k) = sigmoid(threshold k - score): one set of weights
for all grades, thresholds in order. The weights are fitted by proximal
gradient steps, whose shrinkage leaves uninformative features at zero. A text's
result is the expected severity, the sum over k of P(grade >= k).

The fit takes ``TRAIN_ROWS`` labelled rows of each label at most, the first by
a hash of their id. How often each feature occurs in them is counted where the
rows are; the driver gets the features that are chosen, ``FEATURES`` a row at
most. Scoring is one pass over all texts.

Null and empty texts have no features and get the severity of the thresholds
alone. Repeated rows are scored each; of rows with one id the smallest text is
learned from, and a repeated label counts once, as the highest. Without both labels nothing is toxic. An empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import forget, stored

#: Labelled rows of each label that the driver takes at most.
TRAIN_ROWS = 6_000
GRADES = 3
#: Hashed features, and those of them that get a weight at most.
SPACE, FEATURES = 1 << 18, 8192
#: A feature's log-odds of toxic against not are that many standard errors above 0, and that large, at least.
LEAST_Z, LEAST_ODDS = 2.5, 1.0
_EDGES = b".,;:!?\"'()[]{}<>#*%&$@^~_+=|/\\-`"
#: Bytes of a word's beginnings that are features of their own.
_STEMS = (4, 6)


def _of_word(word: bytes) -> tuple[int, ...]:
    word = word.strip(_EDGES)
    if not word:
        return ()
    return (zlib.crc32(word) % SPACE, *(zlib.crc32(b"^%d" % n + word[:n]) % SPACE for n in _STEMS if len(word) >= n))


def features(text: str | None) -> np.ndarray:
    words = set((text or "").encode("utf-8", "surrogatepass").lower().split())
    return np.unique(np.array([f for w in words for f in _of_word(w)], dtype=np.int32))


class Model:
    """Weights by hashed feature and the ordered thresholds."""

    def __init__(self, texts: list[np.ndarray], toxic: np.ndarray, steps: int = 300, shrink: float = 1e-3, counts: np.ndarray | None = None):
        """``texts`` need no features but the chosen ones if ``counts`` has the counts of all, by label and feature."""
        self.weights: dict[int, float] = {}
        self.thresholds = np.full(GRADES, 40.0)
        if not 0 < toxic.sum() < len(toxic):
            return
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate(texts)
        if counts is None:
            counts = np.array([np.bincount(flat[toxic[rows] == k], minlength=SPACE) for k in (False, True)])
        chosen, odds, z = chosen_features(counts, np.array([(~toxic).sum(), toxic.sum()]))
        place = np.full(SPACE, -1, dtype=np.int64)
        place[chosen] = np.arange(len(chosen))
        ok = place[flat] >= 0
        rows, cols = rows[ok], place[flat[ok]]
        telling = (odds[chosen] > 2) & (z[chosen] > 4)
        much = np.bincount(rows[telling[cols]], minlength=len(texts))
        cuts = np.quantile(much[toxic], np.arange(1, GRADES) / GRADES)
        grade = np.where(toxic, 1 + np.searchsorted(cuts, much, side="left"), 0)
        self._fit(rows, cols, len(texts), len(chosen), grade, steps, shrink, chosen)

    def _fit(self, rows: np.ndarray, cols: np.ndarray, n: int, d: int, grade: np.ndarray, steps: int, shrink: float, chosen: np.ndarray) -> None:
        w, first, gaps = np.zeros(d), 1.0, np.zeros(GRADES - 1)
        m, v = np.zeros(d + GRADES), np.zeros(d + GRADES)
        for step in range(1, steps + 1):
            score = np.bincount(rows, weights=w[cols], minlength=n)
            t = np.concatenate(([-np.inf, first], first + np.cumsum(np.exp(gaps)), [np.inf]))
            upper, lower = _sigmoid(t[grade + 1] - score), _sigmoid(t[grade] - score)
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p / n, lower * (1 - lower) / p / n
            g_score = du - dl  # of the mean negative log-likelihood
            g_t = np.bincount(grade, weights=-du, minlength=GRADES + 1)[:GRADES] + np.bincount(grade, weights=dl, minlength=GRADES + 1)[1:]
            tail = np.cumsum(g_t[::-1])[::-1]
            g = np.concatenate((np.bincount(cols, weights=g_score[rows], minlength=d), [tail[0]], tail[1:] * np.exp(gaps)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            rate = 0.05
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:d]
            w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink * 20, 0)
            first -= move[d]
            gaps -= move[d + 1 :]
        self.thresholds = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        self.weights = {int(f): float(x) for f, x in zip(chosen, w, strict=True) if x}

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 - _sigmoid(self.thresholds[None, :] - scores[:, None])


def chosen_features(counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that get a weight, and all features' log-odds and standard errors above 0, from counts by label and feature."""
    (k0, k1), (n0, n1) = counts, rows
    odds = np.log((k1 + 0.5) / (n1 - k1 + 0.5)) - np.log((k0 + 0.5) / (n0 - k0 + 0.5))
    error = np.sqrt(1 / (k1 + 0.5) + 1 / (n1 - k1 + 0.5) + 1 / (k0 + 0.5) + 1 / (n0 - k0 + 0.5))
    z = np.where((k1 >= 3) & (odds >= LEAST_ODDS), odds / error, 0)  # a text is toxic by what it says, not by what it leaves out
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    return chosen[z[chosen] > LEAST_Z], odds, z


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class _Words(dict):
    """Word to its features' weights, those that have one; forgets when it grows large."""

    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> tuple[tuple[int, float], ...]:
        if len(self) > 300_000:
            self.clear()
        value = tuple((f, self.weights[f]) for f in _of_word(word) if f in self.weights)
        self[word] = value
        return value


def _score(text: str | None, words: _Words) -> float:
    found = {}
    for w in set((text or "").encode("utf-8", "surrogatepass").lower().split()):
        if x := words[w]:
            found.update(x)
    return sum(found.values())


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    own = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_key")).agg((F.max(label) > 0).alias("_toxic"))
    order = (F.xxhash64("_key"), F.col("_key"))
    few = own.filter("_toxic").orderBy(*order).limit(rows).unionByName(own.filter("not _toxic").orderBy(*order).limit(rows))
    few = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_key")).groupBy("_key", "_toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["key", "toxic", "x"])

    schema = T.StructType([T.StructField("key", few.schema["_key"].dataType), T.StructField("toxic", T.BooleanType()), T.StructField("x", T.BinaryType())])
    found = stored(few.mapInArrow(run, schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, SPACE), dtype=np.int32), np.zeros(2, dtype=np.int32)
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[int(k)][np.frombuffer(x, dtype=np.int32)] += 1
                n[int(k)] += 1
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["part", "n"])

    counts, n = np.zeros((2, SPACE), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for part, own in found.select("toxic", "x").coalesce(8).mapInArrow(count, "part binary, n binary").toLocalIterator():  # of fixed size and number
        counts += np.frombuffer(bytes(part), dtype=np.int32).reshape(2, SPACE)
        n += np.frombuffer(bytes(own), dtype=np.int32)
    place = np.zeros(SPACE, dtype=bool)
    place[chosen_features(counts, n)[0]] = True
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.frombuffer(v, dtype=np.int32) for v in b.column(2).to_pylist()]
            yield b.set_column(2, "x", pa.array([v[shared.value[v]].tobytes() for v in x], pa.binary()))

    got = found.mapInArrow(cut, schema).toArrow()
    forget(found)
    rows_ = sorted(zip(*(got.column(c).to_pylist() for c in ("key", "toxic", "x")), strict=True), key=lambda r: (r[0], r[2]))
    return Model([np.frombuffer(r[2], dtype=np.int32) for r in rows_], np.array([r[1] for r in rows_], dtype=bool), counts=counts)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", cut: float = 0.4) -> DataFrame:
    """(key, expected_severity, p_toxic, grade, toxic): grade is the likeliest one, toxic tells whether P(grade >= 1) reaches ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(shared.value.weights)
        for b in batches:
            p = shared.value.at_least(np.array([_score(t, words) for t in b.column(1).to_pylist()], dtype=np.float64))
            each = -np.diff(np.concatenate((np.ones((len(p), 1)), p, np.zeros((len(p), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= cut)], names=[key, "expected_severity", "p_toxic", "grade", "toxic"])

    fields = [docs.schema[key], T.StructField("expected_severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())]
    return docs.select(key, text).mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
