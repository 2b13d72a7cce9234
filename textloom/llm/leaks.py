"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages become TF-IDF vectors over their words, with document
frequencies counted over the whole corpus. A randomised SVD, whose products
with the passage matrix are summed over the rows' partitions, gives a latent
space of fewer dimensions than passages. Every text is swept by windows of
several lengths, half again as long each, in steps of a quarter window; the
product of a window and a passage in that space is a difference of running
sums. A window is a candidate for a passage if their cosine reaches
``LEAST_COSINE`` of the passage's cosine with itself. The window's norm is that of its words that some
passage of the block holds: words foreign to all of them, whose weight would
grow with the corpus, don't count.

Candidates are checked word by word: the longest common subsequence with the
passage has to reach least_common(), 60 % of a long passage, and its answer,
the words after the passage's last sentence end but one, least_answer(), half
of a long one. Passages under ``SHORT`` words are too short for paraphrases:
all their words have to follow each other in the text.

No vector is made where the words alone rule a passage out: a text is cut into
pieces of ``PIECE`` windows, and a passage needs as many of its words in a
piece as its common subsequence has to have. Its most frequent words, up to
``FREE`` of it, are taken as present, so only the rarer ones are looked up, in
postings from words to passages. This loses nothing.

Windows and pieces lie inside one text, so a text's result doesn't depend on
what stands beside it. Passages are taken in blocks of about ``BLOCK_WORDS``
words, each with a space of its own. ``BLOCKS`` of them are looked for in one
pass over the texts; a task holds one block at a time.

Nulls and empty texts or passages match nothing. Repeated rows are results of
their own; of a text and a passage the window with the longest common
subsequence is returned. Empty tables give an empty result; other columns
aren't read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import columns_of, stored, whole, word_count

#: Words of a block of passages, on average, and blocks in one pass over the texts.
BLOCK_WORDS, BLOCKS = 1 << 16, 16
RANK, OVERSAMPLE, POWERS = 128, 16, 2
#: The latent space has that part of the passages' number as dimensions at most.
RANK_SHARE = 0.75
#: Passages with fewer words are looked for word by word.
SHORT = 6
LEAST_COSINE, LEAST_LCS, LEAST_ANSWER = 0.45, 0.6, 0.5
FREE, PIECE = 0.3, 16
#: Words of texts that are looked at together.
_GROUP = 1 << 15
_SEED = 5
_DROP = b".,:;!?\"'()[]{}<>"
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER, _DROP).split()


def answer_of(text: str) -> list[bytes]:
    """The words after the last sentence end but one; a fifth of the words, and three of them, at least."""
    body = text.rstrip()
    at = max(body.rfind(c, 0, len(body) - 1) for c in ".!?\n")
    own, every = words_of(body[at + 1 :]), words_of(body)
    return every[-max(len(own), 3, len(every) // 5) :]


def least_common(n: int) -> float:
    """Words of a passage of ``n`` that its common subsequence has at least; chance takes off a word of a short one."""
    return max(LEAST_LCS * n - 1, 0.5 * n) - 1e-9


def least_answer(n: int) -> float:
    return max(LEAST_ANSWER * n - 1, 1) - 1e-9


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of ``a`` at a time in the bits of one integer."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Scale:
    """The passages of one window length: their latent vectors, and postings of their rarer words."""

    def __init__(self, window: int, fit: np.ndarray, block: Block, latent: np.ndarray):
        self.window, self.step, self.fit = window, max(1, window // 4), fit
        self.latent = latent[fit]
        self.own = (self.latent**2).sum(axis=1)
        need = np.array([least_common(len(block.numbers[p])) for p in fit])
        self.need = np.empty(len(fit))
        entries: list[tuple[int, int, int]] = []
        for i, p in enumerate(fit.tolist()):
            words = sorted(Counter(block.numbers[p]).items(), key=lambda x: (block.idf[x[0]], x[0]))
            free = k = 0
            while k < len(words) and free + words[k][1] <= FREE * len(block.numbers[p]):
                free += words[k][1]
                k += 1
            entries += [(w, i, n) for w, n in words[k:]]
            self.need[i] = need[i] - free
        word, self.passage, self.times = (np.array(x, dtype=np.int64) for x in zip(*sorted(entries), strict=True))
        self.begin = np.searchsorted(word, np.arange(len(block.vocabulary) + 2))
        self.listed = self.begin[1:] > self.begin[:-1]


class Block:
    """Passages of SHORT words or more with their vectors, and shorter ones, as every task gets them."""

    def __init__(self, items: list[tuple[object, str]], n_docs: int, df: dict[bytes, int]):
        self.ids = [i for i, _ in items]
        self.words = [words_of(t) for _, t in items]
        self.vocabulary = {w: k for k, w in enumerate(sorted(set().union(*map(set, self.words))))}
        idf = np.log((n_docs + 1) / (np.array([df.get(w, 0) for w in self.vocabulary]) + 1)) + 0.05
        self.idf = np.append(idf, 0).astype(np.float32)  # the last: any other word, which no passage holds
        self.numbers = [[self.vocabulary[w] for w in ws] for ws in self.words]
        self.answers = [[self.vocabulary[w] for w in answer_of(t)] for _, t in items]
        self.scales: list[_Scale] = []
        self.short: dict[int, list[int]] = {}
        for p, x in enumerate(self.numbers):
            if 0 < len(x) < SHORT:
                self.short.setdefault(x[0], []).append(p)
        self.first_of_short = np.zeros(len(self.idf), dtype=bool)
        self.first_of_short[list(self.short)] = True

    def row(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and weights of a passage, scaled to length 1."""
        n = Counter(self.vocabulary[w] for w in words)
        k = np.array(list(n), dtype=np.int64)
        x = np.array(list(n.values())) * self.idf[k]
        return k, x / np.linalg.norm(x)

    def rank(self) -> int:
        return min(RANK, max(1, int(RANK_SHARE * sum(len(x) >= SHORT for x in self.numbers))))

    def place(self, basis: np.ndarray) -> None:
        """Latent passages by window length; each window length takes passages from two thirds of it up to it."""
        self.basis = np.vstack([basis * self.idf[:-1, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        sizes = np.array([len(w) if len(w) >= SHORT else 0 for w in self.words])
        latent = np.zeros((len(sizes), basis.shape[1]), dtype=np.float32)
        for p in np.flatnonzero(sizes):
            k, x = self.row(self.words[p])
            latent[p] = (basis[k] * x[:, None]).sum(axis=0)
        window, least = 12, 0
        while least < sizes.max(initial=0):
            fit = np.flatnonzero((sizes <= window) & (sizes > least))
            if len(fit):
                self.scales.append(_Scale(window, fit, self, latent))
            window, least = int(window * 1.5), window


def _products(passages: DataFrame, block: Block, right: np.ndarray) -> np.ndarray:
    """A'(A right) for the matrix A of the passages' rows, summed over partitions."""
    sc = passages.sparkSession.sparkContext
    shared = sc.broadcast((block, right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, r = shared.value
        total = np.zeros(r.shape)
        any_ = False
        for b in batches:
            for t in b.column(0).to_pylist():
                if len(words := words_of(t)) >= SHORT:
                    k, x = own.row(words)
                    total[k] += x[:, None] * (x @ r[k])[None, :]
                    any_ = True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    # A block is bounded, so these parts are few.
    total = np.zeros(right.shape)
    for (part,) in passages.select("text").repartition(4).mapInArrow(run, "part binary").toLocalIterator():
        total += np.frombuffer(bytes(part)).reshape(right.shape)
    shared.unpersist()
    return total


def latent_basis(passages: DataFrame, block: Block) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix, by randomised SVD; one column a dimension."""
    n, rank = len(block.vocabulary), block.rank()
    width = min(rank + OVERSAMPLE, n)
    q = np.linalg.qr(np.random.default_rng(_SEED).normal(size=(n, width)))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(_products(passages, block, q))[0]
    small = q.T @ _products(passages, block, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values, kind="stable")[: min(rank, width)]]


def _frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Texts, and texts that hold each word of the vocabulary of one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                n.update(shared.value.intersection(words_of(t)))
                n[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))
    shared.unpersist()
    return df.pop(b"", 0), df


def _pieces(scale: _Scale, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of texts laid end to end: text, first window, end of its windows, and the words that they reach."""
    sizes = np.diff(bounds)
    windows = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - scale.window) // scale.step)), 0)
    n = -(-windows // PIECE)
    text = np.repeat(np.arange(len(sizes)), n)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * PIECE
    end = np.minimum(first + PIECE, windows[text])
    begin = bounds[text] + np.maximum(0, (first - 1) * scale.step)
    return text, first, end, begin, np.minimum(bounds[text + 1], bounds[text] + end * scale.step + scale.window)


def _possible(scale: _Scale, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a piece, reaching from word ``begin`` to ``end``, has enough words of a passage: by piece and passage."""
    at = np.flatnonzero(scale.listed[ids])
    # Neighbouring pieces of a text share words; no word lies in three.
    piece = np.searchsorted(begin, at, side="right") - 1
    again = np.flatnonzero((piece > 0) & (end[piece - 1] > at))
    keys = np.concatenate((piece * len(scale.begin) + ids[at], (piece[again] - 1) * len(scale.begin) + ids[at[again]]))
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    piece, word = np.divmod(keys, len(scale.begin))
    n = scale.begin[word + 1] - scale.begin[word]
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - scale.begin[word], n)
    present = np.bincount(np.repeat(piece, n) * len(scale.fit) + scale.passage[entry], weights=scale.times[entry], minlength=len(begin) * len(scale.fit))
    return present.reshape(len(begin), -1) >= scale.need[None, :]


def _candidates(block: Block, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, list[int], list[float]]]:
    """(text, first word, end, passages, cosines) of the windows over texts laid end to end."""
    for scale in block.scales:
        text, first, last, begin, end = _pieces(scale, bounds)
        if not len(text):
            continue
        possible = _possible(scale, ids, begin, end)
        for k in np.flatnonzero(possible.any(axis=1)).tolist():
            some = np.flatnonzero(possible[k])
            low, high = bounds[text[k]], bounds[text[k] + 1]
            starts = low + np.arange(first[k], last[k]) * scale.step
            ends = np.minimum(starts + scale.window, high)
            own = ids[starts[0] : ends[-1]]
            sums = np.zeros((len(own) + 1, len(some)))
            np.cumsum(block.basis[own] @ scale.latent[some].T, axis=0, out=sums[1:])
            norms = np.concatenate(([0], np.cumsum(block.idf[own].astype(np.float64) ** 2)))
            x, y = starts - starts[0], ends - starts[0]
            # cosine = <window, passage> / (|window| |latent passage|), to be a share of |latent passage|
            norm = np.sqrt(np.maximum(norms[y] - norms[x], 0)) + 1e-6
            cosine = (sums[y] - sums[x]) / norm[:, None]
            hit = cosine >= LEAST_COSINE * scale.own[some][None, :]
            for j in np.flatnonzero(hit.any(axis=1)).tolist():
                which = np.flatnonzero(hit[j])
                p = scale.fit[some[which]]
                yield int(text[k]), int(max(low, starts[j] - scale.step)), int(min(high, ends[j] + scale.step)), p.tolist(), (cosine[j, which] / np.sqrt(np.maximum(scale.own[some[which]], 1e-12))).tolist()


def _matches(block: Block, texts: list[list[bytes]]) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, passage, cosine, lcs, answer) of the best window of each pair."""
    bounds = np.cumsum([0, *map(len, texts)])
    other = len(block.vocabulary)
    number = block.vocabulary.get
    flat = [number(w, other) for t in texts for w in t]
    ids = np.array(flat, dtype=np.int64)
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for text, start, end, passages, cosines in _candidates(block, ids, bounds):
        part = flat[start:end]
        for p, c in zip(passages, cosines, strict=True):
            own, answer = block.numbers[p], block.answers[p]
            n = common(own, part)
            if n < least_common(len(own)):
                continue
            found = common(answer, part)
            if found >= least_answer(len(answer)):
                best[text, p] = max(best.get((text, p), (0, 0, 0)), (n / len(own), found / len(answer), c))
    if block.short:
        for i in np.flatnonzero(block.first_of_short[ids]).tolist():
            text = int(np.searchsorted(bounds, i, side="right")) - 1
            for p in block.short[flat[i]]:
                own = block.numbers[p]
                if i + len(own) <= bounds[text + 1] and flat[i : i + len(own)] == own:
                    best[text, p] = (1.0, 1.0, 1.0)
    for (text, p), (lcs, answer, c) in sorted(best.items()):
        yield text, p, c, lcs, answer


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, cosine, lcs_ratio, answer_ratio): texts that hold a benchmark passage, and which."""
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    passages = benchmark.select(F.col(item).alias("item"), F.col("text")).filter(word_count(F.col("text")) > 0)
    fields = [T.StructField(key, docs.schema["key"].dataType), T.StructField(item, passages.schema["item"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs_ratio", "answer_ratio"))]
    schema = T.StructType(fields)
    n_words = passages.agg(F.sum(word_count(F.col("text")))).first()[0]
    found = docs.sparkSession.createDataFrame([], schema)
    if not n_words:
        return found
    n = -(-n_words // BLOCK_WORDS)
    numbered = stored(passages.withColumn("_block", F.pmod(F.xxhash64("item", "text"), F.lit(n))))
    for k in range(0, n, BLOCKS):
        own = [numbered.filter(F.col("_block") == i).select("item", "text") for i in range(k, min(n, k + BLOCKS))]
        found = found.unionByName(_find_blocks(docs, own, schema))
    return found


def _find_blocks(docs: DataFrame, blocks: list[DataFrame], schema: T.StructType) -> DataFrame:
    """One pass over the texts for some blocks, after one that counts their words."""
    sc = docs.sparkSession.sparkContext
    items = [sorted(((r[0], r[1]) for r in own.collect()), key=lambda r: (str(r[0]), r[1])) for own in blocks]  # bounded
    n_docs, df = _frequencies(docs, {w for own in items for _, t in own for w in words_of(t)})
    shared = []
    for own, passages in zip(items, blocks, strict=True):
        block = Block(own, n_docs, df)
        if block.vocabulary:
            block.place(latent_basis(passages, block))
            shared.append(sc.broadcast(block))
    key_type, item_type = (to_arrow_type(schema[i].dataType) for i in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for one in shared:
                # Of several blocks only the one at work is held.
                own = one.value if len(shared) == 1 else one.load_from_path(one._path)
                rows: list[tuple] = []
                i = 0
                while i < len(texts):
                    group: list[list[bytes]] = []
                    first, size = i, 0
                    while i < len(texts) and size < _GROUP:
                        group.append(words_of(texts[i]))
                        size += len(group[-1])
                        i += 1
                    if size:
                        rows += [(first + t, own.ids[p], *x) for t, p, *x in _matches(own, group)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())).cast(key_type), pa.array([r[1] for r in rows], item_type), *(pa.array([r[c] for r in rows], pa.float64()) for c in (2, 3, 4))],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that hold no benchmark passage, with the columns of the input.

    Rows are told apart by position, so ``docs`` is to be a stored table.
    """
    rows = docs.select(whole(docs).alias("_in"), F.monotonically_increasing_id().alias("_row"))
    held = stored(find(rows.select("_row", F.col("_in").getField(text).alias("text")), benchmark, key="_row").select("_row").distinct())
    return rows.join(held, "_row", "left_anti").select(*columns_of(docs))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find(docs, benchmark)
