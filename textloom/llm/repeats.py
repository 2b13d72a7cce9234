"""Suffix-array dedup: find and remove every byte under a long repeated string.

A string of ``LEAST`` bytes is a repeat if it starts anywhere else too, in the
same text or another one. The corpus is cut up so that equal strings meet, and
suffix arrays of bounded size find them:

1. Every window of LEAST bytes has an anchor, the leftmost of its 32-byte
   grams with the smallest hash. Neighbouring windows with one anchor form a
   segment; equal windows always lie in segments whose anchors' grams are
   equal. About one segment starts every 85 bytes.
2. Equal segments are counted by hash before anything is moved. A segment
   that occurs twice is a repeat as a whole, whatever the number of copies.
3. The distinct segments of an anchor gram that has several are fetched from
   their texts, in parts: a part holds the windows whose anchor lies ``WIDTH``
   neighbouring places deep, so all its windows share a context of
   LEAST - WIDTH + 1 bytes around the anchor. Equal windows lie in parts of
   equal contexts; a part whose context no other segment has is done with.
4. Parts of equal contexts are concatenated into shards of bounded size, the
   context written as its number, as it is the same in all of them. Induced
   sorting gives a shard's suffix array, permuted common prefixes the windows
   that start a second suffix (suffixes.py).
5. A context with over ``HOT`` parts would fill a shard alone. Its parts are
   halved, which makes their contexts longer, until each fits; a context that
   is a whole window is a repeat by itself. Nothing is left out at any size.
6. The repeated windows go back to the texts that hold their segments.

Rows are told apart by position, so the input is to be a stored table (or a
checkpoint). Null texts are empty; texts under LEAST bytes keep all bytes.
Copies of a text of LEAST bytes or more lose every byte, all of them: nothing
marks one copy as the original. Repeated ids are rows of their own. An empty
table gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import forget, stored
from textloom.llm.suffixes import long_common, suffix_array

LEAST, GRAM = 200, 32
#: Places of the anchor in the windows of a part; consecutive parts overlap in one place.
WIDTH = 43
#: Parts of a context beyond which they are halved.
HOT = 2000
#: Keys of such contexts (16 bytes each) up to which they are broadcast, and copies of each beyond it.
BROADCAST_KEYS, SALTS = 500_000, 16
#: Bytes of a shard: the next context goes to another one.
SHARD = 1 << 19
#: Bytes whose windows are hashed at once, and bits of a position in them.
_CHUNK, _PLACE = 1 << 18, 21
#: Never part of UTF-8: the end of a string in a shard, and the begin of a context's number there, which has three bytes under 128.
_GAP, _CONTEXT = b"\xff", b"\xfe"


def _hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling."""
    of_byte = np.random.default_rng(GRAM).integers(1, 1 << 63, 256, dtype=np.uint64)
    h, k, m = of_byte[b], 1, 0x9E3779B97F4A7C15
    while k < GRAM:
        h = h[:-k] * np.uint64(m) + h[k:]
        m, k = m * m % (1 << 64), 2 * k
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _window_least(h: np.ndarray, w: int) -> np.ndarray:
    m, k = h, 1
    while 2 * k <= w:
        m, k = np.minimum(m[:-k], m[k:]), 2 * k
    return np.minimum(m[: len(m) - (w - k)], m[w - k :])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last one ends."""
    c = pc.fill_null(column, "").cast(pa.large_binary())
    bounds = np.frombuffer(c.buffers()[1], dtype=np.int64)[c.offset : c.offset + len(c) + 1]
    data = np.frombuffer(c.buffers()[2], dtype=np.uint8) if bounds[-1] else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: text, hash of the anchor's gram, first window, number of windows, place of the anchor in the first one."""
    w = LEAST - GRAM + 1
    mask = np.uint64((1 << _PLACE) - 1)
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - LEAST + 1), _CHUNK):
        piece = data[at : at + _CHUNK + LEAST - 1]
        h = _hashes(piece)
        # Of equal hashes the leftmost one: the position makes up the low bits.
        place = (_window_least(h & ~mask | np.arange(len(h), dtype=np.uint64), w) & mask).astype(np.int64)
        text = np.searchsorted(bounds, np.arange(at, at + len(place)), side="right") - 1
        window = np.flatnonzero(np.arange(at + LEAST, at + LEAST + len(place)) <= bounds[text + 1])
        if not len(window):
            continue
        own = place[window]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        lo, p = window[first], own[first]
        found.append((text[lo], h[p], at + lo - bounds[text[lo]], np.diff(np.append(first, len(window))), p - lo))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else tuple(np.zeros(0, dtype=d) for d in (np.int64, np.uint64, np.int64, np.int64, np.int64))


def all_segments(rows: DataFrame) -> DataFrame:
    """(gram, seg, row, lo, n, place) for rows of (row, text); seg is the hash of a segment's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                data, bounds = _texts(b.column(1))
                text, gram, lo, n, place = segments(data, bounds)
                begin = bounds[text] + lo
                view = memoryview(np.ascontiguousarray(data))
                seg = np.array([digest(view[x:y]) for x, y in zip(begin.tolist(), (begin + n + LEAST - 1).tolist(), strict=True)], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(seg.view(np.int64)), b.column(0).take(pa.array(text)), *(pa.array(x.astype(np.int32)) for x in (lo, n, place))],
                    names=["gram", "seg", "row", "lo", "n", "place"],
                )

    return rows.select("row", "text").mapInArrow(run, "gram long, seg long, row long, lo int, n int, place int")


def _packed(rows: DataFrame) -> DataFrame:
    """The rows with their text as compressed bytes, for the shuffles."""
    at = rows.columns.index("text")
    fields = [T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = pc.fill_null(b.column(at), "").cast(pa.binary())
            yield b.set_column(at, "text", pa.array([pack(t) for t in texts.to_pylist()], pa.binary()))

    return rows.mapInArrow(run, T.StructType(fields))


_PART = "gram long, key long, seg long, once boolean, first int, n int, left binary, right binary"
_PART_NAMES = [x.split()[0] for x in _PART.split(", ")]
_PART_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_PART_TYPES)], names=_PART_NAMES)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts_of(text: bytes, lo: int, n: int, place: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(key, first window in the segment, windows, bytes before and after the context) of a segment's parts."""
    p = lo + place
    for c in range(0, LEAST - GRAM, WIDTH - 1):
        # Windows whose anchor lies c to c + WIDTH - 1 bytes deep.
        begin, end = max(lo, p - c - WIDTH + 1), min(lo + n, p - c + 1)
        if begin < end:
            a, b = p - c, p - c - WIDTH + 1 + LEAST
            yield _signed(xxhash.xxh64_intdigest(text[a:b], c)), begin - lo, end - begin, text[begin:a], text[b : end - 1 + LEAST]


def halves(width: int, key: int, first: int, n: int, left: bytes, right: bytes) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """The parts of half the width, which have longer contexts, in the form of parts_of()."""
    half = (width + 1) // 2
    deep = len(left)  # of the first window: how far it reaches before the context
    for q in sorted({0, width - half}):
        low, high = max(q, deep - n + 1), min(q + half - 1, deep)
        if low <= high:
            more = left[deep - q :] + _GAP + right[: width - q - half] + _GAP + bytes([q])
            yield _signed(xxhash.xxh64_intdigest(more, key % (1 << 64))), first + deep - high, high - low + 1, left[deep - high : deep - q], right[width - q - half : width - 1 - low]


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The parts of wanted segments."""
    asked = wanted.groupBy("row").agg(F.collect_list(F.struct("gram", "seg", "lo", "n", "place", "once")).alias("asked"))
    both = _packed(rows.select("row", "text")).join(asked, "row").select("text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                lists = b.column(1)
                flat = lists.flatten()
                columns = zip(*(flat.field(c).to_pylist() for c in ("gram", "seg", "once", "lo", "n", "place")), strict=True)
                out = []
                for packed, k in zip(b.column(0).to_pylist(), np.diff(lists.offsets.to_numpy()).tolist(), strict=True):
                    text = unpack(packed)
                    for _ in range(k):
                        gram, seg, once, lo, n, place = next(columns)
                        out += [(gram, key, seg, once, first, m, left, right) for key, first, m, left, right in parts_of(text, lo, n, place)]
                yield _part_batch(out)

    return both.mapInArrow(run, _PART)


def _halved(parts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield _part_batch([(gram, k, seg, once, f, m, x, y) for gram, key, seg, once, first, n, left, right in rows for k, f, m, x, y in halves(width, key, first, n, left, right)])

    return parts.select(*_PART_NAMES).mapInArrow(run, _PART)


def shared_windows(bodies: list[tuple[int, bytes, bytes]], windows: list[int], width: int) -> list[np.ndarray]:
    """For each (context, bytes before it, bytes after it) which of its windows occur again, by suffix array."""
    token = [_CONTEXT + bytes([k >> 14, k >> 7 & 127, k & 127]) for k in range(max(k for k, _, _ in bodies) + 1)]
    strings = [left + token[k] + right for k, left, right in bodies]
    t = np.frombuffer(_GAP.join(strings) + _GAP, dtype=np.uint8)
    starts = np.cumsum([0, *(len(s) + 1 for s in strings[:-1])])
    shared = long_common(t, suffix_array(t), starts, width - 1 + 4)
    return [shared[s : s + n] for s, n in zip(starts.tolist(), windows, strict=True)]


def _runs(hit: np.ndarray) -> list[int]:
    """Begins and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))).tolist()


class _Shard:
    """Whole contexts with several parts each; equal parts are held once."""

    def __init__(self, width: int):
        self.width = width
        self.bodies: list[tuple[int, bytes, bytes]] = []
        self.windows: list[int] = []
        self.members: list[list[tuple]] = []  # of each body: (gram, seg, once, first)
        self.contexts = self.size = 0
        self.wins: list[tuple[int, int, list[int]]] = []

    def add(self, group: list[tuple]) -> None:
        """All parts of a context."""
        if len(group) < 2:
            return
        own: dict[tuple[bytes, bytes], list[tuple]] = {}
        n_of = {}
        for gram, _, seg, once, first, n, left, right in group:
            own.setdefault((left, right), []).append((gram, seg, once, first))
            n_of[left, right] = n
        # Equal parts of different segments are repeats as a whole; alone, they meet no other.
        if len(own) > 1:
            size = sum(len(x) + len(y) + 5 for x, y in own)
            if self.size + size > SHARD or self.contexts >= 1 << 20:
                self.solve()
            for (left, right), members in own.items():
                self.bodies.append((self.contexts, left, right))
                self.windows.append(n_of[left, right])
                self.members.append(members)
            self.contexts += 1
            self.size += size
        for body, members in own.items():
            if len(members) > 1:
                self.wins += [(gram, seg, [first, first + n_of[body]]) for gram, seg, once, first in members if once]

    def solve(self) -> None:
        if self.bodies:
            for members, hit in zip(self.members, shared_windows(self.bodies, self.windows, self.width), strict=True):
                if len(members) == 1 and members[0][2] and hit.any():
                    gram, seg, _, first = members[0]
                    self.wins.append((gram, seg, [first + x for x in _runs(hit)]))
        self.bodies, self.windows, self.members, self.contexts, self.size = [], [], [], 0, 0

    def taken(self) -> pa.RecordBatch:
        out, self.wins = self.wins, []
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["gram", "seg", "wins"])


def _by_shard(parts: DataFrame, width: int) -> DataFrame:
    """(gram, seg, wins): the repeated windows of segments that occur once, by suffix arrays."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select(*_PART_NAMES).repartition(n, "gram", "key").sortWithinPartitions("gram", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(width)
        group: list[tuple] = []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and x[:2] != group[0][:2]:
                    shard.add(group)
                    group = []
                group.append(x)
            if len(shard.wins) > 10_000:
                yield shard.taken()
        shard.add(group)
        shard.solve()
        yield shard.taken()

    return dealt.mapInArrow(run, "gram long, seg long, wins array<int>")


def _split(parts: DataFrame, hot: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The parts of other contexts, and those of the ``n`` hot ones."""
    on = ["gram", "key"]
    if n <= BROADCAST_KEYS:
        hot = F.broadcast(hot)
    else:
        hot = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        parts = parts.withColumn("_salt", F.pmod("seg", F.lit(SALTS)).cast("int"))
        on.append("_salt")
    return parts.join(hot, on, "left_anti"), parts.join(hot, on, "left_semi")


def _shared(parts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(gram, seg, wins) of all parts, and the stored tables that it is made of."""
    width, out, made = WIDTH, [], [parts]
    while True:
        hot = stored(parts.groupBy("gram", "key").agg(F.count("*").alias("_k")).filter(F.col("_k") > HOT).select("gram", "key"))
        made.append(hot)
        n = hot.count()
        cold, own = _split(parts, hot, n) if n else (parts, None)
        out.append(_by_shard(cold, width))
        if own is not None and width == 1:  # the context is the window
            out.append(own.filter("once").select("gram", "seg", F.array("first", F.col("first") + 1).alias("wins")))
        if own is None or width == 1:
            break
        parts, width = stored(_halved(own, width)), (width + 1) // 2
        made.append(parts)
    while len(out) > 1:
        out[-2:] = [out[-2].unionByName(out[-1])]
    return out[0], made


def covered(rows: DataFrame) -> DataFrame:
    """(row, cover) for rows of (row, text) that hold repeats: cover is a list of (lo, wins), first and last windows in turn."""
    every = stored(all_segments(rows))
    distinct = every.groupBy("gram", "seg").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("row", "lo", "n", "place")))
    distinct = stored(distinct)
    several = distinct.groupBy("gram").agg(F.count("*").alias("_k")).filter("_k > 1").select("gram")
    parts = stored(_fetched(rows, distinct.join(several, "gram").withColumn("once", F.col("copies") == 1)))
    whole = distinct.filter("copies > 1").select("gram", "seg", F.array(F.lit(0), F.col("n")).alias("wins"))
    wins, made = _shared(parts)
    cover = stored(every.join(whole.unionByName(wins), ["gram", "seg"]).groupBy("row").agg(F.collect_list(F.struct("lo", "wins")).alias("cover")))
    forget(every, distinct, *made)
    return cover


def removed(lengths: np.ndarray, cover: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal removed runs of several texts: the text of each, its first byte and its end."""
    flat = cover.flatten()
    doc = np.repeat(np.arange(len(cover)), pc.fill_null(pc.list_value_length(cover), 0).to_numpy())
    wins = flat.field("wins")
    at = doc, flat.field("lo").to_numpy()
    doc, lo = (np.repeat(x, pc.list_value_length(wins).to_numpy() // 2) for x in at)
    w = wins.flatten().to_numpy()
    base = np.cumsum(np.append(0, lengths[:-1] + 1))  # a byte between texts keeps their runs apart
    begin, end = base[doc] + lo + w[::2], base[doc] + lo + w[1::2] + LEAST - 1
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.append(True, begin[1:] > end[:-1]) if len(begin) else np.zeros(0, dtype=bool)
    last = np.append(first[1:], True) if len(begin) else first
    doc = doc[order][first]
    return doc, begin[first] - base[doc], end[last] - base[doc]


def _applied(docs: DataFrame, key: str, text: str, fields: list[T.StructField], of) -> DataFrame:
    """Key and ``fields``, which ``of`` gets from a text's bytes and its removed runs."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    both = _packed(rows).join(covered(rows.select("row", "text")), "row", "left").select("key", "text", "cover")
    arrow = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                texts = [unpack(t) for t in b.column(1).to_pylist()]
                doc, begin, end = removed(np.array([len(t) for t in texts]), b.column(2))
                runs: list[list[tuple[int, int]]] = [[] for _ in texts]
                for k, x, y in zip(doc.tolist(), begin.tolist(), end.tolist(), strict=True):
                    runs[k].append((x, y))
                out = [of(t, r) for t, r in zip(texts, runs, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], a) for k, a in enumerate(arrow))], names=[key, *(f.name for f in fields)])

    return both.mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def _kept(t: bytes, runs: list[tuple[int, int]]) -> bytes:
    if not runs:
        return t
    out, at = [], 0
    for a, b in runs:
        out.append(t[at:a])
        at = b
    return b"".join([*out, t[at:]])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans, kept): the removed byte ranges, and the remaining bytes, which may cut through a character."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    return _applied(docs, key, text, fields, lambda t, runs: ([{"start": a, "end": b} for a, b in runs], _kept(t, runs)))


def digest(docs: DataFrame) -> DataFrame:
    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    return _applied(docs, "doc_id", "text", fields, lambda t, runs: (len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(t, runs)).hexdigest()))
