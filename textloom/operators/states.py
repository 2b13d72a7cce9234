"""Ordered state over the lines of a file: comments, blocks, checksums.

Two forms. ``comment_windows`` is made of window functions: a line maps the
states {outside, inside} to {outside, inside}, which is a constant, the
identity or the swap, so the state before a line is the last constant with the
swaps since. ``folded`` walks a file's lines once, in order, in Arrow batches;
it is for profiles with blocks, whose detectors depend on each other and reset
the comment state. Its state is a few numbers, whatever the file's length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.lines import _DETECT, CLOSED, FAUX_BLANK, IGNORE, IGNORE_FILE, OPEN_NEXT, SINGLE_ON, SKIPPED, TRUE_BLANK, has
from textloom.plans.profile import Profile
from textloom.ship import ship


def comment_windows(df: DataFrame, key: str = "path") -> DataFrame:
    """Add in_comment (the line is a comment, or in one) to lines with ``bits``; blank and skipped lines leave the state alone."""
    order = Window.partitionBy(key).orderBy("line_no", "piece_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    moves = ~has(SKIPPED) & ~has(TRUE_BLANK)
    f0, f1 = has(OPEN_NEXT), ~has(CLOSED)
    df = df.withColumns({
        "_const": F.when(moves & (f0 == f1), f0.cast("int")),
        "_swap": F.when(moves & f0 & ~f1, 1).otherwise(0),
    })
    df = df.withColumn("_swaps", F.coalesce(F.sum("_swap").over(before), F.lit(0)))
    df = df.withColumn("_at", F.when(F.col("_const").isNotNull(), F.struct(F.col("_const").alias("c"), F.col("_swaps").alias("s"))))
    df = df.withColumn("_last", F.last("_at", ignorenulls=True).over(before))
    inside = F.pmod(F.coalesce(F.col("_last.c"), F.lit(0)) + F.col("_swaps") - F.coalesce(F.col("_last.s"), F.lit(0)), F.lit(2)) == 1
    return df.withColumn("in_comment", inside | has(SINGLE_ON)).drop("_const", "_swap", "_swaps", "_at", "_last")


class Fold:
    """State of one file between its lines."""

    def __init__(self, p: Profile):
        self.lists = [len(x) for x in p.detectors]
        self.n = sum(self.lists)
        self.block_of = [i + 1 for i, k in enumerate(self.lists) for _ in range(k)]
        self.ends = [end is not None for detector in p.detectors for _, end in detector]
        self.detects = p.has_blocks
        self.measured = p.measured_block
        self.reset()

    def reset(self) -> None:
        self.block, self.pair, self.single, self.off, self.inside = 0, -1, False, False, False
        self.code_crc, self.raw_crc = 0, 0

    def _start(self, bits: int) -> bool:
        for i in range(self.n):
            if bits >> (_DETECT + i) & 1:
                self.block, self.pair = self.block_of[i], i
                self.single = self.ends[i] and bool(bits >> (_DETECT + self.n + i) & 1)
                return True
        return False

    def _change(self, bits: int) -> bool:
        if self.off:
            return False
        if bits & IGNORE_FILE:
            self.off = True
            return False
        if bits & IGNORE:
            return False
        if self.block and self.single:
            self.block, self.single = 0, False
            return self._start(bits)
        if self.block:
            if self.ends[self.pair] and bits >> (_DETECT + self.n + self.pair) & 1:
                self.block = 0
                return True
            return False
        return self._start(bits)

    def step(self, bits: int) -> tuple[int, bool, bool]:
        """(block, comment, changed) of the next line."""
        if bits & (SKIPPED | TRUE_BLANK):
            return self.block, False, False
        changed = self.detects and self._change(bits)
        if changed:
            self.inside = False
        if self.inside:
            on, self.inside = True, not bits & CLOSED
        else:
            on, self.inside = bool(bits & SINGLE_ON), bool(bits & OPEN_NEXT)
        return self.block, on, changed


def folded(df: DataFrame, p: Profile, key: str = "path", crc: bool = True, line: bool = True) -> DataFrame:
    """Add block, in_comment, changed and the checksums so far, code_crc and raw_crc, to lines with ``bits``.

    One shuffle by file; lines are sorted inside the partitions, so a file's
    length costs no memory. Texts take part in it only where checksums are
    wanted, or with ``line`` the line itself, which is kept then.
    """
    ship(df.sparkSession)
    stay = [key, "line_no", "piece_no", "bits", "semicolons", *(["line"] if line else [])]
    keep = [*stay, *(["raw"] if crc else []), *(["line"] if crc and not line else [])]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*keep).repartition(n, key).sortWithinPartitions(key, "line_no", "piece_no")
    more = [T.StructField("block", T.IntegerType()), T.StructField("in_comment", T.BooleanType()), T.StructField("changed", T.BooleanType()), T.StructField("code_crc", T.LongType()), T.StructField("raw_crc", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, last = Fold(p), None
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            raws, lines = (b.column("raw").to_pylist(), b.column("line").to_pylist()) if crc else ([None] * b.num_rows,) * 2
            for k, piece, raw, text, bits in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), raws, lines, b.column(3).to_pylist(), strict=True):
                if k != last:
                    fold.reset()
                    last = k
                block, on, changed = fold.step(bits)
                if crc:
                    if piece == 0:
                        fold.raw_crc = zlib.adler32((raw + "\n").encode("utf-8", "surrogatepass"), fold.raw_crc)
                    if block == fold.measured and not on and not bits & (SKIPPED | TRUE_BLANK | FAUX_BLANK):
                        fold.code_crc = zlib.adler32((" " + "".join(c + " " for c in text)).encode("utf-8", "surrogatepass"), fold.code_crc)
                for to, x in zip(out, (block, on, changed, fold.code_crc, fold.raw_crc), strict=True):
                    to.append(x)
            types = (pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=[*stay, *(f.name for f in more)])

    return dealt.mapInArrow(run, T.StructType([*(df.schema[c] for c in stay), *more]))
