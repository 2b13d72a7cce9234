"""Routines: which lines belong to which, and how complex each is.

Where a routine ends depends on where the ones before it began, on indents and
on suppressed short ones, so a file is walked once, in order, after one
shuffle by file; the state is that of the open routine.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.patterns import groups, java
from textloom.functions.text import expanded_indent, first_group, rank, strip
from textloom.operators import lines as L
from textloom.operators.measure import COMMENT_RANKS, COMPLEXITY_RANKS, NESTING_RANKS, ROUTINE_RANKS
from textloom.operators.states import Fold
from textloom.plans.config import Param
from textloom.plans.profile import Profile, profile
from textloom.ship import ship

FILE_LINES, NO_MEASURE = "(file lines grouped as routine)", "(no measure)"
_FIELDS = ("name", "line", "line_num", "line_col", "line_nesting", "regex", "nbnc", "comments", "decisions", "escapes", "cases", "booleans", "max_nesting")


def _start(line: Column, p: Profile, params: tuple[Param, ...]) -> tuple[Column, Column, Column]:
    """Whether the line starts a routine, its name, and the pattern: negatives first, then the first positive, else the default."""
    rx = lambda x: java(x, p.ignore_case)
    no = F.lit(False)
    for q in params:
        if not q.positive:
            no |= line.rlike(rx(q.regex))
    which = [(q.regex, q.raw) for q in params if q.positive] or [(p.routines, p.routines)]
    hit = [line.rlike(rx(r)) for r, _ in which]
    name, pattern = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, (r, raw) in reversed(list(zip(hit, which, strict=True))):
        name = F.when(h, first_group(line, rx(r), groups(r))).otherwise(name)
        pattern = F.when(h, F.lit(raw)).otherwise(pattern)
    found = F.lit(False)
    for h in hit:
        found |= h
    return found & ~no, name, pattern


class _Walk:
    """One file's routines, line by line."""

    def __init__(self, p: Profile):
        self.p = p
        self.fold = Fold(p)

    def begin(self) -> None:
        self.fold.reset()
        self.nbnc = self.comments = self.nbnc_at = self.comments_at = 0
        self.found = self.prev = False
        self._fresh()

    def _fresh(self, line: str = "", num: int = 0, col: int = 0, nest: int = 0, name: str = FILE_LINES, regex: str = "") -> None:
        self.cur = {"name": name, "line": line, "line_num": num, "line_col": col, "line_nesting": nest, "regex": regex, "decisions": 0, "escapes": 0, "cases": 0, "booleans": 0, "max_nesting": 0}

    def save(self, out: list) -> None:
        n = self.nbnc - self.nbnc_at
        if n <= 1 and not self.p.routine_output_single and not self.p.write_empties:
            return
        if self.found or self.p.routine_file_lines:
            out.append({**self.cur, "nbnc": n, "comments": self.comments - self.comments_at})
            self.nbnc_at, self.comments_at = self.nbnc, self.comments
        elif self.p.write_empties:
            out.append({**dict.fromkeys(_FIELDS, 0), "name": NO_MEASURE, "line": "", "regex": ""})

    def end(self, out: list) -> None:
        if self.fold.block == self.fold.measured or self.p.routine_span_blocks:
            self.save(out)

    def step(self, num: int, bits: int, line: str, depth: int, start: bool, name: str | None, regex: str | None, out: list) -> None:
        p, old = self.p, self.fold.block
        block, comment, changed = self.fold.step(bits)
        if changed and not p.routine_span_blocks:
            if old == self.fold.measured:
                self.save(out)
            self.found = False
            self._fresh()
        if bits & (L.SKIPPED | L.TRUE_BLANK | L.FAUX_BLANK) or block != self.fold.measured:
            return
        if comment:
            self.comments += not bits & L.DEAD or p.dead_code is None
            return
        self.nbnc += 1
        nest = depth // p.routine_indent
        rel = nest - self.cur["line_nesting"]
        start = start and depth <= p.routine_ignore_column
        trigger = start or (depth > 0 and p.routine_ignore_column != 0 and depth <= p.routine_ignore_column and depth <= self.cur["line_col"])
        if trigger and not p.routine_single_line and self.prev:
            self.cur["line"] += line
            trigger = False
        self.prev = trigger
        if trigger:
            self.save(out)
            self.found = True
            self._fresh(line, num, depth, nest, (name or "") if start else "", (regex or "") if start else "")
        for bit, what in ((L.DECISION, "decisions"), (L.ESCAPE, "escapes"), (L.CASE, "cases"), (L.BOOLEAN, "booleans")):
            if bits & bit:
                self.cur[what] += 1
        if bits & L.DECISION:
            self.cur["max_nesting"] = max(self.cur["max_nesting"], rel)


def routines(files: DataFrame, p: Profile | str = "Code", params: tuple[Param, ...] = (), key: str = "path", text: str = "content") -> DataFrame:
    """One row a routine: its place, size, comments, counts, complexity and ranks."""
    p = profile(p) if isinstance(p, str) else p
    ship(files.sparkSession)
    df = L.tested(L.pieces(files.select(key, text), p, key, text), p)
    start, name, regex = _start(F.col("line"), p, params)
    df = df.select(key, "line_no", "piece_no", "bits", "line", expanded_indent(F.col("line"), p.routine_indent).alias("depth"), start.alias("start"), F.when(start, name).alias("name"), F.when(start, regex).alias("regex"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, key).sortWithinPartitions(key, "line_no", "piece_no")
    strings, ints = ("name", "line", "regex"), tuple(f for f in _FIELDS if f not in ("name", "line", "regex"))
    schema = T.StructType([files.schema[key], T.StructField("seq", T.IntegerType()), *(T.StructField(f, T.StringType()) for f in strings), *(T.StructField(f, T.LongType()) for f in ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, last, seq = _Walk(p), None, 0
        for_last = False

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = [b_key, pa.int32(), *[pa.string()] * len(strings), *[pa.int64()] * len(ints)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)

        b_key = pa.string()
        for b in batches:
            b_key = b.schema.field(0).type
            rows: list[tuple] = []

            def put(k, out: list, rows: list = rows) -> None:
                nonlocal seq
                for x in out:
                    seq += 1
                    rows.append((k, seq, *(x[f] for f in strings), *(x[f] for f in ints)))

            for k, num, _, bits, line, depth, is_start, nm, rx in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out: list[dict] = []
                if not for_last or k != last:
                    if for_last:
                        walk.end(out)
                        put(last, out)
                        out = []
                    walk.begin()
                    last, for_last, seq = k, True, 0
                walk.step(num, bits, line, depth, is_start, nm, rx, out)
                if out:
                    put(k, out)
            yield batch(rows)
        if for_last:
            out = []
            walk.end(out)
            rows = []
            for x in out:
                seq += 1
                rows.append((last, seq, *(x[f] for f in strings), *(x[f] for f in ints)))
            yield batch(rows)

    df = dealt.mapInArrow(run, schema)
    complexity = F.col("decisions")
    if p.count_escapes:
        complexity += F.greatest(F.lit(1), F.col("escapes"))
    if p.count_cases:
        complexity += F.col("cases")
    if p.count_booleans:
        complexity += F.col("booleans")
    complexity = F.when(F.col("name") == NO_MEASURE, 0).otherwise(complexity)
    ratio = F.when(F.col("comments") > 0, F.col("nbnc") / F.col("comments")).otherwise(0.0)
    return df.select(
        key, "seq", F.col("name").alias("routine_name"), F.substring(strip(F.col("line")), 1, 255).alias("routine_line"), F.col("line_num").alias("routine_lineNum"), F.col("line_col").alias("routine_lineCol"), F.col("line_nesting").alias("routine_lineNesting"), F.col("regex").alias("routine_regex"),
        F.col("nbnc").alias("routine_nbnc"), rank(F.col("nbnc"), ROUTINE_RANKS).alias("routine_nbncRank"), F.col("comments").alias("routine_comments"), rank(ratio, COMMENT_RANKS).alias("routine_commentsRank"),
        complexity.alias("routine_complexity"), rank(complexity, COMPLEXITY_RANKS).alias("routine_complexityRank"), F.col("max_nesting").alias("routine_maxNesting"), rank(F.col("max_nesting"), NESTING_RANKS).alias("routine_maxNestingRank"),
        F.col("decisions").alias("routine_c_decisions"), F.col("cases").alias("routine_c_cases"), F.col("booleans").alias("routine_c_booleans"), F.col("escapes").alias("routine_c_escapes"),
    )
