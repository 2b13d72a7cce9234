"""Quality rules as a short-circuit cascade.

Each rule rejects documents by one statistic of the text. On a sample the
planner estimates every rule's cost and counts what it rejects, puts first the
rule with the most rejections per cost, looks at the survivors only, and
repeats. Costs are the work that a rule asks for, in passes over the text: a
statistic that an earlier rule has counted is free. So the order is the same
in every run. The cascade then evaluates the rules of a document in that order
and stops at the first that rejects. The order changes cost alone: a document
is kept when no rule rejects it.

The sample is drawn by a hash of the text. Nulls and empty texts have no words
and fail ``min_words``. Columns of the input pass through untouched, whatever
their names; one named like the result is replaced. An empty table gives an
empty result. Repeated rows are judged each by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = "#*$%&|<>"


class Doc:
    """One text and its statistics; ``work`` adds up what they cost, in characters read once."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.work = 1.0
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self.work += len(self.text)
            self._words = self.text.encode("utf-8", "surrogatepass").split()  # of bytes: splits at ASCII white space alone
        return self._words

    def n_words(self) -> int:
        return len(self.words)

    def word_chars(self) -> int:
        self.work += 0.6 * len(self.text)
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\x0c\r"))

    def n_symbols(self) -> int:
        self.work += 0.1 * len(SYMBOLS) * len(self.text)
        return sum(map(self.text.count, SYMBOLS))

    def n_lines(self) -> int:
        """Lines with a word."""
        self.work += 0.3 * len(self.text)
        return sum(1 for x in self.text.split("\n") if x.strip(" \t\x0b\x0c\r"))

    def n_dup_lines(self) -> int:
        self.work += 0.5 * len(self.text)
        seen: set[str] = set()
        n = 0
        for line in self.text.split("\n"):
            if line in seen:
                n += 1
            elif line.strip(" \t\x0b\x0c\r"):
                seen.add(line)
        return n

    def n_repeat_words(self) -> int:
        w = self.words
        self.work += 10 * len(w)
        windows = list(zip(w, w[1:], w[2:], strict=False))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        n, end = 0, 0
        for i, x in enumerate(windows):
            if counts[x] > 1:
                n += i + 3 - max(i, end)
                end = i + 3
        return n


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Doc], bool]


def production_rules(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 5, max_dup_line_pct: int = 50, max_word_chars: int = 15) -> list[Rule]:
    """The rules of the query and of the pipeline.

    Percentages: repeated words of all words; symbols of the characters in
    words; repeated lines of lines with a word. ``max_word_chars``: the mean
    length of a word.
    """
    return [
        Rule("repeat_words", lambda d: 100 * d.n_repeat_words() > max_repeat_pct * d.n_words()),
        Rule("symbols", lambda d: 100 * d.n_symbols() > max_symbol_pct * d.word_chars()),
        Rule("dup_lines", lambda d: 100 * d.n_dup_lines() > max_dup_line_pct * d.n_lines()),
        Rule("word_chars", lambda d: d.word_chars() > max_word_chars * d.n_words()),
        Rule("min_words", lambda d: d.n_words() < min_words),
    ]


def plan(texts: list[str | None], rules: list[Rule]) -> list[Rule]:
    """Order the rules by rejections per cost, each next one on what the rules before it let through."""
    order, left, open_rules = [], texts, list(rules)
    while open_rules:
        rates = []
        for i, rule in enumerate(open_rules):
            own = [Doc(t) for t in left]
            n = sum(rule.rejects(d) for d in own)
            rates.append((-(n + 1e-3) / (sum(d.work for d in own) + 1), i))
        best = open_rules.pop(min(rates)[1])
        order.append(best)
        left = [t for t in left if not best.rejects(Doc(t))]
    return order


def ordered(docs: DataFrame, rules: list[Rule], text: str, sample_rows: int) -> list[Rule]:
    """plan() on about ``sample_rows`` rows, drawn by a hash of the row: the bound on what the driver takes. It decides on cost alone."""
    n = docs.count()
    hashed = [F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    share = F.pmod(F.xxhash64(*hashed), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, n)))
    drawn = docs.filter(share).select(text).limit(2 * sample_rows).collect()  # the limit is out of reach but for copies of a row
    return plan(sorted(r[0] or "" for r in drawn), rules)


def first_rejection(doc: Doc, rules: list[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(doc)), None)


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", into: str = "rejected_by", sample_rows: int = 500) -> DataFrame:
    """Add ``into``: the first rule of the planned order that rejects the row, null for kept rows."""
    order = ordered(docs, rules or production_rules(), text, sample_rows)
    at, stay = docs.columns.index(text), [i for i, c in enumerate(docs.columns) if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([first_rejection(Doc(t), order) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), found], names=[*(b.schema.names[i] for i in stay), into])

    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in stay), T.StructField(into, T.StringType())]))


def keep(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 500) -> DataFrame:
    """The rows that no rule rejects, with the columns of the input."""
    order = ordered(docs, rules or production_rules(), text, sample_rows)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([first_rejection(Doc(t), order) is None for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def digest(docs: DataFrame, rules: list[Rule] | None = None, min_words: int = 50, max_repeat_pct: int = 50, sample_rows: int = 500) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of every row.

    A document that fails the base pair of rules isn't kept; for the others the
    cascade decides, over statistics that are counted once a document.
    """
    order = ordered(docs, rules or production_rules(min_words, max_repeat_pct), "text", sample_rows)
    fields = [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in range(len(COUNTS) + 2)]
            for t in b.column(1).to_pylist():
                doc = Doc(t)
                n = {c: getattr(doc, c)() for c in COUNTS}
                for c, v in n.items():
                    setattr(doc, c, lambda v=v: v)
                failed = n["n_words"] < min_words or 100 * n["n_repeat_words"] > max_repeat_pct * n["n_words"]
                for to, v in zip(columns, [*n.values(), failed, not failed and first_rejection(doc, order) is None], strict=True):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in columns[:-2]), *(pa.array(x, pa.bool_()) for x in columns[-2:])], names=[f.name for f in fields])

    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, T.StructType(fields))
