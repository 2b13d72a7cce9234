"""Files to lines, and the line tests that need nothing but the line itself.

All tests are column expressions over one line, so they run inside the scan's
stage; what later operators shuffle is a word of bits a line, not its text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import java
from textloom.functions.text import lines_of, occurrences, odd_share_exceeds, strip, without_nulls
from textloom.plans.profile import Profile

#: Bits of a line.
SKIPPED, TRUE_BLANK, FAUX_BLANK, SINGLE_ON, OPEN_NEXT, CLOSED, IGNORE, IGNORE_FILE = (1 << i for i in range(8))
INLINE, IMPORT, CLASS, PREPROCESSOR, ROUTINE, DECISION, DEAD, TEMPLATE, FIRST_PIECE = (1 << i for i in range(8, 17))
ESCAPE, CASE, BOOLEAN, ROUTINE_START = (1 << i for i in range(17, 21))
_DETECT = 24


def pieces(files: DataFrame, p: Profile, key: str = "path", text: str = "content") -> DataFrame:
    """(key, line_no, piece_no, raw, line): every line, in pieces where a separator cuts it."""
    df = files.select(key, F.posexplode(lines_of(F.col(text))).alias("_pos", "raw"))
    df = df.select(key, (F.col("_pos") + 1).cast("int").alias("line_no"), "raw")
    if p.line_separator is None:
        df = df.withColumns({"piece_no": F.lit(0), "_piece": F.col("raw")})
    else:
        from re import escape

        df = df.select("*", F.posexplode(F.split("raw", escape(p.line_separator))).alias("piece_no", "_piece"))
    return df.select(key, "line_no", "piece_no", "raw", without_nulls(F.substring("_piece", 1, p.max_line)).alias("line"))


def looks_binary(line: Column) -> Column:
    """Letters, digits, white space and common punctuation don't prevail in the first 80 characters."""
    return odd_share_exceeds(F.substring(F.ltrim(line), 1, 80), r"""[^A-Za-z0-9\s~$\\/\-_<>=():*|;,"]""", 1, 15)


def without_inlines(line: Column, p: Profile) -> Column:
    """What stands before the first inline marker, unless the line starts with #."""
    rx = "(?s)(?:" + "|".join(f"\\Q{m}\\E" for m in p.inline) + ").*$"
    return F.when(line.startswith("#"), line).otherwise(F.regexp_replace(line, rx, "")) if p.inline else line


def stripped(line: Column, p: Profile) -> Column:
    return strip(F.regexp_replace(line, java(p.strings, p.ignore_case), ""))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def tested(df: DataFrame, p: Profile, templates: tuple[str, ...] = (), routine_params: tuple = ()) -> DataFrame:
    """Add ``bits`` and ``semicolons`` to pieces."""
    r = lambda c, pattern: c.rlike(java(pattern, p.ignore_case)) if pattern else F.lit(False)
    # The stripped line, and it without inline comments, are columns of their own: each is made once.
    df = df.withColumn("_s", stripped(F.col("line"), p))
    has_inline = _any([F.contains(F.col("_s"), F.lit(m)) for m in p.inline])
    df = df.withColumns({"_inline": has_inline, "_code": F.when(has_inline, without_inlines(F.col("_s"), p)).otherwise(F.col("_s"))})
    line, code = F.col("line"), F.col("_code")
    c = F.col("_s") if p.strip_for_comments else line
    opened = r(c, p.comment_open)
    same = F.when(opened, r(c, f"{p.comment_open}.*{p.comment_close}")).otherwise(F.lit(False)) if p.comment_open else F.lit(False)
    single = r(c, "^" + p.comment if not p.comment.startswith("^") else p.comment)
    shown = opened
    if p.close_code and p.comment_open:
        alone = r(c, rf"^{p.comment_open}((?!{p.comment_close}).)*{p.comment_close}\s*$")
        shown = opened & (~same | alone)
    flags = {
        TRUE_BLANK: line.rlike(java(r"^\s*$")),
        FAUX_BLANK: _any([r(line, x) for x in (p.blank, p.blank_add) if x] + ([r(line, r"^\s*(<[\w/\\]*>)+\s*$")] if p.blank_xml else [])),
        SINGLE_ON: single | shown,
        OPEN_NEXT: ~single & opened & ~same,
        CLOSED: r(c, p.comment_close),
        FIRST_PIECE: F.col("piece_no") == 0,
    }
    if p.skip_lines:
        flags[SKIPPED] = F.col("raw").rlike(java(p.skip_lines, p.ignore_case))
    elif p.skip_binary:
        flags[SKIPPED] = looks_binary(F.col("raw"))
    if p.module not in ("NBNC", "Search"):
        about = line if p.search_strings else code
        flags |= {
            INLINE: F.col("_inline"),
            IMPORT: r(code, p.imports),
            CLASS: r(code, p.classes),
            PREPROCESSOR: r(code, p.preprocessor),
            ROUTINE: r(code, p.routines),
            DECISION: r(about, p.decisions),
            ESCAPE: r(about, p.escapes),
            CASE: r(about, p.cases),
            BOOLEAN: r(about, p.booleans),
            DEAD: r(line, p.dead_code),
            TEMPLATE: _any([r(line, t) for t in templates]),
        }
        if p.block_ignore:
            flags[IGNORE] = F.contains(line, F.lit(p.block_ignore))
        if p.block_ignore_file:
            flags[IGNORE_FILE] = F.contains(line, F.lit(p.block_ignore_file))
        pairs = [x for detector in p.detectors for x in detector]
        for i, (start, end) in enumerate(pairs):
            flags[1 << (_DETECT + i)] = r(line, start)
            if end:
                flags[1 << (_DETECT + len(pairs) + i)] = r(line, end)
    bits = reduce(lambda a, b: a + b, (F.when(cond, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, cond in flags.items()))
    return df.withColumns({"bits": bits, "semicolons": occurrences(code, ";").cast("long")}).drop("_s", "_inline", "_code")


def has(bit: int, bits: str = "bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(bit).cast("long")) != 0
