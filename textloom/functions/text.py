"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as white space in Unicode text.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
MAX_LINE = 255


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def lines_of(text: Column) -> Column:
    """Array of lines under universal newlines; a final newline ends the last line, '' has none, null stays null."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(unix, "\n\\z", ""), "\n", -1))


def without_nulls(c: Column) -> Column:
    """Drop NUL and newline characters."""
    return F.translate(c, "\x00\n", "")


def cut(c: Column, n: int = MAX_LINE) -> Column:
    return F.substring(c, 1, n)


def printable(c: Column) -> Column:
    """For output: tabs become two spaces, control characters below 31 go."""
    return F.regexp_replace(F.replace(c, F.lit("\t"), F.lit("  ")), "[\\x00-\\x1e]", "")


def without_extended(c: Column) -> Column:
    """Drop the characters 127 to 254."""
    return F.regexp_replace(c, "[\\x7f-\\xfe]", "")


def fit(c: Column, n: int) -> Column:
    """Shorten to n characters with an ellipsis in the middle."""
    left = (n - 3) // 2
    right = n - 3 - left
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, left), F.lit("..."), F.substring(c, -right, right)))


def single_spaced(c: Column) -> Column:
    return strip(F.regexp_replace(c, "(?U)\\s+", " "))


def occurrences(c: Column, part: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))).cast("long") / F.lit(len(part))


def first_group(line: Column, regex: str, groups: int) -> Column:
    """The first non-empty group of the first match, trimmed; '' without groups."""
    if not groups:
        return F.lit("")
    found = (F.nullif(F.regexp_extract(line, regex, i), F.lit("")) for i in range(1, groups + 1))
    return strip(F.coalesce(*found, F.lit("")))


def rank(value: Column, table: list[tuple[float | None, str]]) -> Column:
    """The label of the first threshold at or above the value; the last threshold is None: no limit."""
    out = F.lit(table[-1][1])
    for limit, label in reversed(table[:-1]):
        out = F.when(value <= limit, label).otherwise(out)
    return out


def expanded_indent(line: Column, tab: int = 4) -> Column:
    """Width of the leading white space with tabs at multiples of ``tab``."""
    lead = F.split(F.regexp_extract(line, "^\\s*", 0), "")
    step = F.aggregate(lead, F.lit(0), lambda n, ch: F.when(ch == "\t", n + tab - n % tab).when(ch == "", n).otherwise(n + 1))
    return F.when(line.rlike("^\\s"), step).otherwise(0)


def odd_share_exceeds(text: Column, odd: str, start: int, least: int, most: float = 0.2) -> Column:
    """Whether the odd characters, from position ``start`` on, are over a share of the positions read, anywhere from position ``least`` on or at the end.

    The share can first pass the limit at position ``least``, at an odd
    character, or at the end, so the walk goes from odd character to odd one.
    """
    n = F.length(text)

    def step(s: Column, gap: Column) -> Column:
        q = s["at"] + F.length(gap) + 1  # an odd character stands here, or the text has ended
        at_least = (s["at"] < least) & (q > least) & (s["bad"] > most * least) & (n >= least)
        at_odd = (q <= n) & ((q >= least) | (q == n)) & (s["bad"] + 1 > q * most)
        at_end = (q > n) & (n < least) & (s["bad"] > n * most)
        return F.struct(q.alias("at"), F.when(q <= n, s["bad"] + 1).otherwise(s["bad"]).alias("bad"), (s["over"] | at_least | at_odd | at_end).alias("over"))

    start_at = F.struct(F.lit(start - 1).alias("at"), F.lit(0).alias("bad"), F.lit(False).alias("over"))
    walked = F.aggregate(F.split(F.substring(text, start, 1 << 30), odd, -1), start_at, step)["over"]
    return F.when(~text.rlike(odd), F.lit(False)).otherwise(walked)


_MOD = 65521


def adler_parts(data: Column) -> tuple[Column, Column, Column]:
    """(a, b, n): sum of bytes, sum of running sums, and their number, of a binary column; a and b modulo 65521.

    Checksums with seed 0; parts of neighbouring pieces combine to
    (a1 + a2, b1 + n2 * a1 + b2, n1 + n2).
    """
    n = F.octet_length(data).cast("long")
    hexed = F.hex(data)
    index = F.sequence(F.lit(0), n - 1)
    byte = lambda i: F.conv(F.substr(hexed, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long")
    a = F.aggregate(index, F.lit(0).cast("long"), lambda s, i: s + byte(i))
    b = F.aggregate(index, F.lit(0).cast("long"), lambda s, i: s + (n - i) * byte(i))
    return F.when(n > 0, a % _MOD).otherwise(F.lit(0).cast("long")), F.when(n > 0, b % _MOD).otherwise(F.lit(0).cast("long")), n


def adler32(data: Column) -> Column:
    """Adler-32 with seed 0 of a binary column."""
    a, b, _ = adler_parts(data)
    return b * 65536 + a
