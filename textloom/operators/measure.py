"""Per-file measures: counts of classified lines, ratios and rank labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import rank
from textloom.operators import lines as L
from textloom.operators.states import comment_windows, folded
from textloom.plans.profile import CONTENT, HUMAN, MACHINE, Profile, profile

#: The label of the first threshold at or above the value.
COMMENT_RANKS = [(0, "0%"), (4, "> 25%"), (10, "> 10%"), (20, "> 5%"), (None, "< 5%")]
SIZE_RANKS = [(200, "1 to 200"), (600, "201 to 600"), (1800, "601 to 1800"), (None, "1800+")]
IMPORT_RANKS = [(4, "0 to 4"), (10, "5 to 10"), (20, "10 to 20"), (None, "21+")]
ROUTINE_RANKS = [(50, "1 to 50"), (100, "51 to 100"), (200, "101 to 200"), (None, "200+")]
COMPLEXITY_RANKS = [(6, "1 to 6"), (14, "7 to 14"), (30, "15 to 30"), (None, "31+")]
NESTING_RANKS = [(2, "0 to 2"), (5, "3 to 4"), (None, "5+")]
FOLDER_RANKS = [(10, "1 to 10"), (30, "11 to 30"), (100, "31 to 100"), (None, "100+")]


def classified(files: DataFrame, p: Profile | str = "NBNC", key: str = "path", text: str = "content", templates: tuple[str, ...] = (), crc: bool = True, line: bool = True) -> DataFrame:
    """All lines with their bits, block and comment state; with ``line``, the line itself."""
    p = profile(p) if isinstance(p, str) else p
    df = L.pieces(files.select(key, text), p, key, text)
    if p.hooks.preprocess:
        df = df.withColumn("line", p.hooks.preprocess(F.col("line")))
    df = L.tested(df, p, templates)
    if p.module in ("NBNC", "Search") or not (p.has_blocks or crc):
        return comment_windows(df, key).withColumns({"block": F.lit(HUMAN), "changed": F.lit(False)})
    return folded(df, p, key, crc, line)


def line_class(p: Profile) -> Column:
    """One letter a line: - skipped, T and B true and faux blank, C comment, F template, D dead code, I inline comment, N code, M and + lines of other blocks."""
    live = F.col("block") == p.measured_block
    code = p.module not in ("NBNC", "Search")
    out = F.when(L.has(L.SKIPPED), "-").when(L.has(L.TRUE_BLANK), "T").when(L.has(L.FAUX_BLANK), "B")
    if code:
        out = out.when(~live & (F.col("block") == MACHINE), "M").when(~live & (F.col("block") == _content(p)), "+").when(~live, "o")
        out = out.when(F.col("in_comment") & L.has(L.TEMPLATE), "F").when(F.col("in_comment") & L.has(L.DEAD), "D")
    out = out.when(F.col("in_comment"), "C")
    return (out.when(L.has(L.INLINE), "I") if code else out).otherwise("N")


def _content(p: Profile) -> int:
    """The block of content lines: what isn't script, for web pages."""
    return HUMAN if p.module == "Web" else CONTENT


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))


def basic(files: DataFrame, p: Profile | str = "NBNC", key: str = "path", text: str = "content") -> DataFrame:
    """(key, file_total, file_nbnc, file_comment); files without lines, or not opened, count zero."""
    p = profile(p) if isinstance(p, str) else p
    df = classified(files, p, key, text).withColumn("_c", line_class(p))
    per = df.groupBy(key).agg(_count(F.col("_c") != "-").alias("file_total"), _count(F.col("_c") == "N").alias("file_nbnc"), _count(F.col("_c") == "C").alias("file_comment"))
    return files.select(key).join(per, key, "left").na.fill(0, ["file_total", "file_nbnc", "file_comment"])


def full(files: DataFrame, p: Profile | str = "Code", key: str = "path", text: str = "content", size: str | None = None, templates: tuple[str, ...] = (), crc: bool = True) -> DataFrame:
    """All code measures, one row a file. Measures that are written only when positive are null otherwise."""
    p = profile(p) if isinstance(p, str) else p
    df = classified(files, p, key, text, templates, crc, line=bool(p.hooks.counts)).withColumn("_c", line_class(p))
    c, live = F.col("_c"), F.col("block") == p.measured_block
    code = c.isin("N", "I")
    first = (F.col("piece_no") == 0)
    aggs = {
        "_raw": _count(first),
        "_skipped": _count((c == "-") & first),
        "file_total": _count(c != "-"),
        "file_blankFaux": _count(c == "B"),
        "file_blankTrue": _count(c == "T"),
        "file_nbnc": _count(code & live),
        "_machine": _count(c == "M") if p.measured_block != MACHINE else _count(code & live),
        "_content": _count(c == "+") if p.measured_block != _content(p) else _count(code & live),
        "file_blank": _count(c.isin("T", "B") & live),
        "_comment": _count(c == "C"),
        "_inline": _count(c == "I"),
        "_dead": _count(c == "D"),
        "_template": _count(c == "F"),
        "_semicolons": F.sum(F.when(code, F.col("semicolons")).otherwise(0)),
        "_preprocessor": _count(code & L.has(L.PREPROCESSOR)),
        "_imports": _count(code & L.has(L.IMPORT)),
        "_decisions": _count(code & L.has(L.DECISION)),
        "_routines": _count(code & L.has(L.ROUTINE)),
        "_classes": _count(code & L.has(L.CLASS)),
    }
    if crc:
        aggs |= {"_code_crc": F.max_by("code_crc", F.struct("line_no", "piece_no")), "_raw_crc": F.max_by("raw_crc", F.struct("line_no", "piece_no"))}
    aggs |= {f"_hook{i}": _count(of(df)) for i, (_, of) in enumerate(p.hooks.counts)}
    df = df.groupBy(key).agg(*(a.alias(n) for n, a in aggs.items()))
    keep = [key] + ([size] if size else [])
    df = files.select(*keep).join(df, key, "left").na.fill(0, list(aggs))
    some = lambda n: F.when(F.col(n) > 0, F.col(n))
    empty = (lambda n: F.coalesce(some(n), F.lit(0))) if p.write_empties else some
    df = df.withColumn("file_comment", F.col("_comment") + F.col("_inline") if p.inline_in_comments else F.col("_comment"))
    ratio = F.when(F.col("file_comment") > 0, F.col("file_nbnc") / F.col("file_comment")).otherwise(0.0)
    out = {
        "file_total": F.col("file_total"),
        "file_rawTotal": F.when(F.col("_raw") != F.col("file_total"), F.col("_raw")),
        "file_ignored": some("_skipped"),
        "file_blankFaux": F.col("file_blankFaux"),
        "file_blankTrue": F.col("file_blankTrue"),
        "file_nbnc": F.col("file_nbnc"),
        "file_nbncRank": rank(F.col("file_nbnc"), SIZE_RANKS),
        "file_machine": empty("_machine"),
        "file_content": empty("_content"),
        "file_code_content": F.when((F.col("_content") > 0) | F.lit(p.write_empties), F.col("_content") + F.col("file_nbnc")),
        "file_blank": F.col("file_blank"),
        "file_comment": F.col("file_comment"),
        "nbnc_inlineComments": empty("_inline"),
        "file_commentRank": rank(ratio, COMMENT_RANKS),
        "file_dead": empty("_dead"),
        "nbnc_semicolons": some("_semicolons"),
        "nbnc_preprocessor": some("_preprocessor"),
        "file_template": some("_template"),
        "nbnc_imports": some("_imports"),
        "nbnc_importRank": F.when(F.col("_imports") > 0, rank(F.col("_imports"), IMPORT_RANKS)),
        "nbnc_decisions": some("_decisions"),
        "nbnc_routines": some("_routines"),
        "nbnc_classes": some("_classes"),
    }
    if crc:
        out |= {"nbnc_crc": some("_code_crc"), "file_crc": some("_raw_crc")}
    if size:
        most = (F.col(size) > 0) & (F.col("file_nbnc") > 0) & (F.col("file_nbnc") > F.col("_machine")) & (F.col("file_nbnc") > F.col("_content"))
        out["nbnc_byteRatio"] = F.when(most, F.col(size) / F.col("file_nbnc"))
    out |= {n: F.col(f"_hook{i}") for i, (n, _) in enumerate(p.hooks.counts)}
    df = df.select(key, *(x.alias(n) for n, x in out.items()))
    return p.hooks.file(df) if p.hooks.file else df
