"""Queries that run the options and lesser operators, each with SQL of its own.

An option's SQL is that of the default profile with the parts replaced that
the option changes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import aggregate, dupes, measure, routines, search
from textloom.operators.routing import preview
from textloom.plans.config import entry, param
from textloom.plans.profile import profile
from textloom.queries import _BASIC, _BLANK, _CLOSE_RX, _COLUMNS, _DEAD, _OPEN, _REGION, _SAME, _SINGLE, _STRIPPED, CODE_SRC, DOC_FILES, LINES, NBNC_SRC, SRC_FILES, WEB_FILES, _classes, _docs, _m, _query, _src, _web
from textloom.sources import filters
from textloom.sources.delta import delta

_DEAD_COMMENT = "(is_comment AND NOT " + _DEAD + ")"
_NBNC = 'count(c.path) FILTER (is_code) AS "file_nbnc"'
_COMMENT = f'count(c.path) FILTER ({_DEAD_COMMENT} OR (is_code AND inl)) AS "file_comment"'


def _some(cond: str, name: str) -> str:
    return f'nullif(count(c.path) FILTER ({cond}), 0) AS "{name}"'


def _changed(sql: str, changes: list[tuple[str, str]]) -> str:
    for old, new in changes:
        if old not in sql:
            raise ValueError(f"nothing to replace: {old}")
        sql = sql.replace(old, new)
    return sql


def _option(name: str, options: tuple[tuple[str, str | None], ...], changes: list[tuple[str, str]], columns: dict[str, str]) -> None:
    """A query opt_<name>_src of the named measures under the options."""
    sql = f"{_changed(CODE_SRC, changes)} SELECT f.path, {', '.join(columns.values())} FROM files f LEFT JOIN c2 c ON c.path = f.path GROUP BY f.path"

    def run(spark, sf):
        return measure.full(_src(spark, sf), profile("Code", options), crc=False).select("path", *columns)

    _query(sql, f"opt_{name}_src")(run)


_BOTH = {"file_nbnc": _NBNC, "file_comment": _COMMENT}
_BODY = lambda rx: "is_code AND " + _m("body", rx)
_TO_FN1 = [(r"region\b.*?\bgenerated", r"^def\sfn1\("), (r"end\s*region", "^class")]
_option("max_line_length", (("MAX_LINE_LENGTH", "12"),), [("substring(raw, 1, 255)", "substring(raw, 1, 12)")], _BOTH)
_option("skip_lines", (("SKIP_LINES", r"^\s*//"),), [("FROM raws)", r"FROM raws WHERE NOT regexp_matches(raw, '^\s*//', 'i'))")], _BOTH)
_option("blank_line", (("BLANK_LINE", r"^[\s}]*$"),), [(f"{_BLANK} AS faux", _m("line", r"^[\s}]*$") + " AS faux")], _BOTH | {"file_blankFaux": 'count(c.path) FILTER (faux) AS "file_blankFaux"'})
_option("blank_line_add", (("BLANK_LINE_ADD", r"^\s*else"),), [(f"{_BLANK} AS faux", f"({_BLANK} OR {_m('line', '^\\s*else')}) AS faux")], _BOTH | {"file_blankFaux": 'count(c.path) FILTER (faux) AS "file_blankFaux"'})
_option("comment_line", (("COMMENT_LINE", r"^\s*(body|;)"),), [(f"{_SINGLE} AS single", _m("s", r"^\s*(body|;)") + " AS single")], _BOTH)
_option("comment_open_close", (("COMMENT_OPEN", r"/\*"), ("COMMENT_CLOSE", r"(\*/|body)")), [(f"{_OPEN} AS opened", _m("s", r"/\*") + " AS opened"), (f"{_SAME} AS same", _m("s", r"/\*.*(\*/|body)") + " AS same"), (f"{_m('s', _CLOSE_RX)} AS closed", _m("s", r"(\*/|body)") + " AS closed")], _BOTH)
_option("comment_no_strip", (("COMMENT_NO_STRIP", None),), [(f"{x} AS {n}", f"{x.replace('(s,', '(line,')} AS {n}") for x, n in ((_SINGLE, "single"), (_OPEN, "opened"), (_SAME, "same"), (_m("s", _CLOSE_RX), "closed"))], _BOTH)
_option("comment_close_code", (("COMMENT_CLOSE_CODE", None),), [], _BOTH)
_option("strings", (("STRINGS", r"/\*.*?\*/"),), [(_STRIPPED, r"trim(regexp_replace(line, '/\*.*?\*/', '', 'g'), ' ' || chr(9))")], _BOTH)
_option("case_sensitive", (("CASE_SENSITIVE", None), ("CLASSES", r"\b(class|CLASS)\s+C[01]")), [(", 'i')", ", 'c')")], {"nbnc_classes": _some(_BODY(r"\b(class|CLASS)\s+C[01]").replace("'i'", "'c'"), "nbnc_classes")})
_option("inline", (("INLINE", "//"),), [("strpos(s, '//') > 0 OR strpos(s, '/*') > 0", "strpos(s, '//') > 0"), ("'(//|/\\*).*$'", "'//.*$'")], {"nbnc_inlineComments": _some("is_code AND inl", "nbnc_inlineComments")} | _BOTH)
_option("inline_exclude", (("INLINE_EXCLUDE", None),), [], {"file_comment": f'count(c.path) FILTER {_DEAD_COMMENT} AS "file_comment"'})
_option("decisions", (("DECISIONS", r"\b(if|x)\b"),), [], {"nbnc_decisions": _some(_BODY(r"\b(if|x)\b"), "nbnc_decisions")})
_option("imports", (("IMPORTS", "^import"),), [], {"nbnc_imports": _some(_BODY("^import"), "nbnc_imports")})
_option("classes", (("CLASSES", r"\bclass\s+c2"),), [], {"nbnc_classes": _some(_BODY(r"\bclass\s+c2"), "nbnc_classes")})
_option("preprocessor", (("PREPROCESSOR", r"^\s*[#](include|region)"),), [], {"nbnc_preprocessor": _some(_BODY(r"^\s*[#](include|region)"), "nbnc_preprocessor")})
_option("routines", (("ROUTINES", r"\bfn\d+"),), [], {"nbnc_routines": _some(_BODY(r"\bfn\d+"), "nbnc_routines")})
_option("deadcode", (("DEADCODE", r";\s*$"),), [], {"file_dead": _some("is_comment AND " + _m("line", r";\s*$"), "file_dead"), "file_comment": f'count(c.path) FILTER ((is_comment AND NOT {_m("line", ";\\s*$")}) OR (is_code AND inl)) AS "file_comment"'})
_option("deadcode_none", (("DEADCODE_NONE", None),), [], {"file_dead": 'NULL::BIGINT AS "file_dead"', "file_comment": 'count(c.path) FILTER (is_comment OR (is_code AND inl)) AS "file_comment"'})
_option("search_strings", (("SEARCH_STRINGS", None), ("DECISIONS", r"\b(no|if)\b")), [], {"nbnc_decisions": _some("is_code AND " + _m("line", r"\b(no|if)\b"), "nbnc_decisions")})
_option("measure_empties", (("MEASURE_EMPTIES", None),), [], {"file_machine": 'count(c.path) FILTER (NOT faux AND block = 1) AS "file_machine"', "file_dead": f'count(c.path) FILTER (is_comment AND {_DEAD}) AS "file_dead"', "nbnc_inlineComments": 'count(c.path) FILTER (is_code AND inl) AS "nbnc_inlineComments"', "file_content": '0::BIGINT AS "file_content"'})
_option("machine_none", (("MACHINE_NONE", None),), [(_REGION, "0")], _BOTH)
_option("machine_all", (("MACHINE_ALL", None),), [(_REGION, "1")], {"file_machine": _some("NOT faux", "file_machine"), "file_nbnc": _NBNC})
_option("machine_measure", (("MACHINE_MEASURE", None),), [("AND block = 0", "AND block = 1")], _BOTH)
_option("machine_detectors", (("MACHINE_DETECTORS", r"[['^def\\sfn1\\(', '^class']]"),), _TO_FN1, {"file_machine": _some("NOT faux AND block = 1", "file_machine"), "file_nbnc": _NBNC})
_option("machine_add_detect", (("MACHINE_NONE", None), ("MACHINE_ADD_DETECT", r"[['^def\\sfn1\\(', '^class']]")), _TO_FN1, {"file_machine": _some("NOT faux AND block = 1", "file_machine")})
_option("block_ignore", (("BLOCK_IGNORE", "generated"),), [(_REGION, "0")], _BOTH)


@_query(f"WITH {WEB_FILES}, {LINES}, {_changed(_classes('0'), [(f'{_BLANK} AS faux', f'({_BLANK} OR ' + _m('line', r'^\s*(<[\w/\\]*>)+\s*$') + ') AS faux')])}, b AS ({_BASIC}) SELECT * FROM b")
def opt_blank_line_xml_pages(spark, sf):
    return measure.basic(_web(spark, sf), profile("NBNC", (("BLANK_LINE_XML", None),)))


#: The pages have their scripts inside one line each, so a block never lasts longer.
_WEB_SRC = _changed(CODE_SRC, [(SRC_FILES, WEB_FILES), (_REGION, "CASE WHEN regexp_matches(line, '<script', 'i') THEN 2 ELSE 0 END"), ("AND block = 0", "AND block = 2")])


@_query(f"{_WEB_SRC}, n AS (SELECT f.path, count(c.path) FILTER (is_code) AS nbnc, nullif(count(c.path) FILTER (NOT faux AND block = 0), 0) AS content, count(c.path) FILTER ({_DEAD_COMMENT} OR (is_code AND inl)) AS file_comment FROM files f LEFT JOIN c2 c ON c.path = f.path GROUP BY f.path) SELECT path, nbnc AS file_nbnc, content AS file_content, content + nbnc AS file_code_content, file_comment FROM n")
def web_script_content_pages(spark, sf):
    return measure.full(_web(spark, sf), "Web", crc=False).select("path", "file_nbnc", "file_content", "file_code_content", "file_comment")


@_query(f"{CODE_SRC} SELECT f.path, {', '.join(sql for _, sql in _COLUMNS.values())} FROM files f LEFT JOIN c2 c ON c.path = f.path GROUP BY f.path")
def full_code_counts_src(spark, sf):
    """All counted measures of the Code module at once."""
    return measure.full(_src(spark, sf), "Code", crc=False).select("path", *(c for columns, _ in _COLUMNS.values() for c in columns))


@_query(f"{CODE_SRC}, n AS (SELECT path, count(*) FILTER (is_code) AS nbnc, count(*) FILTER (NOT faux AND block = 1) AS machine FROM c2 GROUP BY path) SELECT f.path, CASE WHEN nbnc > machine AND nbnc > 0 THEN round(strlen(f.content) * 1.0 / nbnc, 6) END AS byte_ratio FROM files f LEFT JOIN n USING (path)")
def byte_ratio_src(spark, sf):
    """G8 as measure.full() gives it."""
    df = measure.full(_src(spark, sf), "Code", size="length", crc=False)
    return df.select("path", F.round("nbnc_byteRatio", 6).alias("byte_ratio"))


# Search ------------------------------------------------------------------------------------------


@_query(f"{CODE_SRC} SELECT path, line_no AS search_linenum FROM c2 WHERE is_code AND regexp_matches(body, 'C', 'c')")
def opt_search_case_sensitive_src(spark, sf):
    return search.code_search(_src(spark, sf), (param("C"),), profile("Code", (("SEARCH_CASE_SENSITIVE", None),))).select("path", "search_linenum")


@_query(f"{CODE_SRC} SELECT path, line_no AS search_linenum FROM c2 WHERE is_code AND contains(CASE WHEN starts_with(line, '#') THEN line ELSE regexp_replace(line, '(//|/\\*).*$', '') END, chr(34))")
def opt_search_in_strings_src(spark, sf):
    return search.code_search(_src(spark, sf), (param('"'),), profile("Code", (("SEARCH_STRINGS", None),))).select("path", "search_linenum")


# Routines ----------------------------------------------------------------------------------------

_FLAT = (("MACHINE_NONE", None), ("ROUTINE_SINGLE_LINE", None), ("ROUTINE_OUTPUT_SINGLE", None), ("ROUTINE_FILE_LINES", None), ("ROUTINE_IGNORE_COLUMN", "0"))


def _routine_sql(complexity: str, indent: int = 4, escapes: str = r"\b(return|continue|break|goto|except|catch|finally)\b", cases: str = r"\b(case)\b", booleans: str = r"(\s+and\s+|\s+or\s+|\|\||&&)") -> str:
    """Routines that begin in the first column and end where the next one begins; the line that begins one counts for the size of the one before."""
    decision = _m("body", r"\b(if|elseif|elif|else|unless|for|foreach|while|until|when|from|where|join|find)\b")
    return f"""{_changed(CODE_SRC, [(_REGION, "0")])},
r0 AS (SELECT *, is_code AND regexp_matches(line, 'def\\s+(\\w+)', 'i') AND NOT regexp_matches(line, '^\\s') AS st FROM c2 WHERE NOT faux),
r1 AS (SELECT *, sum(st::INT) OVER (PARTITION BY path ORDER BY line_no) AS g, is_code AND {decision} AS dec, is_code AND {_m("body", escapes)} AS esc, is_code AND {_m("body", cases)} AS cas, is_code AND {_m("body", booleans)} AS boo, length(regexp_extract(line, '^ *')) // {indent} AS nest FROM r0),
own AS (SELECT path, g, max(CASE WHEN st THEN line_no END) AS num, max(CASE WHEN st THEN regexp_extract(line, '(?i)def\\s+(\\w+)', 1) END) AS name, count(*) FILTER (dec) AS d, count(*) FILTER (esc) AS e, count(*) FILTER (cas) AS c, count(*) FILTER (boo) AS b, coalesce(max(nest) FILTER (dec), 0) AS deep FROM r1 GROUP BY path, g),
size AS (SELECT path, g - st::INT AS g, count(*) FILTER (is_code) AS nbnc, count(*) FILTER (is_comment AND NOT {_DEAD}) AS comments FROM r1 GROUP BY path, g - st::INT),
every AS (SELECT path, 0 AS g FROM lines UNION SELECT path, g FROM own)
SELECT path, (g + 1)::INT AS seq, coalesce(name, '(file lines grouped as routine)') AS routine_name, coalesce(num, 0)::BIGINT AS "routine_lineNum", coalesce(nbnc, 0)::BIGINT AS routine_nbnc, coalesce(comments, 0)::BIGINT AS routine_comments,
  ({complexity})::BIGINT AS routine_complexity, coalesce(deep, 0)::BIGINT AS "routine_maxNesting" FROM every LEFT JOIN own USING (path, g) LEFT JOIN size USING (path, g)"""


_D, _E, _C, _B = (f"coalesce({x}, 0)" for x in "decb")
for _name, _more, _sql in (
    ("flat", (), _routine_sql(f"{_D} + greatest(1, {_E}) + {_C}")),
    ("comp_incl_boolean", (("COMP_INCL_BOOLEAN", None),), _routine_sql(f"{_D} + greatest(1, {_E}) + {_C} + {_B}")),
    ("comp_excl_escapes", (("COMP_EXCL_ESCAPES", None),), _routine_sql(f"{_D} + {_C}")),
    ("comp_excl_cases", (("COMP_EXCL_CASES", None),), _routine_sql(f"{_D} + greatest(1, {_E})")),
    ("patterns", (("ESCAPES", r"\bx\b"), ("CASES", r"\by\b"), ("BOOLEANS", r"\d"), ("COMP_INCL_BOOLEAN", None)), _routine_sql(f"{_D} + greatest(1, {_E}) + {_C} + {_B}", escapes=r"\bx\b", cases=r"\by\b", booleans=r"\d")),
    ("nesting_indent", (("ROUTINE_NESTING_INDENT", "2"),), _routine_sql(f"{_D} + greatest(1, {_E}) + {_C}", indent=2)),
):

    def _routine_query(spark, sf, more=_more):
        df = routines.routines(_src(spark, sf), profile("Code", _FLAT + more), (param(r"def\s+(\w+)"),))
        return df.select("path", "seq", "routine_name", "routine_lineNum", "routine_nbnc", "routine_comments", "routine_complexity", "routine_maxNesting")

    _query(_sql, f"routines_{_name}_src")(_routine_query)


# Duplicates, aggregates, deltas, filters -----------------------------------------------------------


@_query(f"WITH {DOC_FILES} SELECT f.path, CASE WHEN min(f.path) OVER w <> f.path THEN f.path END AS \"dupe_fileName\", CASE WHEN min(f.path) OVER w <> f.path THEN split_part(min(f.path) OVER w, '/', 4) END AS dupe_dir3, CASE WHEN min(f.path) OVER w = f.path THEN strlen(f.content) END AS length FROM files f WINDOW w AS (PARTITION BY f.content)")
def dupe_rows_docs(spark, sf):
    """What is left of a duplicate's row."""
    docs = _docs(spark, sf).withColumn("crc", F.md5(F.col("content").cast("binary"))).select("path", "length", "crc")
    return dupes.suppressed(dupes.by_checksum(docs, "crc")).select("path", "dupe_fileName", "dupe_dir3", F.col("length"))


_NEAR = f"""WITH RECURSIVE {DOC_FILES},
sizes AS (SELECT source AS name, strlen(content) AS length, min(path) AS first FROM files WHERE content IS NOT NULL GROUP BY source, strlen(content)),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first) AS rn FROM sizes),
walk AS (
  SELECT name, 0::BIGINT AS rn, []::STRUCT(s BIGINT, p VARCHAR)[] AS held, NULL::BIGINT AS length, NULL::VARCHAR AS bucket FROM (SELECT DISTINCT name FROM sizes)
  UNION ALL
  SELECT z.name, z.rn, CASE WHEN len(list_filter(w.held, lambda x: abs(x.s - z.length) <= 4)) = 0 THEN list_append(w.held, {{'s': z.length, 'p': z.first}}) ELSE w.held END, z.length, coalesce(list_filter(w.held, lambda x: abs(x.s - z.length) <= 4)[1].p, z.first)
  FROM walk w JOIN placed z ON z.name = w.name AND z.rn = w.rn + 1)
SELECT f.path, CASE WHEN w.bucket <> f.path THEN w.bucket END AS "dupe_firstPath" FROM files f LEFT JOIN walk w ON w.name = f.source AND w.length = strlen(f.content)"""


@_query(_NEAR, "dupe_files_near")
def _dupe_files_near(spark, sf):
    docs = _docs(spark, sf).withColumn("group", F.get("dirs", F.lit(2)))
    return dupes.by_size(docs, 4, "length", "group").select("path", "dupe_firstPath")


@_query(f"WITH {DOC_FILES} SELECT source, arg_max(name, path) AS name, count(*) AS aggregate_count FROM files GROUP BY source")
def agg_last_value(spark, sf):
    docs = _docs(spark, sf).select("path", F.get("dirs", F.lit(2)).alias("source"), "name")
    return aggregate.by_key(docs, "source", ["name"]).select("source", "name", "aggregate_count")


@_query(f"WITH {DOC_FILES}, m AS (SELECT source, lang, sum(strlen(content))::BIGINT AS n FROM files GROUP BY source, lang) SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS sizes FROM m GROUP BY source")
def agg_maps(spark, sf):
    docs = _docs(spark, sf).select("path", F.get("dirs", F.lit(2)).alias("source"), F.create_map(F.get("dirs", F.lit(1)), F.col("length")).alias("sizes"))
    merged = aggregate.by_key(docs, "source", ["sizes"])
    return merged.select("source", F.array_join(F.transform(F.array_sort(F.map_entries("sizes")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("sizes"))


@_query(f"{NBNC_SRC} SELECT 'folders' AS counter, count(DISTINCT dir) AS value FROM files UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'measured', count(*) FROM files UNION ALL SELECT 'rows', count(*) FROM files")
def job_counters(spark, sf):
    src = _src(spark, sf)
    return aggregate.counters(src, measure.basic(src, "NBNC"))


@_query(f"WITH {DOC_FILES}, {LINES}, n AS (SELECT path, max(line_no) AS n FROM lines GROUP BY path) SELECT f.path, CASE f.k WHEN 1 THEN '' WHEN 2 THEN coalesce((SELECT l.raw FROM lines l JOIN n USING (path) WHERE l.path = f.path AND l.line_no = n.n) || chr(10), '') ELSE f.content END AS content FROM (SELECT *, replace(name, '.txt', '')::BIGINT % 3 AS k FROM files WHERE len(string_split(content, chr(10))) < 100) f")
def delta_docs(spark, sf):
    """delta(): a new file keeps all lines, an equal one none, one that got a last line that line."""
    docs = _docs(spark, sf).filter(F.size(F.split("content", "\n", -1)) < 100).select("path", F.col("path").alias("rel"), "content")
    k = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 3
    lines = F.split(F.regexp_replace("content", "\n\\z", ""), "\n", -1)
    cut = F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")
    old = docs.filter(k > 0).withColumn("content", F.when(k == 1, F.col("content")).otherwise(cut))
    return delta(docs, old).select("path", "content")


@_query(f"WITH {SRC_FILES} SELECT path FROM files WHERE dir IN ('/src/p1', '/src/p3')")
def include_dirs_src(spark, sf):
    return _src(spark, sf).filter(filters.in_included_dir(F.col("dir"), ("*p1", "*p3"))).select("path")


@_query(f"WITH {SRC_FILES} SELECT DISTINCT dir, ext, CASE WHEN ext = 'c' THEN 'measure Code * *.c' ELSE 'measure NBNC * *.py' END AS entry FROM files WHERE ext IN ('c', 'py')")
def route_preview(spark, sf):
    entries = [entry("measure Code * *.c"), entry("measure NBNC * *.py")]
    names = F.array(*(F.lit(str(e)) for e in sorted(entries, key=str)))
    return preview(_src(spark, sf), {"": entries}).select("dir", "ext", F.get(names, F.col("entry_ord")).alias("entry"))
