"""The library's own queries over the driver's tables, and SQL for each that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import lines_of, rank
from textloom.operators import aggregate, analyze, dupes, measure, routines, search
from textloom.operators.routing import folder_counts, nearest, routed
from textloom.plans.config import entry, matches_measure, param
from textloom.plans.profile import profile
from textloom.sources import filters
from textloom.sources.delta import added_lines
from textloom.sources.files import conversations_corpus, documents_corpus, events_corpus, opened, pages_corpus, source_line_sql
from textloom.sources.sinks import dotted

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return documents_corpus(_table(spark, sf, "documents"))


def _src(spark: SparkSession, sf: str) -> DataFrame:
    return events_corpus(_table(spark, sf, "events"))


def _web(spark: SparkSession, sf: str) -> DataFrame:
    return pages_corpus(_table(spark, sf, "pages"))


# SQL building blocks -----------------------------------------------------------------------------

DOC_FILES = "files AS (SELECT '/docs/' || lang || '/' || source || '/' || doc_id || '.txt' AS path, '/docs/' || lang || '/' || source AS dir, lang, source, doc_id || '.txt' AS name, text AS content FROM documents)"
WEB_FILES = "files AS (SELECT '/web/' || page_id || '.html' AS path, html AS content FROM pages)"
SRC_PATH = "'/src/p' || (user_id % 5) || '/u' || user_id || '.' || (CASE user_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'py' WHEN 2 THEN 'java' ELSE 'js' END)"
SRC_FILES = f"files AS (SELECT {SRC_PATH} AS path, min('/src/p' || (user_id % 5)) AS dir, min(CASE user_id % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'py' WHEN 2 THEN 'java' ELSE 'js' END) AS ext, string_agg({source_line_sql()}, chr(10) ORDER BY event_id) AS content FROM events GROUP BY {SRC_PATH})"
LINES = r"""
parts AS (SELECT path, CASE WHEN content = '' THEN [] ELSE string_split(regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '\n\z', ''), chr(10)) END AS l FROM files WHERE content IS NOT NULL),
raws AS (SELECT path, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS raw FROM parts),
lines AS (SELECT path, line_no, raw, replace(substring(raw, 1, 255), chr(0), '') AS line FROM raws)"""


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}', 'i')"


_SINGLE = "(" + _m("s", r"^\s*(//|;|rem|!)") + " OR (" + _m("s", r"^\s*#") + " AND NOT " + _m("s", r"^\s*#(\||def|inc|if|els|end)") + ") OR (" + _m("s", r"^\s*--") + " AND NOT " + _m("s", r"^\s*--\[") + "))"
_OPEN_RX = r"((^|[^/])/\*|--\[\[|=(begin|head|item)|#\||\{-|<!--|<%--)"
_CLOSE_RX = r"(\*/|\]\]|=(cut|end)|\|#|-\}|-->|--%>)"
_OPEN, _SAME, _CLOSE = _m("s", _OPEN_RX), _m("s", _OPEN_RX + ".*" + _CLOSE_RX), _m("s", _CLOSE_RX)
_BLANK = _m("line", r"""^[\s\\+.,;=\-/*'`"#!%{}()\[\]<>|]*$""")
_STRIPPED = r"""trim(regexp_replace(line, '(".+?")|(''.+?'')', '', 'g'), ' ' || chr(9))"""
_DEAD = _m("line", r"[;{}_\[\](]\s*$|[A-Za-z]\.[A-Za-z]|[&+\[\]|]|=>|=$")


def _classes(block: str) -> str:
    """Lines with block, in_comment and faux; ``block`` gives a line's block from the columns line and path."""
    return f"""
tb AS (SELECT *, regexp_matches(line, '^\\s*$') AS true_blank, {_STRIPPED} AS s FROM lines),
live0 AS (SELECT * FROM tb WHERE NOT true_blank),
live1 AS (SELECT *, {block} AS block FROM live0),
live2 AS (SELECT *, CASE WHEN block <> coalesce(lag(block) OVER w, 0) THEN 1 ELSE 0 END AS changed FROM live1 WINDOW w AS (PARTITION BY path ORDER BY line_no)),
live3 AS (SELECT *, sum(changed) OVER (PARTITION BY path ORDER BY line_no) AS grp, {_SINGLE} AS single, {_OPEN} AS opened, {_SAME} AS same, {_CLOSE} AS closed, {_BLANK} AS faux FROM live2),
live4 AS (SELECT *, NOT single AND opened AND NOT same AS f0, NOT closed AS f1 FROM live3),
live5 AS (SELECT *, CASE WHEN f0 = f1 THEN CASE WHEN f0 THEN 1 ELSE 0 END END AS k, coalesce(sum(CASE WHEN f0 AND NOT f1 THEN 1 ELSE 0 END) OVER b, 0) AS sw FROM live4 WINDOW b AS (PARTITION BY path, grp ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
live6 AS (SELECT *, last_value(k IGNORE NULLS) OVER b AS lk, last_value(CASE WHEN k IS NOT NULL THEN sw END IGNORE NULLS) OVER b AS lsw FROM live5 WINDOW b AS (PARTITION BY path, grp ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cl AS (SELECT path, line_no, raw, line, s, block, faux, ((coalesce(lk, 0) + sw - coalesce(lsw, 0)) % 2 = 1) OR single OR opened AS in_comment FROM live6)"""


#: The synthetic code has one machine detector at work: regions marked as generated.
_REGION = "CASE WHEN last_value(CASE WHEN regexp_matches(line, 'region\\b.*?\\bgenerated', 'i') THEN 1 WHEN regexp_matches(line, 'end\\s*region', 'i') THEN 0 END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 THEN 1 ELSE 0 END"
NBNC_DOCS = f"WITH {DOC_FILES}, {LINES}, {_classes('0')}"
NBNC_SRC = f"WITH {SRC_FILES}, {LINES}, {_classes('0')}"
CODE_SRC = f"WITH {SRC_FILES}, {LINES}, {_classes(_REGION)}, code AS (SELECT *, strpos(s, '//') > 0 OR strpos(s, '/*') > 0 AS inl FROM cl), c2 AS (SELECT *, CASE WHEN inl AND NOT starts_with(s, '#') THEN regexp_replace(s, '(//|/\\*).*$', '') ELSE s END AS body, NOT faux AND block = 0 AND NOT in_comment AS is_code, NOT faux AND block = 0 AND in_comment AS is_comment FROM code)"
_BASIC = "SELECT f.path, (SELECT count(*) FROM lines l WHERE l.path = f.path) AS file_total, count(c.path) FILTER (NOT faux AND NOT in_comment) AS file_nbnc, count(c.path) FILTER (NOT faux AND in_comment) AS file_comment FROM files f LEFT JOIN cl c ON c.path = f.path GROUP BY f.path"
_SIZE_RANK = "CASE WHEN file_nbnc <= 200 THEN '1 to 200' WHEN file_nbnc <= 600 THEN '201 to 600' WHEN file_nbnc <= 1800 THEN '601 to 1800' ELSE '1800+' END"


# Measures ----------------------------------------------------------------------------------------


@_query(f"{NBNC_DOCS}, b AS ({_BASIC}) SELECT *, {_SIZE_RANK} AS nbnc_rank FROM b")
def nbnc_docs(spark, sf):
    df = measure.basic(_docs(spark, sf), "NBNC")
    return df.withColumn("nbnc_rank", rank(F.col("file_nbnc"), measure.SIZE_RANKS))


@_query(f"{NBNC_SRC}, b AS ({_BASIC}) SELECT * FROM b")
def nbnc_src(spark, sf):
    return measure.basic(_src(spark, sf), "NBNC")


@_query(f"{NBNC_DOCS}, b AS ({_BASIC}) SELECT f.lang, count(*) AS files, sum(b.file_total)::BIGINT AS file_total, sum(b.file_nbnc)::BIGINT AS file_nbnc, sum(b.file_comment)::BIGINT AS file_comment FROM b JOIN files f USING (path) GROUP BY f.lang")
def nbnc_by_lang(spark, sf):
    docs = _docs(spark, sf)
    df = measure.basic(docs, "NBNC").join(docs.select("path", F.get("dirs", F.lit(1)).alias("lang")), "path")
    return df.groupBy("lang").agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in ("file_total", "file_nbnc", "file_comment")))


def _code_sql(columns: str) -> str:
    return f"{CODE_SRC} SELECT f.path, {columns} FROM files f LEFT JOIN c2 c ON c.path = f.path GROUP BY f.path"


def _n(cond: str) -> str:
    return f"nullif(count(c.path) FILTER ({cond}), 0)"


_COLUMNS = {
    "blank_true_faux_src": (("file_blankFaux", "file_blankTrue"), "count(c.path) FILTER (faux) AS \"file_blankFaux\", (SELECT count(*) FROM tb t WHERE t.path = f.path AND true_blank) AS \"file_blankTrue\""),
    "comment_fsm_src": (("file_nbnc", "file_comment"), "count(c.path) FILTER (is_code) AS file_nbnc, count(c.path) FILTER ((is_comment AND NOT " + _DEAD + ") OR (is_code AND inl)) AS file_comment"),
    "inline_comments_src": (("nbnc_inlineComments",), _n("is_code AND inl") + ' AS "nbnc_inlineComments"'),
    "dead_code_src": (("file_dead",), _n("is_comment AND " + _DEAD) + " AS file_dead"),
    "imports_src": (("nbnc_imports",), _n("is_code AND " + _m("body", r"\b(using|import|#*include)\b")) + " AS nbnc_imports"),
    "classes_src": (("nbnc_classes",), _n("is_code AND " + _m("body", r"\b(class|type|interface)\b")) + " AS nbnc_classes"),
    "preprocessor_src": (("nbnc_preprocessor",), _n("is_code AND " + _m("body", r"^\s*#(def|if|else|end)")) + " AS nbnc_preprocessor"),
    "decisions_src": (("nbnc_decisions",), _n("is_code AND " + _m("body", r"\b(if|elseif|elif|else|unless|for|foreach|while|until|when|from|where|join|find)\b")) + " AS nbnc_decisions"),
    "routines_count_src": (("nbnc_routines",), _n("is_code AND " + _m("body", r"\b(def|public|private|protected|static|void|sub|func|function|prop|property|proc|procedure)\s*[(\[ {]+")) + " AS nbnc_routines"),
    "semicolons_src": (("nbnc_semicolons",), "nullif(sum(CASE WHEN is_code THEN length(body) - length(replace(body, ';', '')) END), 0)::BIGINT AS nbnc_semicolons"),
    "machine_lines_src": (("file_machine",), _n("NOT faux AND block = 1") + " AS file_machine"),
}


def _code_query(columns: tuple[str, ...]) -> Query:
    return lambda spark, sf: measure.full(_src(spark, sf), "Code", crc=False).select("path", *columns)


for _name, (_columns, _sql) in _COLUMNS.items():
    _query(_code_sql(_sql), _name)(_code_query(_columns))


@_query(_code_sql("CASE WHEN count(c.path) FILTER ((is_comment AND NOT " + _DEAD + ") OR (is_code AND inl)) = 0 THEN 0.0 ELSE count(c.path) FILTER (is_code) * 1.0 / count(c.path) FILTER ((is_comment AND NOT " + _DEAD + ") OR (is_code AND inl)) END AS r").join(("SELECT path, CASE WHEN r <= 0 THEN '0%' WHEN r <= 4 THEN '> 25%' WHEN r <= 10 THEN '> 10%' WHEN r <= 20 THEN '> 5%' ELSE '< 5%' END AS \"file_commentRank\" FROM (", ")")))
def comment_rank_src(spark, sf):
    return measure.full(_src(spark, sf), "Code", crc=False).select("path", "file_commentRank")


@_query(f"WITH {WEB_FILES}, {LINES}, {_classes('0')} SELECT f.path, (SELECT count(*) FROM lines l WHERE l.path = f.path) AS file_total FROM files f")
def web_totals_pages(spark, sf):
    return measure.full(_web(spark, sf), "Web", crc=False).select("path", "file_total")


@_query(f"{NBNC_DOCS}, b AS ({_BASIC}) SELECT b.path, CASE WHEN file_nbnc > 0 THEN round(strlen(f.content) * 1.0 / file_nbnc, 6) END AS byte_ratio FROM b JOIN files f USING (path)")
def byte_ratio_docs(spark, sf):
    docs = _docs(spark, sf)
    df = measure.basic(docs, "NBNC").join(docs.select("path", "length"), "path")
    return df.select("path", F.when(F.col("file_nbnc") > 0, F.round(F.col("length") / F.col("file_nbnc"), 6)).alias("byte_ratio"))


@_query()
def full_code_src(spark, sf):
    return measure.full(_src(spark, sf), "Code", size="length")


def _crc_sql(start: str, column: str, lines: str) -> str:
    """Adler-32 with seed 0 of all bytes of a file's texts, line after line; ``lines`` selects path, line_no and t."""
    return f"""{start}, hexed AS (SELECT path, line_no, hex(encode(t)) AS h FROM ({lines})),
placed AS (SELECT path, h, sum(length(h) // 2) OVER (PARTITION BY path ORDER BY line_no DESC) AS rest FROM hexed),
bytes AS (SELECT path, rest, unnest(range(0, length(h) // 2)) AS i, h FROM placed),
sums AS (SELECT path, sum(('0x' || substring(h, 2 * i + 1, 2))::BIGINT) % 65521 AS a, sum((rest - i) * ('0x' || substring(h, 2 * i + 1, 2))::BIGINT) % 65521 AS b FROM bytes GROUP BY path)
SELECT f.path, nullif((b * 65536 + a)::BIGINT, 0) AS {column} FROM files f LEFT JOIN sums USING (path)"""


@_query(_crc_sql(f"WITH {SRC_FILES}, {LINES}", "file_crc", "SELECT path, line_no, raw || chr(10) AS t FROM raws"))
def file_crc_src(spark, sf):
    return measure.full(_src(spark, sf), "Code").select("path", "file_crc")


@_query(_crc_sql(CODE_SRC, "nbnc_crc", "SELECT path, line_no, ' ' || regexp_replace(line, '(.)', '\\1 ', 'gs') AS t FROM c2 WHERE is_code"))
def nbnc_crc_src(spark, sf):
    return measure.full(_src(spark, sf), "Code").select("path", "nbnc_crc")


# Search and analysis -----------------------------------------------------------------------------


@_query(f"WITH {DOC_FILES}, {LINES}, h AS (SELECT path, line_no, raw FROM lines WHERE regexp_matches(raw, 'token', 'i') AND NOT regexp_matches(raw, 'password', 'i')) SELECT path, line_no AS search_linenum, count(*) OVER (PARTITION BY path) AS search_total FROM h")
def search_docs_pos_neg(spark, sf):
    df = search.raw_search(_docs(spark, sf), (param("POSITIVE__token"), param("NEGATIVE__password")))
    return df.select("path", "search_linenum", "search_total")


def _code_search_sql(where: str, target: str = "body") -> str:
    return f"{CODE_SRC} SELECT path, line_no AS search_linenum, trim(line, ' ' || chr(9)) AS search_line FROM c2 WHERE NOT faux AND block = 0 AND {where} AND {_m(target, 'a')}"


@_query(_code_search_sql("NOT in_comment"))
def search_code_src(spark, sf):
    return search.code_search(_src(spark, sf), (param("a"),)).select("path", "search_linenum", "search_line")


@_query(_code_search_sql("true", "s"))
def search_comments_src(spark, sf):
    return search.code_search(_src(spark, sf), (param("a"),), profile("Code", (("SEARCH_COMMENTS", None),))).select("path", "search_linenum", "search_line")


@_query(_code_search_sql("in_comment"))
def search_only_comments_src(spark, sf):
    return search.code_search(_src(spark, sf), (param("a"),), profile("Code", (("ONLY_COMMENTS", None),))).select("path", "search_linenum", "search_line")


@_query(f"WITH {DOC_FILES} SELECT path, trim(regexp_extract(replace(content, chr(10), ''), '(?i)the ([a-z]+)', 1)) AS search_match FROM files WHERE regexp_matches(replace(content, chr(10), ''), '(?i)the ([a-z]+)')")
def search_multi_docs(spark, sf):
    return search.multi_line_search(_docs(spark, sf), (param(r"the[ ]([a-z]+)"),)).select("path", "search_match")


@_query(f"{CODE_SRC}, d AS (SELECT path, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM c2 WHERE is_code) SELECT path, norm AS depend_using, count(*) AS depend_count, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS depend_lines FROM d WHERE " + _m("norm", r"\b(using|import|#*include)\b") + " GROUP BY path, norm")
def depends_src(spark, sf):
    df = analyze.depends(_src(spark, sf))
    return df.withColumn("depend_lines", F.array_join(F.col("depend_lines").cast("array<string>"), ","))


@_query(f"{CODE_SRC}, d AS (SELECT path, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM c2 WHERE is_code) SELECT path, norm AS dupe_content, count(*) AS dupe_count FROM d GROUP BY path, norm")
def dupe_lines_src(spark, sf):
    return analyze.dupe_lines(_src(spark, sf)).select("path", "dupe_content", "dupe_count")


@_query(f"{CODE_SRC}, d AS (SELECT path, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM c2 WHERE is_code) SELECT norm AS dupe_content, count(*) AS dupe_count, count(DISTINCT path) AS dupe_files FROM d GROUP BY norm HAVING count(*) > 20")
def dupe_lines_global_threshold(spark, sf):
    return analyze.shared_lines(_src(spark, sf), 20).select("dupe_content", "dupe_count", "dupe_files")


@_query()
def routine_full_src(spark, sf):
    return routines.routines(_src(spark, sf), "Code", (param(r"def\s+(\w+)"),))


# Duplicates, aggregates, totals ------------------------------------------------------------------


@_query(f"WITH {DOC_FILES}, f AS (SELECT path, source AS name, strlen(content) AS length FROM files), g AS (SELECT *, min(path) OVER (PARTITION BY name, length) AS first FROM f) SELECT path, CASE WHEN first <> path THEN first END AS \"dupe_firstPath\" FROM g")
def dupe_files_size(spark, sf):
    docs = _docs(spark, sf).withColumn("group", F.get("dirs", F.lit(2)))
    return dupes.by_size(docs, 0, "length", "group").select("path", "dupe_firstPath")


@_query(f"WITH {DOC_FILES}, g AS (SELECT path, min(path) OVER (PARTITION BY content) AS first FROM files) SELECT path, CASE WHEN first <> path THEN first END AS \"dupe_firstPath\" FROM g")
def dupe_files_crc(spark, sf):
    docs = _docs(spark, sf).withColumn("crc", F.sha2("content", 256))
    return dupes.by_checksum(docs, "crc").select("path", "dupe_firstPath")


@_query(f"WITH {DOC_FILES}, g AS (SELECT count(*) AS n, sum(strlen(content)) AS size FROM files GROUP BY content HAVING count(*) > 1) SELECT count(*) AS dupe_groups, coalesce(sum(n), 0)::BIGINT AS dupe_files, coalesce(sum(size), 0)::BIGINT AS dupe_bytes FROM g")
def dupe_stats(spark, sf):
    docs = _docs(spark, sf).withColumn("crc", F.sha2("content", 256))
    return dupes.statistics(docs, ["crc"])


_DEPEND_ITEMS = f"{CODE_SRC}, d AS (SELECT path, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM c2 WHERE is_code), items AS (SELECT path, norm AS depend_using, count(*) AS depend_count, list(line_no ORDER BY line_no) AS depend_lines FROM d WHERE " + _m("norm", r"\b(using|import|#*include)\b") + " GROUP BY path, norm)"


@_query(f"{_DEPEND_ITEMS} SELECT depend_using, count(*) AS aggregate_count, sum(depend_count)::BIGINT AS depend_count FROM items GROUP BY depend_using HAVING sum(depend_count) > 5")
def agg_threshold(spark, sf):
    return aggregate.by_key(analyze.depends(_src(spark, sf)), "depend_using", ["depend_count"], threshold=("depend_count", 5))


@_query(f"{_DEPEND_ITEMS} SELECT depend_using, count(*) AS aggregate_count, array_to_string(flatten(list(depend_lines ORDER BY path)), ',') AS depend_lines FROM items GROUP BY depend_using")
def agg_key_lists(spark, sf):
    df = aggregate.by_key(analyze.depends(_src(spark, sf)), "depend_using", ["depend_lines"])
    return df.withColumn("depend_lines", F.array_join(F.col("depend_lines").cast("array<string>"), ","))


_TOTALS_SQL = f"{NBNC_SRC}, b AS ({_BASIC}), m AS (SELECT f.ext AS file_type, b.file_nbnc, b.file_comment FROM b JOIN files f USING (path)), u AS (SELECT 'ext' AS measure, file_type, 1.0 AS value FROM m UNION ALL SELECT 'file_nbnc', file_type, file_nbnc FROM m UNION ALL SELECT 'file_comment', file_type, file_comment FROM m), t AS (SELECT measure, file_type, sum(value)::DOUBLE AS total FROM u GROUP BY measure, file_type UNION ALL SELECT measure, NULL, sum(value)::DOUBLE FROM u GROUP BY measure)"


def _measured(spark, sf):
    src = _src(spark, sf)
    return measure.basic(src, "NBNC").join(src.select("path", "ext"), "path")


@_query(f"{_TOTALS_SQL} SELECT * FROM t")
def totals_rollup(spark, sf):
    return aggregate.totals(_measured(spark, sf))


@_query(f"{_TOTALS_SQL}, r AS (SELECT measure, file_type, total, row_number() OVER (PARTITION BY measure ORDER BY total DESC, file_type) AS place FROM t WHERE file_type IS NOT NULL) SELECT measure, file_type, total, place::INT AS place FROM r WHERE place <= 2")
def totals_topk(spark, sf):
    return aggregate.top(aggregate.totals(_measured(spark, sf)), 2)


@_query(f"{NBNC_SRC}, b AS ({_BASIC}) SELECT path, 'file_nbnc' AS measure, file_nbnc::DOUBLE AS value FROM b UNION ALL SELECT path, 'file_comment', file_comment::DOUBLE FROM b")
def unpivot_measures(spark, sf):
    df = measure.basic(_src(spark, sf), "NBNC")
    return df.unpivot(["path"], ["file_nbnc", "file_comment"], "measure", "value").withColumn("value", F.col("value").cast("double"))


# Routing and filters -----------------------------------------------------------------------------


@_query(f"WITH {DOC_FILES}, c(config_dir) AS (VALUES (''), ('/docs'), ('/docs/en'), ('/docs/en/src1')), j AS (SELECT f.path, c.config_dir, row_number() OVER (PARTITION BY f.path ORDER BY length(c.config_dir) DESC) AS r FROM files f JOIN c ON f.dir = c.config_dir OR starts_with(f.dir, c.config_dir || '/')) SELECT path, config_dir FROM j WHERE r = 1")
def route_longest_prefix(spark, sf):
    configs = spark.createDataFrame([("",), ("/docs",), ("/docs/en",), ("/docs/en/src1",)], "config_dir string")
    return nearest(_docs(spark, sf), configs).select("path", "config_dir")


_FANOUT = ("measure NBNC file.* *.c;*.py", "measure Code * *.c", "measure Code * *.j*")


@_query(f"WITH {SRC_FILES} SELECT path, e AS entry FROM files JOIN (VALUES ('measure NBNC file.* *.c;*.py'), ('measure Code * *.c'), ('measure Code * *.j*')) t(e) ON (e = 'measure NBNC file.* *.c;*.py' AND ext IN ('c', 'py')) OR (e = 'measure Code * *.c' AND ext = 'c') OR (e = 'measure Code * *.j*' AND starts_with(ext, 'j'))")
def route_fanout(spark, sf):
    entries = [entry(x) for x in _FANOUT]
    names = F.array(*(F.lit(str(e)) for e in sorted(entries, key=str)))
    return routed(_src(spark, sf), {"": entries}).select("path", F.get(names, F.col("entry_ord")).alias("entry"))


def _filtered(pattern: str) -> Query:
    return lambda spark, sf: _src(spark, sf).filter(filters.matches(F.col("name"), F.col("ext"), [pattern])).select("path")


_query(f"WITH {SRC_FILES} SELECT path FROM files WHERE regexp_matches(path, '/u[0-9]5[^/]*$')", "filter_glob")(_filtered("u[0-9]5*"))
_query(f"WITH {SRC_FILES} SELECT path FROM files WHERE ext NOT IN ('c', 'py')", "filter_ex")(_filtered("EX:*.c:*.py"))
_query(f"WITH {SRC_FILES} SELECT path FROM files WHERE regexp_matches(path, '/u1[^/]*$')", "filter_regex")(_filtered("RE:u1"))


@_query(f"WITH {DOC_FILES} SELECT path FROM files WHERE source NOT IN ('src1', 'src2')")
def skip_dirs_docs(spark, sf):
    return _docs(spark, sf).filter(~filters.in_skipped_dir(F.col("dirs"), ("src[12]",))).select("path")


@_query(f"WITH {DOC_FILES} SELECT path, strlen(content) <= 2000 AS opened FROM files")
def size_cap_docs(spark, sf):
    return opened(_docs(spark, sf), profile("NBNC", (("IGNORE_SIZE", "2000"), ("FORCE_ALL_TYPES", None)))).select("path", F.col("content").isNotNull().alias("opened"))


@_query(f"WITH {SRC_FILES}, n AS (SELECT path, dir, count(*) OVER (PARTITION BY dir) AS dir_files FROM files) SELECT path, dir_files, CASE WHEN dir_files <= 10 THEN '1 to 10' WHEN dir_files <= 30 THEN '11 to 30' WHEN dir_files <= 100 THEN '31 to 100' ELSE '100+' END AS rank FROM n")
def dir_files_rank(spark, sf):
    df = folder_counts(_src(spark, sf))
    return df.select("path", "dir_files", rank(F.col("dir_files"), measure.FOLDER_RANKS).alias("rank"))


@_query(f"WITH {DOC_FILES} SELECT path, 'docs' AS dir1, lang AS dir2, source AS dir3, '' AS dir4 FROM files")
def dirs_padded(spark, sf):
    return _docs(spark, sf).select("path", *(F.coalesce(F.get("dirs", F.lit(i)), F.lit("")).alias(f"dir{i + 1}") for i in range(4)))


@_query(f"{NBNC_SRC}, b AS ({_BASIC}) SELECT path, file_nbnc FROM b")
def measure_filter(spark, sf):
    df = measure.basic(_src(spark, sf), "NBNC")
    return df.select("path", *(c for c in df.columns if c != "path" and matches_measure(dotted(c), ("file.nb*",))))


@_query("SELECT '/chat/' || conv_id || '.txt' AS path, count(*) AS file_total FROM conversations GROUP BY conv_id")
def chat_lines(spark, sf):
    return conversations_corpus(_table(spark, sf, "conversations")).select("path", F.size(lines_of(F.col("content"))).cast("long").alias("file_total"))


@_query(f"WITH {DOC_FILES}, {LINES}, p AS (SELECT path, unnest(string_split(raw, '. ')) AS piece FROM lines) SELECT path, count(*) AS file_total FROM p GROUP BY path")
def rejoin_line_sep(spark, sf):
    return measure.basic(_docs(spark, sf), profile("NBNC", (("ADD_LINE_SEP", ". "),))).select("path", "file_total")


@_query(f"WITH {DOC_FILES}, {LINES}, o AS (SELECT path, raw AS line, count(*) AS n FROM lines WHERE line_no % 3 <> 0 GROUP BY path, raw), w AS (SELECT path, raw AS line, count(*) AS n FROM lines GROUP BY path, raw) SELECT w.path AS rel, w.line, (w.n - coalesce(o.n, 0))::BIGINT AS n FROM w LEFT JOIN o ON o.path = w.path AND o.line = w.line WHERE w.n > coalesce(o.n, 0)")
def delta_lines(spark, sf):
    new = _docs(spark, sf).select(F.col("path").alias("rel"), "content")
    old = new.withColumn("content", F.array_join(F.filter(lines_of(F.col("content")), lambda x, i: (i + 1) % 3 != 0), "\n"))
    return added_lines(new, old, "rel")


def queries() -> dict[str, Query]:
    from textloom import option_queries  # noqa: F401  adds its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
