"""Corpora: folders of files, and tables turned into files.

A corpus is a DataFrame (path, root, rel, dir, dirs, name, ext, length,
modified, content). ``content`` is null for a file that isn't opened; it is
decoded only where a later step asks for it, so a scan of metadata never reads
the files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.profile import Profile
from textloom.sources import filters

COLUMNS = ("path", "root", "rel", "dir", "dirs", "name", "ext", "length", "modified", "content")


def with_path_parts(df: DataFrame, root: str = "") -> DataFrame:
    """Derive root, rel, dir, dirs, name and ext from path."""
    rel = F.substring(F.col("path"), len(root) + 2, 1 << 30) if root else F.regexp_replace("path", "^/", "")
    df = df.withColumns({"root": F.lit(root), "rel": rel, "dir": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    dirs = F.filter(F.split(F.regexp_extract("rel", "^(.*)/[^/]*$", 1), "/"), lambda x: x != "")
    return df.withColumns({"dirs": dirs, "ext": filters.extension(F.col("name"))})


def decoded(content: Column) -> Column:
    """UTF-8, or line by line UTF-8 else Latin-1."""
    lines = F.split(F.decode(content, "ISO-8859-1"), "\n", -1)
    line = lambda x: F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), x)
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.array_join(F.transform(lines, line), "\n"))


def scan(spark: SparkSession, paths: list[str] | str = ".", recursive: bool = True, skip_dirs: tuple[str, ...] = filters.SKIP_DIRS, skip_files: tuple[str, ...] = filters.SKIP_FILES, include_dirs: tuple[str, ...] = (), file_filters: tuple[str, ...] = ()) -> DataFrame:
    """The files under one or several roots, filtered by name and folder before any is opened."""
    roots = [paths] if isinstance(paths, str) else list(paths)
    found = []
    for given in roots:
        root, own = split_argument(given)
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else f"{root}/*")
        at = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "%20", " ")
        base = root.rstrip("/")
        base = base if base.startswith("/") or "://" in base else _absolute(base)
        base = base.split("://", 1)[-1]
        df = with_path_parts(raw.select(at.alias("path"), "length", F.col("modificationTime").alias("modified"), "content"), base)
        df = df.filter(~filters.in_skipped_dir(F.col("dirs"), skip_dirs) & filters.in_included_dir(F.col("dir"), include_dirs))
        df = df.filter(~filters.matches(F.col("name"), F.col("ext"), skip_files) if skip_files else F.lit(True))
        df = df.filter(filters.matches(F.col("name"), F.col("ext"), (*file_filters, *own)))
        found.append(df)
    return reduce(DataFrame.unionByName, found).select(*COLUMNS)


def _absolute(path: str) -> str:
    from os.path import abspath

    return abspath(path)


def split_argument(given: str) -> tuple[str, tuple[str, ...]]:
    """A root, or root/filter;filter."""
    head, _, tail = given.rpartition("/")
    if any(c in tail for c in "*?[;"):
        return head or ".", tuple(x for x in tail.split(";") if x)
    return given.rstrip("/") or "/", ()


def opened(files: DataFrame, p: Profile) -> DataFrame:
    """content as text, or null where the profile or the content says not to open."""
    c = F.col("content")
    raw_type = dict(files.dtypes)["content"]
    if p.metadata_only:
        return files.withColumn("content", F.lit(None).cast("string"))
    closed = F.lit(False)
    if p.ignore_size > 0:
        closed |= F.col("length") > p.ignore_size
    for part in p.ignore_paths:
        closed |= F.contains(F.col("path"), F.lit(part))
    if not p.force_all:
        closed |= filters.is_non_code(F.col("name"))
    text = F.when(~closed, decoded(c) if raw_type == "binary" else c)
    df = files.withColumn("content", text)
    if p.force_all:
        return df
    return df.withColumn("content", F.when(~filters.has_magic(F.col("content")) & filters.is_text(F.col("content")), F.col("content")))


def _corpus(df: DataFrame) -> DataFrame:
    df = df.withColumn("length", F.octet_length("content").cast("long"))
    df = with_path_parts(df)
    if "modified" not in df.columns:
        df = df.withColumn("modified", F.lit(None).cast("timestamp"))
    return df.select(*COLUMNS)


def documents_corpus(docs: DataFrame) -> DataFrame:
    return _corpus(docs.select(F.concat(F.lit("/docs/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")))


def pages_corpus(pages: DataFrame) -> DataFrame:
    return _corpus(pages.select(F.concat(F.lit("/web/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content")))


def conversations_corpus(turns: DataFrame) -> DataFrame:
    """A file a conversation, a line a turn."""
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), F.regexp_replace(x["text"], "\n", " ")))
    df = turns.groupBy("conv_id").agg(F.array_join(said, "\n").alias("content"))
    return _corpus(df.select(F.concat(F.lit("/chat/"), "conv_id", F.lit(".txt")).alias("path"), "content"))


#: The lines of the synthetic code corpus, by event_id % 24; SQL that Spark and others read alike.
SOURCE_LINES = (
    "'import mod' || cast(user_id % 7 as varchar(9))",
    "'#include <lib' || cast(event_id % 5 as varchar(9)) || '.h>'",
    "''",
    "'// note ' || cast(event_id % 11 as varchar(9))",
    "'// x = a.b;'",
    "case when (event_id + user_id) % 3 = 0 then '/* open' else 'y = 2;' end",
    "'body text'",
    "'*/'",
    "'def fn' || cast(event_id % 13 as varchar(9)) || '(a):'",
    "'    if (a) {'",
    "'    return a; // done'",
    "'    case 1: x && y'",
    "'}'",
    "'-----'",
    "'class C' || cast(event_id % 3 as varchar(9)) || ' {'",
    "'s = \"/* no */\";'",
    "'        for x in y'",
    "'# hash'",
    "'/* one line */'",
    "'x = 1 or 2'",
    "case when (event_id + user_id) % 5 = 0 then '#region generated' else 'z = 3' end",
    "case when (event_id + user_id) % 2 = 0 then '#endregion' else 'w = 4' end",
    "'else: break'",
    "'total = total + step'",
)


def source_line_sql() -> str:
    return "case event_id % 24 " + " ".join(f"when {i} then {x}" for i, x in enumerate(SOURCE_LINES)) + " end"


def events_corpus(events: DataFrame) -> DataFrame:
    """Synthetic code: a file a user, a line an event."""
    df = events.select("user_id", "event_id", F.expr(source_line_sql().replace("varchar(9)", "string")).alias("line"))
    df = df.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("content"))
    ext = F.get(F.array(*map(F.lit, ("c", "py", "java", "js"))), (F.col("user_id") % 4).cast("int"))
    return _corpus(df.select(F.concat(F.lit("/src/p"), (F.col("user_id") % 5).cast("string"), F.lit("/u"), "user_id", F.lit("."), ext).alias("path"), "content"))
