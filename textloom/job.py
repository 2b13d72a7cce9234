"""A whole measuring job: scan, route, measure each entry's files, bring the results together."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import rank
from textloom.operators import aggregate, analyze, dupes, measure, routines, search
from textloom.operators.routing import entries_of, folder_counts, routed
from textloom.plans.config import ConfigError, Entry, entry, matches_measure, parse
from textloom.ship import ship
from textloom.sources import filters
from textloom.sources.delta import delta
from textloom.sources.files import opened, scan, split_argument
from textloom.sources.sinks import dotted


@dataclass
class Options:
    paths: list[str] = field(default_factory=lambda: ["."])
    config: str | None = None
    config_name: str = "textloom.code"
    inline_entry: str | None = None
    recursive: bool = True
    file_filters: tuple[str, ...] = ()
    skip_dirs: tuple[str, ...] = filters.SKIP_DIRS
    skip_files: tuple[str, ...] = filters.SKIP_FILES
    skip_size: int = 0
    include_dirs: tuple[str, ...] = ()
    delta_path: str | None = None
    include_deleted: bool = False
    dupes: int | str | None = None
    metadata: tuple[str, ...] = ()
    measure_filter: str | None = None
    tags: bool = True


def configs_of(spark: SparkSession, o: Options) -> dict[str, list[Entry]]:
    """Config texts by folder: an inline entry or a given text holds for all; else files of the config's name in the tree."""
    extra: list[tuple[str, str | None]] = []
    if o.skip_size:
        extra.append(("IGNORE_SIZE", str(o.skip_size)))
    if o.measure_filter:
        extra.append(("MEASURE_FILTER", o.measure_filter))
    if o.inline_entry:
        e = entry(o.inline_entry)
        return {"": [Entry(e.verb, e.module, e.measure_filters, e.file_filters, e.tags, tuple(extra) + e.options)]}

    def parsed(text: str, folder: str) -> list[Entry]:
        return parse(text, lambda path: _config_text(spark, path), tuple(extra), folder)

    if o.config is not None:
        return {"": parsed(o.config, split_argument(o.paths[0])[0] if o.paths else "")}
    from textloom.plans.defaults import DEFAULT_CONFIG

    # Without a config on a file's way up, that of the folder where the job runs holds, or else the library's own.
    here = Path(o.config_name)
    base = parsed(here.read_text("utf-8"), str(here.resolve().parent)) if here.is_file() else parse(DEFAULT_CONFIG, defaults=tuple(extra))
    found = scan(spark, o.paths, o.recursive, skip_files=(), file_filters=(o.config_name,)).select("dir", F.col("content").cast("string").alias("text")).collect()
    return {"": base} | {r.dir: parsed(r.text, r.dir) for r in found}


def _config_text(spark: SparkSession, path: str) -> str:
    """The text of an included config, which any storage that Spark reads may hold."""
    try:
        return spark.read.text(path, wholetext=True).first()[0]
    except AnalysisException:
        raise ConfigError(f"no config {path} to include") from None


def _of_entry(files: DataFrame, e: Entry) -> DataFrame:
    p = e.profile
    templates = tuple(q.regex for q in e.params) if e.verb == "tempmeasure" else ()
    if e.verb in ("measure", "tempmeasure"):
        got = measure.basic(files, p, "unit") if e.module == "NBNC" else measure.full(files, p, "unit", size="length", templates=templates)
    elif e.verb == "routines":
        got = routines.routines(files, p, e.params, "unit").drop("seq")
    elif e.verb == "search" and e.module == "Search":
        got = search.raw_search(files, e.params, p, "unit")
    elif e.verb == "search":
        got = search.code_search(files, e.params, p, "unit")
    elif e.verb == "multisearch":
        got = search.multi_line_search(files, e.params, p, "unit")
    elif e.module == "Depends":
        got = analyze.depends(files, p, "unit")
    elif e.module == "DupeLines":
        got = analyze.dupe_lines(files, p, "unit")
    else:  # analyze of a plain code module finds nothing
        got = files.select("unit").limit(0)
    wanted = tuple((p.measure_filter or ";".join(e.measure_filters)).split(";"))
    return got.select("unit", *(c for c in got.columns if c != "unit" and matches_measure(dotted(c), wanted)))


def run(spark: SparkSession, o: Options) -> DataFrame:
    """All result rows: metadata, tags and measures or items of every file and entry."""
    ship(spark)
    configs = configs_of(spark, o)
    files = scan(spark, o.paths, o.recursive, o.skip_dirs, (*o.skip_files, o.config_name), o.include_dirs, o.file_filters)
    return results(files, configs, o)


def _plan_of(e: Entry) -> tuple:
    """Entries alike in this are measured in one pass."""
    return e.verb, e.module, e.measure_filters, e.options, e.params


def results(files: DataFrame, configs: dict[str, list[Entry]], o: Options) -> DataFrame:
    """Result rows of the routed files. Entries that differ in tags and file filters only share a pass."""
    old = scan(files.sparkSession, o.delta_path, o.recursive, o.skip_dirs, o.skip_files) if o.delta_path else None
    at = folder_counts(routed(files, configs)).withColumn("unit", F.concat_ws("\x1f", "path", "config_dir", F.col("entry_ord").cast("string")))
    entries = {(d, i): e for d, i, e in entries_of(configs)}
    plans: dict[tuple, list[tuple[str, int, Entry]]] = {}
    for d, i in sorted((r[0], r[1]) for r in at.select("config_dir", "entry_ord").distinct().collect()):  # config entries in use
        plans.setdefault(_plan_of(entries[d, i]), []).append((d, i, entries[d, i]))
    parts = [_of_plan(at, same, old, o) for same in plans.values()]
    if not parts:
        return at.select("path", "name", "ext", "dir", "length").limit(0)
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if o.dupes is not None:
        df = dupes.by_size(df, o.dupes, "length", "name", "measure_Config") if isinstance(o.dupes, int) else dupes.by_checksum(df, "nbnc_crc", "measure_Config")
        df = dupes.suppressed(df)
    return df


def _of_plan(at: DataFrame, same: list[tuple[str, int, Entry]], old: DataFrame | None, o: Options) -> DataFrame:
    e = same[0][2]
    mine = {(d, i): (F.col("config_dir") == d) & (F.col("entry_ord") == i) for d, i, _ in same}
    own = opened(at.filter(reduce(lambda a, b: a | b, mine.values())), e.profile)
    if old is not None:
        own = delta(own, opened(old, e.profile), o.include_deleted or e.profile.include_deleted)
    got = _of_entry(own, e)
    columns = metadata(own, e, o)
    if o.tags:
        for n in range(max(len(x.plain_tags) for _, _, x in same)):
            columns.append(F.coalesce(*(F.when(mine[d, i], x.plain_tags[n]) for d, i, x in same if len(x.plain_tags) > n)).alias(f"tag{n + 1}"))
    if any(x.out_file for _, _, x in same):
        columns.append(F.coalesce(*(F.when(mine[d, i], x.out_file) for d, i, x in same if x.out_file)).alias("out_file"))
    if "debug" in {*o.metadata, *e.profile.metadata} or o.dupes is not None:
        columns += [F.lit(e.module).alias("measure_Module"), F.coalesce(*(F.when(mine[d, i], str(x)) for d, i, x in same)).alias("measure_Config")]
    meta = own.select("unit", "path", *columns)
    keep = "left" if e.verb in ("measure", "tempmeasure") else "inner"
    return meta.join(got, "unit", keep).drop("unit")


def metadata(own: DataFrame, e: Entry, o: Options) -> list:
    """Columns that tell about the file and the entry."""
    wanted = {*o.metadata, *e.profile.metadata}
    out = [F.col(c) for c in ("name", "ext", "dir", "length")]
    if "dirs" in wanted:
        out += [F.coalesce(F.get("dirs", F.lit(i)), F.lit("")).alias(f"dir{i + 1}") for i in range(8)]
    if "date" in wanted:
        out += [F.date_format("modified", f).alias(n) for f, n in (("yyyy", "file_dateYear"), ("MM", "file_dateMonth"), ("dd", "file_dateDay"))]
    if "dirfiles" in wanted:
        out += [F.col("dir_files"), rank(F.col("dir_files"), measure.FOLDER_RANKS).alias("dir_filesRank")]
    if "dupe_firstPath" in own.columns and o.dupes is None:
        out.append(F.col("dupe_firstPath"))
    return out


def summary(df: DataFrame) -> DataFrame:
    return aggregate.totals(df)
