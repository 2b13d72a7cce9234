"""Command line: python -m textloom PATH... [options]."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.job import Options, configs_of, run, summary
from textloom.operators import aggregate
from textloom.operators.routing import preview
from textloom.plans.config import SCAN_ALL
from textloom.plans.profile import MODULES, OPTIONS, VERBS
from textloom.sources import filters, sinks
from textloom.sources.files import scan

METADATA = {"a": ("dirs", "date", "dirfiles", "debug"), "d": ("date",), "f": ("dirfiles",), "p": ("dirs",), "r": ("debug",), "s": (), "y": ("date",), "z": ("debug",)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("textloom", description="Measure and search code and text files.")
    add = p.add_argument
    add("paths", nargs="*", default=["."], help="folders, or folder/filter;filter")
    add("-a", "--all", nargs="?", const="n", choices=["m", "n", "d"], help="every file: metadata only, line counts, or code measures")
    add("-b", "--break-on-error", action="store_true", help="stop at the first file that can't be read, rather than leave it out")
    add("-c", "--config-name", help="name of the config files in the tree")
    add("-ci", "--config-info", action="store_true", help="show which entries measure which files")
    add("-cc", "--config-entry", help="one entry instead of config files")
    add("-d", "--delta", help="only lines added to this older tree")
    add("-dd", "--delta-deleted", help="the same, with deleted lines")
    add("-e", "--dupes", nargs="?", const="crc", help="suppress duplicate files: bytes of tolerance, or by checksum")
    add("-f", "--measure-filter", help="measures to write; metadata: none but those")
    add("-g", "--aggregate", nargs="+", metavar="KEY", help="key, names or all, and a threshold column and value")
    add("-i", "--include-dirs", help="folders to keep, by pattern; several with ;")
    add("-m", "--metadata", default="", help="letters of a d f p r s y z")
    add("-n", "--no-recursion", action="store_true")
    add("-o", "--output", help="folder to write, or stdout")
    add("-p", "--progress", action="store_true")
    add("-q", "--quiet", action="store_true")
    add("-r", "--format", default="csv", choices=["csv", "tab", "xml", "paragraph"])
    add("-sd", "--skip-dirs", default=";".join(filters.SKIP_DIRS))
    add("-sf", "--skip-files", default=";".join(filters.SKIP_FILES))
    add("-ss", "--skip-size", type=int, default=0)
    add("-t", "--totals", action="store_true", help="totals only")
    add("-v", "--verbose", nargs="?", const=5, type=int, help="totals by file type, and the largest")
    add("-w", "--workers", type=int, help="local cores")
    add("-y", "--debug", action="store_true", help="print the plan before it runs")
    add("-z", "--profile", action="store_true", help="print how long each step took")
    add("-?", "--modules", nargs="?", const="", metavar="MODULE", help="list modules, verbs and options, or what one module can do")
    return p


def options_of(a: argparse.Namespace) -> Options:
    metadata = tuple(m for letter in a.metadata for m in METADATA[letter])
    o = Options(paths=a.paths, recursive=not a.no_recursion, delta_path=a.delta or a.delta_deleted, include_deleted=bool(a.delta_deleted), skip_size=a.skip_size, metadata=metadata, inline_entry=a.config_entry)
    if a.config_name:
        o.config_name = a.config_name
    o.skip_dirs = tuple(x for x in a.skip_dirs.split(";") if x)
    o.skip_files = tuple(x for x in a.skip_files.split(";") if x)
    o.include_dirs = tuple(x for x in (a.include_dirs or "").split(";") if x)
    if a.dupes is not None:
        o.dupes = int(a.dupes) if a.dupes.lstrip("-").isdigit() else a.dupes
    if a.all:
        o.inline_entry = SCAN_ALL[a.all] + " OPT:FORCE_ALL_TYPES"
        if a.all != "m" and not o.skip_size:
            o.skip_size = 5_000_000
        if a.all == "m":
            o.metadata += ("date",)
    if a.measure_filter == "metadata":
        o.inline_entry = o.inline_entry or SCAN_ALL["m"]
    elif a.measure_filter:
        o.measure_filter = a.measure_filter
    return o


def main(argv: list[str] | None = None) -> int:
    try:
        return _run(parser().parse_args(argv))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"textloom: no such folder: {e.getMessageParameters().get('path', '')}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    if a.modules is not None:
        if a.modules and a.modules not in MODULES:
            print(f"textloom: no module {a.modules}", file=sys.stderr)
            return 2
        for m in [a.modules] if a.modules else sorted(MODULES):
            print(m, "-", ", ".join(VERBS[m]))
        print("options:", ", ".join(f"{n}=..." if takes else n for n, (takes, _) in OPTIONS.items()))
        return 0
    began = time.monotonic()

    def step(name: str) -> None:
        if a.profile:
            print(f"{time.monotonic() - began:.1f} s: {name}", file=sys.stderr)

    builder = SparkSession.builder.appName("textloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", str(a.progress).lower())
    if a.workers:
        builder = builder.master(f"local[{max(1, min(255, a.workers))}]")
    spark = builder.getOrCreate()
    # Files that go or break while a job runs are left out, unless the first error is to stop it.
    for kind in ("Missing", "Corrupt"):
        spark.conf.set(f"spark.sql.files.ignore{kind}Files", str(not a.break_on_error).lower())
    o = options_of(a)
    if a.config_info:
        files = scan(spark, o.paths, o.recursive, o.skip_dirs, o.skip_files)
        configs = configs_of(spark, o)
        for r in preview(files, configs).orderBy("dir", "ext", "entry_ord").toLocalIterator():
            print(r.dir, r.ext or "(none)", sorted(configs[r.config_dir], key=str)[r.entry_ord], sep="\t")
        return 0
    step("session")
    rows = run(spark, o)
    step("plan")
    if a.debug:
        rows.explain("formatted")
    if a.aggregate:
        key, names, *limit = [*a.aggregate, "all"][: max(2, len(a.aggregate))]
        plain = lambda c: next((x for x in rows.columns if c in (x, sinks.dotted(x))), c)
        chosen = "all" if names == "all" else [plain(c) for c in names.split(",")]
        threshold = (plain(limit[0]), float(limit[1])) if len(limit) == 2 else None
        grouped = aggregate.by_key(rows, plain(key), chosen, threshold=threshold)
        sinks.write(grouped, f"{a.output}-{key.replace('.', '')}", a.format) if a.output and a.output != "stdout" else sinks.show(grouped)
    if a.output and a.output != "stdout" and not a.totals:
        if "out_file" in rows.columns:  # entries with OUT: name files beside the output
            folder, _, name = a.output.rpartition("/")
            sinks.write_by_file(rows, folder or ".", default=name, kind=a.format)
        else:
            sinks.write(rows, a.output, a.format)
    elif not a.totals and not a.aggregate:
        sinks.show(rows, sinks.SEPARATORS.get(a.format, ","))
    step("results")
    if not a.quiet:
        files = scan(spark, o.paths, o.recursive, o.skip_dirs, (*o.skip_files, o.config_name), o.include_dirs, o.file_filters)
        for r in aggregate.counters(files, rows).collect():
            print(f"{r.counter}: {r.value:,}")
        found = summary(rows)
        for r in found.filter(F.col("file_type").isNull()).orderBy("measure").collect():
            print(f"{r.measure}: {r.total:,.0f}")
        if a.verbose:
            for r in aggregate.top(found, a.verbose).orderBy("measure", "place").collect():
                print(f"  {r.measure} {r.file_type}: {r.total:,.0f}")
    step("totals")
    return 0
