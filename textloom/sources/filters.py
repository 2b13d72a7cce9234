"""Predicates on paths, names, sizes and content, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import glob
from textloom.functions.text import odd_share_exceeds

#: Extensions of files that hold no code.
COMPRESSED = ("zip", "tgz", "tar", "gz", "rar", "7z")
NON_CODE = (
    "exe", "com", "bin", "dll", "dylib", "lib", "mo", "so", "ko", "a", "o", "obj",
    "jar", "war", "ear", "pyc", "class", "pdb", "pch", "tlb", "ocx",
    "cab", "msi", "7z", "iso", "bak", "rpm", "lha", "lhz",
    "csv", "tsv", "old", "rc", "resx",
    "doc", "docx", "dot", "dotx", "xls", "xlsx", "xlsm", "ppt", "pptx",
    "pdf", "rtf", "vsd", "vsx", "mdb",
    "svn", "svn-base", "scc", "cvs",
    "png", "jpg", "jp2", "gif", "bmp", "tif", "tiff", "tga", "raw", "ico",
    "avi", "mpg", "mpeg", "m1v", "m2v", "m4v", "wmv", "dat", "flv", "avchd", "mov",
    "wav", "m4a", "wma", "mp2", "mp3", "aac", "swa",
    "vhd", "vmdk", "vmem", "vmss", "vmx", "vm",
    "er1", "ai", "eps", "dxf", "svg", "wmf", "ps", "chm", "hlp",
)
SKIP_DIRS, SKIP_FILES = (".?*", "cvs"), (".*",)
#: First characters of binary files.
MAGIC = ("\x7fELF", "PK\x03\x04", "\x1f\x8b\x08")


def _or(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def matches_one(name: Column, ext: Column, pattern: str) -> Column:
    """One filter: a file name pattern, NO_EXT, EX:a:b (none of them), RE:regex (at the start)."""
    if pattern == "":
        return F.lit(True)
    if pattern == "NO_EXT":
        return (ext == "") & ~name.startswith(".")
    if pattern.startswith("EX:"):
        return ~_or([matches_one(name, ext, x) for x in pattern[3:].split(":") if x])
    if pattern.startswith("RE:"):
        return name.rlike("^(?:" + pattern[3:] + ")")
    if pattern.startswith("*.") and not set(pattern[2:]) & set("*?[."):
        return name.endswith(pattern[1:])
    return name.rlike(glob(pattern))


def matches(name: Column, ext: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Any filter holds; no filter at all holds always."""
    return _or([matches_one(name, ext, p) for p in patterns]) if patterns else F.lit(True)


def first_match(name: Column, ext: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """The first filter that holds, or null."""
    return F.coalesce(*(F.when(matches_one(name, ext, p), p) for p in patterns)) if patterns else F.lit("")


def extension(name: Column) -> Column:
    """What follows the last dot, unless only dots come before it; '' without."""
    return F.regexp_extract(name, r"^\.*[^.].*\.([^.]*)$", 1)


def in_skipped_dir(dirs: Column, patterns: tuple[str, ...] = SKIP_DIRS) -> Column:
    """A folder on the way matches; such a branch isn't entered."""
    rx = "|".join(f"(?:{glob(p)})" for p in patterns)
    return F.exists(dirs, lambda d: d.rlike(rx)) if patterns else F.lit(False)


def in_included_dir(folder: Column, patterns: tuple[str, ...]) -> Column:
    return _or([folder.rlike(glob(p)) for p in patterns]) if patterns else F.lit(True)


def is_non_code(name: Column) -> Column:
    """By extension, once numeric endings such as .1.2 are off."""
    return F.lower(extension(F.regexp_replace(name, r"(\.[0-9]+)+$", ""))).isin(*COMPRESSED, *NON_CODE)


def has_magic(text: Column) -> Column:
    return _or([text.startswith(m) for m in MAGIC])


def is_text(text: Column, window: int = 1 << 18) -> Column:
    """Printable ASCII and white space prevail from the fourth character on."""
    return ~odd_share_exceeds(F.substring(text, 1, window), r"[^\x20-\x7e\t\n\r\f\x0b]", 4, 32)
