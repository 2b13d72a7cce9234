"""Writing results: delimited text, XML, standard output; column order and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATORS = {"csv": ",", "tab": "\t", "paragraph": "\xb6"}
EXTENSIONS = {"csv": ".csv", "tab": ".txt", "paragraph": ".txt", "xml": ".xml"}
#: Columns that come first, in this order.
COLUMN_ORDER = (
    "dir1", "dir2", "dir3", "dir4", "dir5", "fileAbsPath", "fileName", "fileType", "tag1", "tag2", "tag3",
    "file.nbnc", "file.comment", "file.machine", "file.blank", "file.dead", "file.content", "file.skipped", "dupe.nbnc", "file.nbncRank", "file.commentRank",
    "routine.line", "routine.nbnc", "routine.complexityRank", "routine.nestingRank", "routine.nbncRank", "routine.complexity", "routine.nesting",
    "search.line", "search.linenum",
)
_PREFIXES = ("file", "nbnc", "search", "routine", "dupe", "dir", "measure", "aggregate")
_NAMES = {"path": "file.fullName", "dir": "fileAbsPath", "name": "fileName", "ext": "fileType", "length": "file.bytes", "file_code_content": "file.code+content", "depend_using": "Depend.Using", "depend_count": "Depend.Count", "depend_lines": "Depend.FileLines", "dupe_crc": "DupeLine.CRC", "dupe_count": "DupeLine.Count", "dupe_content": "DupeLine.Content", "dupe_lines": "DupeLine.FileLines", "dir_files": "dir.files", "search_regex": "search.regex-full"}


def dotted(name: str) -> str:
    """The output name of a column."""
    if name in _NAMES:
        return _NAMES[name]
    prefix, _, rest = name.partition("_")
    return f"{prefix}.{rest.replace('c_', 'c-')}" if rest and prefix in _PREFIXES else name


def arranged(df: DataFrame) -> DataFrame:
    """Output names; preferred columns first, the others by name; every value a string, null as ''."""
    names = {c: dotted(c) for c in df.columns}
    place = {n: i for i, n in enumerate(COLUMN_ORDER)}
    order = sorted(df.columns, key=lambda c: (place.get(names[c], len(place)), names[c]))

    def text(c: str):
        nested = isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))
        return F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit("")).alias(names[c])

    return df.select(*(text(c) for c in order))


def write(df: DataFrame, path: str, kind: str = "csv", mode: str = "errorifexists") -> None:
    """A folder of part files in the named format, written by all tasks."""
    out = arranged(df)
    if kind == "xml":
        safe = out.select(*(F.col(f"`{c}`").alias("_" + c.replace(".", "_").replace("+", "_").replace("-", "_")) for c in out.columns))
        safe.write.mode(mode).format("xml").option("rootTag", "files").option("rowTag", "file").save(path)
    elif kind in SEPARATORS:
        out.write.mode(mode).option("sep", SEPARATORS[kind]).option("header", True).option("quoteAll", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    else:
        raise ValueError(f"no format {kind}; there are {', '.join([*SEPARATORS, 'xml'])}")


def write_by_file(df: DataFrame, folder: str, column: str = "out_file", default: str = "results", kind: str = "csv") -> list[str]:
    """One output a value of ``column``, the few names that a config's OUT: tags give."""
    names = sorted(r[0] for r in df.select(F.coalesce(column, F.lit(default))).distinct().collect())
    paths = []
    for n in names:
        paths.append(f"{folder}/{n}" + ("" if "." in n else EXTENSIONS[kind]))
        write(df.filter(F.coalesce(column, F.lit(default)) == n).drop(column), paths[-1], kind)
    return paths


def show(df: DataFrame, sep: str = ",") -> None:
    """All rows on standard output, fetched partition by partition."""
    out = arranged(df)
    quote = lambda x: '"' + x.replace('"', '""') + '"'
    print(sep.join(map(quote, out.columns)))
    for r in out.toLocalIterator():
        print(sep.join(map(quote, r)))
