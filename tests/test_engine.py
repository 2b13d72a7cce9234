"""The engine on micro-fixtures with results derived by hand, and against plain loops."""

import json
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import patterns as P
from textloom.functions import text as X
from textloom.job import Options, run
from textloom.operators import aggregate, analyze, dupes, measure, routines, search
from textloom.operators.lines import looks_binary
from textloom.operators.routing import nearest, preview, routed
from textloom.plans.config import ConfigError, entry, matches_measure, param, parse
from textloom.plans.defaults import DEFAULT_CONFIG
from textloom.plans.profile import MODULES, OPTIONS, profile
from textloom.sources import filters, sinks
from textloom.sources.delta import delta
from textloom.sources.files import decoded, scan, split_argument, with_path_parts

C_BASIC = '/* header\n   text\n\n*/\n#include <x.h>\n\nint main() {\n  // note\n  // a = b;\n  return 0; // done\n}\n-----\nRemember me\nchar* s = "/* no */";\nf(); /* same */ g();\n"x" /* it\'s open */ don\'t\nafter\n'
MIXED = '# comment\nx = 1  # inline\ndef f():\n    return "a"\n\n-- sql style\n--[[ lua\nstill\n]] end\n_\n'
REGION = "x = 1\n#region generated code\ny = 2\n#endregion\nz = 3\n"
WEB = "<html>\n<script>\nvar a = 1; // hi\n</script>\n<% x %>\n</html>\n"
ROUTINES = "import os\ndef a(x):\n    if x:\n        return 1\n    return 2\ndef b():\n    pass\n    pass"


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")


def letters(spark, text, p):
    p = profile(p) if isinstance(p, str) else p
    rows = measure.classified(files(spark, text), p).withColumn("c", measure.line_class(p)).orderBy("line_no", "piece_no").collect()
    return "".join(r.c for r in rows)


def full(spark, text, p="Code", **more):
    return {k: v for k, v in measure.full(files(spark, text), p, **more).first().asDict().items() if v is not None}


@pytest.mark.parametrize(("text", "module", "want"), [
    (C_BASIC, "Code", "CCTBNTNCDIBBCNDCC"),
    (MIXED, "Code", "CNNNTCDCDN"),
    (REGION, "Code", "NMMNN"),
    (WEB, "Web", "+NI+N+"),
    ("", "Code", ""),
])
def test_line_classes(spark, text, module, want):
    assert letters(spark, text, module) == want


def test_c_basic_counts(spark):
    got = full(spark, C_BASIC)
    want = {"file_total": 17, "file_blankTrue": 2, "file_blankFaux": 3, "file_nbnc": 4, "file_comment": 7, "file_dead": 2, "nbnc_inlineComments": 1, "nbnc_imports": 1, "nbnc_semicolons": 2, "file_nbncRank": "1 to 200", "file_commentRank": "> 25%", "nbnc_importRank": "0 to 4"}
    assert {k: got[k] for k in want} == want
    assert got["file_crc"] == zlib.adler32(C_BASIC.encode(), 0)
    assert measure.basic(files(spark, C_BASIC, "", None)).orderBy("path").collect() == [("f0", 17, 4, 8), ("f1", 0, 0, 0), ("f2", 0, 0, 0)]


def test_blocks(spark):
    got = full(spark, REGION)
    assert (got["file_total"], got["file_nbnc"], got["file_machine"], got["nbnc_preprocessor"]) == (5, 3, 2, 1)
    got = full(spark, WEB, "Web")
    assert (got["file_nbnc"], got["file_content"], got["file_code_content"], got["nbnc_inlineComments"], got["file_comment"]) == (3, 3, 6, 1, 1)
    assert letters(spark, "a = 1\n// do not edit\nb = 2\n", "Code") == "NMM"
    assert letters(spark, "a = 1\n// do not edit\nb = 2\n", profile("Code", (("MACHINE_NONE", None),))) == "NCN"
    assert letters(spark, "a\nSTART x END\nb\n", profile("Code", (("MACHINE_DETECTORS", "[['START','END']]"),))) == "NMN"
    assert letters(spark, "a\nb\n", profile("Code", (("MACHINE_ALL", None),))) == "MM"


def test_options(spark):
    assert letters(spark, '"""\ndoc\n"""\nx = 1\n# y\n', profile("Code", (("PYTHON_TRIPLE_COMMENTS", None),))) == "BCBNC"
    assert letters(spark, "<a></a>\n<b>x</b>\n", profile("NBNC", (("BLANK_LINE_XML", None),))) == "BN"
    assert letters(spark, "a;b;c\n", profile("NBNC", (("ADD_LINE_SEP", ";"),))) == "NNN"
    assert letters(spark, "keep\nskip me\n", profile("NBNC", (("SKIP_LINES", "^skip"),))) == "N-"
    assert letters(spark, "f(); /* c */\n/* c */ f();\n/* c */\n", profile("NBNC", (("COMMENT_CLOSE_CODE", None),))) == "NNC"
    assert letters(spark, "      * note\n       MOVE\n", "customCobol") == "CN"
    assert letters(spark, "{ note }\n{$I x}\nbegin\nx := 1;\n", "customDelphi")[:3] == "CNB"
    assert len(OPTIONS) == 63
    for module in MODULES:
        assert profile(module).module == module
    with pytest.raises(ValueError, match="no option"):
        profile("Code", (("NOPE", None),))


def plain_classes(text):
    """NBNC classification as a loop."""
    out, inside = "", False
    rx = lambda p: re.compile(p, re.I)
    single, opened, closed, blank = rx(P.COMMENT), rx(P.COMMENT_OPEN), rx(P.COMMENT_CLOSE), rx(P.BLANK)
    for line in text.split("\n"):
        line = line[:255]
        if not line.strip():
            out += "T"
            continue
        s = re.sub(P.STRINGS, "", line).strip()
        if inside:
            on = True
            inside = not closed.search(s)
        elif single.match(s):
            on = True
        elif m := opened.search(s):
            on, inside = True, not closed.search(s[m.end() :])
        else:
            on = False
        out += "B" if blank.match(line) else "C" if on else "N"
    return out


def test_comment_states_match_a_loop(spark):
    rng = random.Random(1)
    parts = ["/*", "*/", "//", "#", "--[[", "]]", "x = 1", '"a"', "'", " ", "rem", "{-", "-}", ";", "<!--", "-->", "text", "=begin", "=cut"]
    texts = ["\n".join("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(60)) + "\nz" for _ in range(25)]
    rows = measure.classified(files(spark, *texts), "NBNC").withColumn("c", measure.line_class(profile("NBNC"))).collect()
    for i, t in enumerate(texts):
        assert "".join(r.c for r in sorted((r for r in rows if r.path == f"f{i}"), key=lambda r: r.line_no)) == plain_classes(t)


def test_fold_equals_windows(spark):
    """Without detectors, the fold and the window form agree."""
    none = profile("Code", (("MACHINE_NONE", None),))
    df = files(spark, C_BASIC, MIXED, WEB)
    key = lambda d: sorted((r.path, r.line_no, r.in_comment) for r in d.collect() if r.line.strip())
    assert key(measure.classified(df, none, crc=True)) == key(measure.classified(df, none, crc=False))


def test_routines(spark):
    got = routines.routines(files(spark, ROUTINES), "Code", (param(r"\s*def\s+(\w+)"),)).orderBy("seq").collect()
    assert [(r.routine_name, r.routine_lineNum, r.routine_nbnc, r.routine_c_decisions, r.routine_c_escapes, r.routine_complexity, r.routine_maxNesting) for r in got] == [("a", 2, 6, 1, 2, 3, 1), ("b", 6, 2, 0, 0, 1, 0)]


def test_search(spark):
    df = files(spark, 'x = find(1) // find\n// find me\ny = "find"\nfind(2); skip\n')
    by = lambda d: [r.search_linenum for r in d.orderBy("search_linenum").collect()]
    find = (param("POSITIVE__ (find)"), param("NEGATIVE__ skip"))
    assert by(search.code_search(df, find)) == [1]
    assert by(search.code_search(df, find, profile("Code", (("SEARCH_COMMENTS", None),)))) == [1, 2]
    assert by(search.code_search(df, find, profile("Code", (("ONLY_COMMENTS", None), ("SEARCH_COMMENTS", None))))) == [2]
    assert by(search.code_search(df, find, profile("Code", (("SEARCH_STRINGS", None),)))) == [1, 3]
    raw = search.raw_search(df, find).collect()
    assert len(raw) == 3 and {(r.search_total, r.file_total, r.search_match) for r in raw} == {(3, 4, "find")}
    assert search.multi_line_search(df, (param("me(y)"),)).first().search_match == "y"
    assert search.raw_search(df, (param("FIND"),), profile("Search", (("SEARCH_CASE_SENSITIVE", None),))).count() == 0


def test_analyze(spark):
    df = files(spark, "import b\nimport  a\nimport b\nx = 1\nx  = 1\n", "x = 1\n")
    assert [tuple(r) for r in analyze.depends(df).orderBy(F.lower("depend_using")).collect()] == [("f0", "import a", 1, [2]), ("f0", "import b", 2, [1, 3])]
    assert {(r.path, r.dupe_content, r.dupe_count) for r in analyze.dupe_lines(df).collect()} >= {("f0", "x = 1", 2), ("f1", "x = 1", 1)}
    assert [(r.dupe_content, r.dupe_count, r.dupe_files) for r in analyze.shared_lines(df, 2).collect()] == [("x = 1", 3, 2)]


def test_dupes(spark):
    df = spark.createDataFrame([("/a/x.c", "x.c", 100), ("/b/x.c", "x.c", 104), ("/c/x.c", "x.c", 108), ("/d/y.c", "y.c", 100), ("/e/x.c", "x.c", 100)], "path string, name string, length long")
    first = lambda d: {r.path: r.dupe_firstPath for r in d.collect()}
    assert first(dupes.by_size(df, 0)) == {"/a/x.c": None, "/b/x.c": None, "/c/x.c": None, "/d/y.c": None, "/e/x.c": "/a/x.c"}
    assert first(dupes.by_size(df, 4)) == {"/a/x.c": None, "/b/x.c": "/a/x.c", "/c/x.c": None, "/d/y.c": None, "/e/x.c": "/a/x.c"}
    assert dupes.statistics(df, ["name", "length"]).first() == (1, 2, 200)


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1, 2, [1], {"f": [1]}, "p"), ("b", 1, 3, [2], {"f": [2], "g": [3]}, "q")], "path string, k int, n long, l array<int>, m map<string,array<int>>, s string")
    r = aggregate.by_key(df, "k").first()
    assert (r.aggregate_count, r.n, r.l, r.m, r.s) == (2, 5, [1, 2], {"f": [1, 2], "g": [3]}, "q")
    assert aggregate.by_key(df, "k", ["n"], threshold=("n", 5)).count() == 0
    assert aggregate.by_key(df, "k", ["n"], threshold=("n", 4.5)).count() == 1
    with pytest.raises(ValueError, match="no item"):
        aggregate.by_key(df, "zz")


def test_totals(spark):
    df = spark.createDataFrame([("c", 3), ("C", 4), ("", 5)], "ext string, file_nbnc long")
    got = {(r.measure, r.file_type): r.total for r in aggregate.totals(df).collect()}
    assert got == {("file_nbnc", "c"): 7, ("file_nbnc", ".(NoExt)"): 5, ("file_nbnc", None): 12, ("ext", "c"): 2, ("ext", ".(NoExt)"): 1, ("ext", None): 3}
    assert [r.file_type for r in aggregate.top(aggregate.totals(df), 1).orderBy("measure").collect()] == ["c", "c"]


@pytest.mark.parametrize(("table", "value", "want"), [
    (measure.SIZE_RANKS, 0, "1 to 200"), (measure.SIZE_RANKS, 200, "1 to 200"), (measure.SIZE_RANKS, 201, "201 to 600"), (measure.SIZE_RANKS, 9999, "1800+"),
    (measure.NESTING_RANKS, 5, "3 to 4"), (measure.COMMENT_RANKS, 0.0, "0%"), (measure.COMMENT_RANKS, 4.0, "> 25%"), (measure.COMMENT_RANKS, 4.1, "> 10%"),
])
def test_ranks(spark, table, value, want):
    assert spark.range(1).select(X.rank(F.lit(value), table)).first()[0] == want


@pytest.mark.parametrize(("pattern", "name", "want"), [
    ("NO_EXT", "Makefile", True), ("NO_EXT", ".bashrc", False), ("NO_EXT", "a.c", False), ("EX:*.c:*.h", "x.py", True), ("EX:*.c:*.h", "x.c", False),
    ("RE:foo", "foobar.c", True), ("RE:foo", "xfoo.c", False), ("*.c", "a.c", True), ("*.c", "a.cc", False), ("*.C", "a.c", False), ("a?[bc]*", "axc.z", True), ("[!a]*", "abc", False), ("*", "x", True), ("", "x", True),
])
def test_filters(spark, pattern, name, want):
    df = spark.createDataFrame([(name,)], "name string").withColumn("ext", filters.extension(F.col("name")))
    assert df.select(filters.matches_one(F.col("name"), F.col("ext"), pattern)).first()[0] is want


def test_text_and_binary(spark):
    def plain(t, start, least, odd):
        bad = 0
        for i, ch in enumerate(t, 1):
            if i < start:
                continue
            bad += bool(re.match(odd, ch))
            if (i >= least or i == len(t)) and bad / i > 0.2:
                return True
        return False

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é" if rng.random() < rng.random() else "abc") for _ in range(rng.randint(0, 90))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    odd = r"[^\x20-\x7e\t\n\r\f\x0b]"
    assert [not r[0] for r in df.select(filters.is_text(F.col("t"))).collect()] == [plain(t, 4, 32, odd) for t in texts]
    assert [r[0] for r in df.select(looks_binary(F.col("t"))).collect()] == [plain(t.lstrip(" ")[:80], 1, 15, r"""[^A-Za-z0-9\s~$\\/\-_<>=():*|;,"]""") for t in texts]
    names = spark.createDataFrame([("lib.so.1.2",), ("a.c",), ("x.TAR",), ("b.tgz",)], "name string")
    assert [r[0] for r in names.select(filters.is_non_code(F.col("name"))).collect()] == [True, False, True, True]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for t in ("", "a", "é\n" * 50, "x" * 3000):
        assert one(X.adler32(F.lit(t).cast("binary"))) == zlib.adler32(t.encode(), 0)
    for t, want in (("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\n\nb", ["a", "", "b"]), ("\n", [""]), ("a\r\nb\rc", ["a", "b", "c"])):
        assert one(X.lines_of(F.lit(t))) == want
    assert one(X.expanded_indent(F.lit(" \tx"))) == 4 and one(X.expanded_indent(F.lit("\t  x"))) == 6 and one(X.expanded_indent(F.lit("x"))) == 0
    assert one(X.fit(F.lit("abcdefghij"), 7)) == "ab...ij" and one(X.fit(F.lit("abc"), 7)) == "abc"
    assert one(X.printable(F.lit("a\tb\x01c"))) == "a  bc"
    assert one(decoded(F.lit(bytearray(b"ok\n\xe9t\xc3\xa9\n")).cast("binary"))) in ("ok\n\xe9t\xc3\xa9\n", "ok\nétÃ©\n")


def test_patterns():
    assert P.flat(r"^ \s* [# ] x  # note") == r"^\s*[# ]x"
    assert P.java(r"[^\b]{-") == r"(?diU)[^\x08]\{-"
    assert P.java("a{2,3}[[x]") == r"(?diU)a{2,3}[\[x]"


def test_config():
    text = "\n".join([
        "# comment", "CONSTANT:EXT:*.c", "CONSTANT_NOBLANK:WORDS:(a | b)", "IGNORE_START", "measure Nope", "IGNORE_STOP",
        "measure Code * EXT tag1 \\", "  OPT:MAX_LINE_LENGTH:80  # trailing", "search Code * *.h OUT:found", "POSITIVE__ WORDS", "NEGATIVE__ c d", "POSITIVE__ WORDS", "search_end", "INCLUDE:other: OPT:MACHINE_NONE",
    ])
    got = parse(text, lambda path: "measure NBNC file.* *.y extra\nmeasure Code * *.c\n", (("IGNORE_SIZE", "9"),))
    assert [(e.verb, e.module, e.file_filters) for e in got] == [("measure", "Code", ("*.c",)), ("search", "Code", ("*.h",)), ("measure", "NBNC", ("*.y",))]
    assert got[0].options == (("IGNORE_SIZE", "9"), ("MAX_LINE_LENGTH", "80")) and got[0].profile.max_line == 80
    assert [(p.positive, p.regex) for p in got[1].params] == [(True, "(a|b)"), (False, "cd")] and got[1].out_file == "found"
    assert ("MACHINE_NONE", None) in got[2].options
    assert len(parse(DEFAULT_CONFIG)) == 99
    for bad in ("measure Code", "measure Nope * *", "routines NBNC * *", "search Code * *.c\nx"):
        with pytest.raises(ConfigError):
            parse(bad)
    with pytest.raises(ConfigError, match="double"):
        parse("measure Code * *.c\nmeasure Code file.* *.c")
    assert matches_measure("file.nbnc", ("file.*",)) and not matches_measure("nbnc.crc", ("file.*",)) and matches_measure("fileName", ("x.y",))


def test_routing(spark):
    df = with_path_parts(spark.createDataFrame([("/a/b/x.c",), ("/z/y.c",), ("/a/q.py",)], "path string"))
    dirs = spark.createDataFrame([("",), ("/a",)], "config_dir string")
    assert {r.path: r.config_dir for r in nearest(df, dirs).collect()} == {"/a/b/x.c": "/a", "/z/y.c": "", "/a/q.py": "/a"}
    configs = {"": [entry("measure Code * *.c")], "/a": []}
    assert [r.path for r in routed(df, configs).collect()] == ["/z/y.c"]
    both = {"": [entry("measure Code * *.c"), entry("measure NBNC file.* *.c;*.py")]}
    assert routed(df, both).groupBy("path").count().orderBy("path").collect() == [("/a/b/x.c", 2), ("/a/q.py", 1), ("/z/y.c", 2)]
    assert preview(df, both).count() == 5
    assert split_argument("/x/*.c;*.h") == ("/x", ("*.c", "*.h")) and split_argument("/x/y/") == ("/x/y", ())


def test_delta(spark):
    new = spark.createDataFrame([("/n/a", "a", "1\n2\n3\n"), ("/n/b", "b", "same\n"), ("/n/c", "c", "fresh\n")], "path string, rel string, content string")
    old = spark.createDataFrame([("/o/a", "a", "1\n3\n4\n"), ("/o/b", "b", "same\n")], "path string, rel string, content string")
    got = {r.rel: (r.content, r.dupe_firstPath) for r in delta(new, old).collect()}
    assert got == {"a": ("2\n", None), "b": ("", "/o/b"), "c": ("fresh\n", None)}
    assert {r.rel: r.content for r in delta(new, old, include_deleted=True).collect()}["a"] == "2\n4\n"


def test_job_over_a_tree(spark, tmp_path):
    for path, text in {"x/a.c": "/* hi */\nint main() {\n return 0; // x\n}\n", "y/a.c": "/* hi */\nint main() {\n return 0; // x\n}\n", "x/.git/z.c": "x\n", "y/b.py": "import os\nx = 1\n", "y/c.zip": "PK\x03\x04zz"}.items():
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text(text)
    root = str(tmp_path / "in")
    assert sorted(r.name for r in scan(spark, root).collect()) == ["a.c", "a.c", "b.py", "c.zip"]
    config = "measure Code * *.c c code\nmeasure Code * *.py python code OPT:PYTHON_TRIPLE_COMMENTS\nsearch Search * *.py OUT:hits\n(import)\nsearch_end"
    rows = run(spark, Options(paths=[root], config=config, dupes="crc")).collect()
    by = {(r.path[len(root) :], r.measure_Module): r for r in rows}
    copy = by["/y/a.c", None]  # a duplicate keeps names and tags alone
    assert by["/x/a.c", "Code"].file_nbnc == 2 and copy.dupe_firstPath == f"{root}/x/a.c" and copy.dupe_nbnc == 2 and copy.tag1 == "c" and copy.file_nbnc is None
    assert by["/y/b.py", "Search"].search_match == "import" and by["/y/b.py", "Search"].out_file == "hits" and by["/y/b.py", "Code"].tag1 == "python"
    df = run(spark, Options(paths=[root], config=config))
    names = sinks.write_by_file(df, str(tmp_path / "out"))
    assert [os.path.basename(n) for n in names] == ["hits.csv", "results.csv"]
    got = spark.read.option("header", True).csv(names[1])
    assert got.columns[0] == "fileAbsPath" and "file.nbnc" in got.columns and got.count() == 3
    sinks.write(df, str(tmp_path / "xml"), "xml")
    assert spark.read.format("xml").option("rowTag", "file").load(str(tmp_path / "xml")).count() == 4
    assert json.dumps(sinks.dotted("file_code_content")) == '"file.code+content"'


def test_lines_of_one_checksum_stay_apart(spark):
    """Both lines have the CRC-32 of the other."""
    a, b = "val_7666 = 53662", "val_174098 = 1218686"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    got = {r.dupe_content: r.dupe_count for r in analyze.dupe_lines(files(spark, f"{a}\n{b}\n{a}\n")).collect()}
    assert got == {a: 2, b: 1}
    got = {r.dupe_content: (r.dupe_count, r.dupe_files) for r in analyze.shared_lines(files(spark, f"{a}\n{b}\n", f"{a}\n")).collect()}
    assert got == {a: (2, 2)}


@pytest.mark.parametrize("indent", [2, 4, 8])
def test_tabs_count_by_the_indent_option(spark, indent):
    text = "def a(x):\n\ty = 1\n\t\tif x:\n\t\t\treturn 1\n\tz = 2\n"
    options = (("ROUTINE_NESTING_INDENT", str(indent)),)
    got = [(r.routine_name, r.routine_maxNesting) for r in routines.routines(files(spark, text), profile("Code", options), (param(r"def\s+(\w+)"),)).collect()]
    assert got == [("a", 2)]


def test_merged_starts_keep_their_text(spark):
    text = "void a()\nvoid b() {\n  x = 1;\n  y = 2;\n  z = 3;\n}\n"
    got = [r.routine_line for r in routines.routines(files(spark, text), "Code", (param(r"void\s+(\w+)"),)).collect()]
    assert got == ["void a()void b() {"]


def test_includes_of_a_job(spark, tmp_path):
    (tmp_path / "sub" / "more").mkdir(parents=True)
    (tmp_path / "sub" / "a.c").write_text("int x;\n")
    (tmp_path / "sub" / "b.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "sub" / "textloom.code").write_text("measure Code * *.c\nINCLUDE:more/other.code: shared\n")
    (tmp_path / "sub" / "more" / "other.code").write_text("INCLUDE:last.code:\n")
    (tmp_path / "sub" / "more" / "last.code").write_text("measure NBNC * *.py\n")
    rows = {r.name: r for r in run(spark, Options(paths=[str(tmp_path / "sub")])).collect()}
    assert rows["a.c"].file_nbnc == 1 and rows["b.py"].file_nbnc == 2 and rows["b.py"].tag1 == "shared"
    with pytest.raises(ConfigError, match="nowhere.code"):
        run(spark, Options(paths=[str(tmp_path / "sub")], config="INCLUDE:nowhere.code:\n"))


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(f"/r/{d}/f{i}.c", f"f{i}.c", 7, c) for i, (d, c) in enumerate([("a", 1), ("b", 1), ("c/d", 2)])], "path string, name string, file_nbnc int, nbnc_crc int")
    rows = {r.path: r for r in dupes.suppressed(dupes.by_checksum(df)).collect()}
    second = rows["/r/b/f1.c"]
    assert (second.dupe_fileName, second.dupe_dir1, second.dupe_dir2, second.dupe_dir3, second.dupe_nbnc, second.file_nbnc) == ("/r/b/f1.c", "r", "a", "", 7, None)
    assert rows["/r/a/f0.c"].dupe_fileName is None and rows["/r/a/f0.c"].file_nbnc == 7


def test_near_sizes_match_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"/d/{i:04}/x", "x", rng.randrange(0, 3000)) for i in range(400)] + [(f"/e/{i:04}/y", "y", 10 * i) for i in range(50)]
    got = {r.path: r.dupe_firstPath for r in dupes.by_size(spark.createDataFrame(rows, "path string, name string, length long"), 4).collect()}
    held, want = {}, {}
    for path, name, size in sorted(rows):
        near = [p for s, p in held.setdefault(name, []) if abs(s - size) <= 4]
        want[path] = near[0] if near else None
        if not near:
            held[name].append((size, path))
    assert got == want


def test_depends_are_in_order(spark):
    text = "import b\nimport A\nimport c\nimport a\n"
    got = [r.depend_using for r in analyze.depends(files(spark, text, text)).collect()]
    assert got == ["import A", "import a", "import b", "import c"] * 2


def test_command_line_writes_all(spark, tmp_path, capsys):
    from textloom import cli

    src = tmp_path / "src"
    src.mkdir()
    for i in range(3):
        (src / f"f{i}.c").write_text("int x;\n" * 500)
    (src / "g.py").write_text("x = 1\n")
    (src / "textloom.code").write_text("measure NBNC * *.c\nmeasure NBNC * *.py OUT:pythons\n")
    args = [str(src), "-o", str(tmp_path / "out" / "main.csv"), "-c", "textloom.code"]
    (tmp_path / "out").mkdir()
    assert cli.main(args) == 0
    assert sorted(os.listdir(tmp_path / "out")) == ["main.csv", "pythons.csv"]
    shown = capsys.readouterr().out
    assert "files: 4" in shown and "rows: 4" in shown and "folders: 1" in shown
    assert cli.main([str(tmp_path / "nowhere")]) == 2
    assert "no such folder" in capsys.readouterr().err


def test_modules_of_ones_own(spark, tmp_path):
    from textloom.operators.custom import surveyed
    from textloom.plans import profile as plans

    hooks = plans.Hooks(
        preprocess=lambda line: F.regexp_replace(line, "^>>> ?", ""),
        counts=(("file_todos", lambda df: df["line"].contains("TODO") & (df["_c"] == "C")), ("file_blockChanges", lambda df: df["changed"])),
        file=lambda df: df.withColumn("file_todoShare", F.col("file_todos") / F.col("file_total")),
        param=lambda text: param(text.replace("WORD", r"\w+")),
    )
    plans.register("prompts", MODULES["Code"], ("measure", "search"), hooks)
    try:
        got = full(spark, ">>> x = 1\n>>> // TODO: y\nTODO = 2\n#region generated\nz\n#endregion\n", "prompts")
        assert (got["file_nbnc"], got["file_todos"], got["file_blockChanges"], got["file_todoShare"]) == (3, 1, 2, 1 / 6)
        (tmp_path / "a.p").write_text(">>> x = 1\n")
        rows = run(spark, Options(paths=[str(tmp_path)], config="measure prompts * *.p")).collect()
        assert rows[0].file_nbnc == 1 and rows[0].file_todos == 0
        assert parse("search prompts * *.p\nWORD = 1\nsearch_end\n")[0].params[0].regex == r"\w+=1"
        with pytest.raises(ValueError, match="there is a module"):
            plans.register("prompts", MODULES["Code"])
    finally:
        del MODULES["prompts"], plans.VERBS["prompts"]
    items = T.StructType().add("word", T.StringType()).add("line", T.IntegerType())
    df = surveyed(files(spark, "b a\nc", "", None), lambda lines: ({"n": len(lines)}, [{"word": w, "line": i} for i, x in enumerate(lines, 1) for w in x.split()]) if lines else None, T.StructType().add("n", T.IntegerType()), items)
    assert [(r.path, r.measures.n, [(x.word, x.line) for x in r["items"]]) for r in df.collect()] == [("f0", 2, [("b", 1), ("a", 1), ("c", 2)])]


def test_routing_shuffled_equals_broadcast(spark, monkeypatch):
    from textloom.operators import routing

    df = spark.createDataFrame([(f"/a/{d}/f{i}.c", f"/a/{d}") for i, d in enumerate(["b", "b/c", "d", "b/c/e", "bb"])], "path string, dir string")
    configs = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/c",)], "config_dir string")
    want = sorted(map(tuple, nearest(df, configs).select("path", "config_dir").collect()))
    assert [c for _, c in want] == ["/a/b/c", "/a/b/c", "/a/b", "/a", "/a"]
    monkeypatch.setattr(routing, "BROADCAST_CONFIGS", 0)
    assert sorted(map(tuple, nearest(df, configs).select("path", "config_dir").collect())) == want
