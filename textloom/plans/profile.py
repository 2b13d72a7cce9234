"""Measurement profiles: a module's patterns and switches, changed by its options."""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from textloom.functions import patterns as P

HUMAN, MACHINE, CONTENT = 0, 1, 2


@dataclass(frozen=True)
class Hooks:
    """What a module of one's own adds to the measuring of code, as column expressions.

    ``preprocess`` changes a line before it is tested. ``counts`` names measures
    by conditions on a classified line, of which the columns line, bits, block,
    in_comment, changed (the block changes here) and _c (the line's class) can
    be used. ``file`` gets the finished measures of all files and may add to
    them. ``param`` reads a parameter line of the module's entries.
    """

    preprocess: Callable | None = None
    counts: tuple[tuple[str, Callable], ...] = ()
    file: Callable | None = None
    param: Callable | None = None


@dataclass(frozen=True)
class Profile:
    """All that decides how a file is measured. Patterns are flat Python regular expressions."""

    module: str = "Code"
    # opening files
    force_all: bool = False
    ignore_size: int = 0
    ignore_paths: tuple[str, ...] = ()
    metadata_only: bool = False
    include_deleted: bool = False
    # output
    write_empties: bool = False
    measure_filter: str | None = None
    metadata: tuple[str, ...] = ()
    # lines
    ignore_case: bool = True
    line_separator: str | None = None
    max_line: int = 255
    skip_lines: str | None = None
    skip_binary: bool = False
    continue_on_error: bool = False
    strings: str = P.STRINGS
    blank: str = P.BLANK
    blank_add: str | None = None
    blank_xml: bool = False
    comment: str = P.COMMENT
    comment_open: str | None = P.COMMENT_OPEN
    comment_close: str | None = P.COMMENT_CLOSE
    close_code: bool = False
    strip_for_comments: bool = True
    # blocks: detectors by block number from 1
    measured_block: int = HUMAN
    machine: tuple[tuple[str, str | None], ...] = ()
    content: tuple[tuple[str, str | None], ...] = ()
    block_ignore: str | None = None
    block_ignore_file: str | None = None
    # code
    imports: str = P.IMPORTS
    classes: str = P.CLASSES
    preprocessor: str = P.PREPROCESSOR
    routines: str = P.ROUTINES
    decisions: str = P.DECISIONS
    cases: str = P.CASES
    escapes: str = P.ESCAPES
    booleans: str = P.BOOLEANS
    dead_code: str | None = P.DEAD_CODE
    inline: tuple[str, ...] = P.INLINE
    inline_in_comments: bool = True
    count_booleans: bool = False
    count_escapes: bool = True
    count_cases: bool = True
    search_strings: bool = False
    search_comments: bool = False
    only_comments: bool = False
    search_ignore_case: bool = True
    # routines
    routine_file_lines: bool = False
    routine_span_blocks: bool = False
    routine_single_line: bool = False
    routine_output_single: bool = False
    routine_indent: int = 4
    routine_ignore_column: int = 20
    options: tuple[tuple[str, str | None], ...] = field(default=(), compare=False)
    hooks: Hooks = field(default=Hooks(), compare=False)

    @property
    def detectors(self) -> tuple[tuple[tuple[str, str | None], ...], ...]:
        return (self.machine, self.content)

    @property
    def has_blocks(self) -> bool:
        return self.module != "NBNC" and self.module != "Search" and any(self.detectors)


_CODE = Profile(machine=P.MACHINE)
#: Profiles of the modules, by name; verbs that each can do.
MODULES: dict[str, Profile] = {
    "NBNC": Profile("NBNC"),
    "Code": _CODE,
    "Web": replace(_CODE, module="Web", content=P.SCRIPT, measured_block=CONTENT),
    "Search": Profile("Search"),
    "Depends": replace(_CODE, module="Depends"),
    "DupeLines": replace(_CODE, module="DupeLines"),
    "customCobol": replace(_CODE, module="customCobol", blank=P.COBOL_BLANK, comment=P.COBOL_COMMENT, comment_open=None, comment_close=None),
    "customDelphi": replace(_CODE, module="customDelphi", blank=P.DELPHI_BLANK, comment=P.DELPHI_COMMENT, comment_open=P.DELPHI_OPEN, comment_close=P.DELPHI_CLOSE, dead_code=P.DELPHI_DEAD),
}
VERBS: dict[str, tuple[str, ...]] = {
    "NBNC": ("measure",),
    "Search": ("search", "multisearch"),
    "Depends": ("analyze",),
    "DupeLines": ("analyze",),
} | dict.fromkeys(("Code", "Web", "customCobol", "customDelphi"), ("measure", "tempmeasure", "analyze", "routines", "search"))
#: Verbs with parameter lines and the line that ends them.
END_MARKERS = {v: f"{v}_end" for v in ("search", "multisearch", "routines", "tempmeasure")}


def register(name: str, base: Profile, verbs: tuple[str, ...] = ("measure",), hooks: Hooks | None = None) -> None:
    """Add a module under a new name: a profile, the verbs that entries may use with it, and its hooks."""
    if name in MODULES:
        raise ValueError(f"there is a module {name}")
    MODULES[name] = replace(base, module=name, hooks=hooks or base.hooks)
    VERBS[name] = verbs


def _pairs(text: str) -> tuple[tuple[str, str | None], ...]:
    """Detector pairs from a list literal of patterns; re.compile(...) around a pattern is read through, nothing is run."""

    def value(node: ast.expr):
        if isinstance(node, ast.Call):
            return value(node.args[0])
        if isinstance(node, (ast.List, ast.Tuple)):
            return [value(x) for x in node.elts]
        if isinstance(node, ast.Constant) and (node.value is None or isinstance(node.value, str)):
            return P.flat(node.value) if node.value else None
        raise ValueError(f"not a list of patterns: {text}")

    found = value(ast.parse(text, mode="eval").body)
    return tuple((a, b) for a, b in (found if found and isinstance(found[0], list) else [found]))


def _names(text: str) -> tuple[str, ...]:
    try:
        found = ast.literal_eval(text)
    except (SyntaxError, ValueError):
        found = text.split(",")
    return tuple(found) if isinstance(found, (list, tuple, set)) else (str(found),)


def _set(name: str, value) -> Callable[[Profile, str | None], Profile]:
    return lambda p, _: replace(p, **{name: value})


def _take(name: str, read: Callable = str) -> Callable[[Profile, str | None], Profile]:
    return lambda p, v: replace(p, **{name: read(v)})


def _append(name: str) -> Callable[[Profile, str | None], Profile]:
    return lambda p, v: replace(p, **{name: getattr(p, name) + _pairs(v)})


_PYTHON = {"strip_for_comments": False, "comment": P.PYTHON_COMMENT, "comment_open": P.PYTHON_QUOTES, "comment_close": P.PYTHON_QUOTES, "strings": P.PYTHON_STRINGS}
METADATA_LETTERS = "adfprsyz"

#: Options by name: each gives a changed profile. Those that take a value come with True.
OPTIONS: dict[str, tuple[bool, Callable[[Profile, str | None], Profile]]] = {
    "FORCE_ALL_TYPES": (False, _set("force_all", True)),
    "IGNORE_SIZE": (True, _take("ignore_size", int)),
    "IGNORE_PATHS": (True, _take("ignore_paths", _names)),
    "MEASURE_EMPTIES": (False, _set("write_empties", True)),
    "MEASURE_FILTER": (True, _take("measure_filter")),
    "METADATA": (True, _take("metadata", _names)),
    "METADATA_ALL": (False, _set("metadata", ("path", "name", "date", "size", "dirs", "tags", "dirfiles"))),
    "METADATA_DEBUG": (False, lambda p, _: replace(p, metadata=(*p.metadata, "debug"))),
    "METADATA_ONLY": (False, _set("metadata_only", True)),
    "DELTA_INCL_DELETED": (False, _set("include_deleted", True)),
    "CASE_SENSITIVE": (False, _set("ignore_case", False)),
    "ADD_LINE_SEP": (True, _take("line_separator")),
    "BLANK_LINE": (True, _take("blank", P.flat)),
    "BLANK_LINE_ADD": (True, _take("blank_add", P.flat)),
    "BLANK_LINE_XML": (False, _set("blank_xml", True)),
    "COMMENT_LINE": (True, _take("comment", P.flat)),
    "COMMENT_OPEN": (True, _take("comment_open", P.flat)),
    "COMMENT_CLOSE": (True, _take("comment_close", P.flat)),
    "COMMENT_CLOSE_CODE": (False, _set("close_code", True)),
    "COMMENT_NO_STRIP": (False, _set("strip_for_comments", False)),
    "CONTINUE_ON_ERROR": (False, _set("continue_on_error", True)),
    "MAX_LINE_LENGTH": (True, _take("max_line", int)),
    "SKIP_LINES": (True, _take("skip_lines", P.flat)),
    "SKIP_BINARY_LINES": (False, _set("skip_binary", True)),
    "STRINGS": (True, _take("strings", P.flat)),
    "PYTHON_TRIPLE_COMMENTS": (False, lambda p, _: replace(p, **_PYTHON)),
    "BLOCK_IGNORE": (True, _take("block_ignore")),
    "BLOCK_IGNORE_FILE": (True, _take("block_ignore_file")),
    "MACHINE_NONE": (False, _set("machine", ())),
    "MACHINE_ALL": (False, _set("machine", ((".*", None),))),
    "MACHINE_MEASURE": (False, _set("measured_block", MACHINE)),
    "MACHINE_ADD_DETECT": (True, _append("machine")),
    "MACHINE_DETECTORS": (True, _take("machine", _pairs)),
    "CONTENT_ADD_DETECTOR": (True, _append("content")),
    "CONTENT_DETECTORS": (True, _take("content", _pairs)),
    "BOOLEANS": (True, _take("booleans", P.flat)),
    "SEARCH_STRINGS": (False, _set("search_strings", True)),
    "SEARCH_COMMENTS": (False, _set("search_comments", True)),
    "ONLY_COMMENTS": (False, _set("only_comments", True)),
    "INLINE_EXCLUDE": (False, _set("inline_in_comments", False)),
    "INLINE_INCL_QUOTE": (False, lambda p, _: replace(p, inline=(*p.inline, "'"))),
    "INLINE": (True, _take("inline", _names)),
    "COMP_INCL_BOOLEAN": (False, _set("count_booleans", True)),
    "COMP_EXCL_ESCAPES": (False, _set("count_escapes", False)),
    "COMP_EXCL_CASES": (False, _set("count_cases", False)),
    "DECISIONS": (True, _take("decisions", P.flat)),
    "DEADCODE_NONE": (False, _set("dead_code", None)),
    "DEADCODE": (True, _take("dead_code", P.flat)),
    "IMPORTS": (True, _take("imports", P.flat)),
    "PREPROCESSOR": (True, _take("preprocessor", P.flat)),
    "ROUTINES": (True, _take("routines", P.flat)),
    "ROUTINE_FILE_LINES": (False, _set("routine_file_lines", True)),
    "ROUTINE_SPAN_BLOCKS": (False, _set("routine_span_blocks", True)),
    "ROUTINE_SINGLE_LINE": (False, _set("routine_single_line", True)),
    "ROUTINE_OUTPUT_SINGLE": (False, _set("routine_output_single", True)),
    "ROUTINE_NESTING_INDENT": (True, _take("routine_indent", int)),
    "ROUTINE_IGNORE_COLUMN": (True, _take("routine_ignore_column", int)),
    "CLASSES": (True, _take("classes", P.flat)),
    "ESCAPES": (True, _take("escapes", P.flat)),
    "CASES": (True, _take("cases", P.flat)),
    "SEARCH_CASE_SENSITIVE": (False, _set("search_ignore_case", False)),
    "SCRIPT_ADD_DETECT": (True, _append("content")),
    "SCRIPT_DETECTORS": (True, _take("content", _pairs)),
}


def profile(module: str, options: tuple[tuple[str, str | None], ...] = ()) -> Profile:
    """The module's profile with options applied in order."""
    if module not in MODULES:
        raise ValueError(f"no module {module}; there are {', '.join(sorted(MODULES))}")
    p = MODULES[module]
    for name, value in options:
        if name not in OPTIONS:
            raise ValueError(f"no option {name}")
        takes, change = OPTIONS[name]
        if takes and value is None:
            raise ValueError(f"option {name} needs a value")
        p = change(p, value)
    return replace(p, options=tuple(options))
