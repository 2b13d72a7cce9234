"""The configuration language: entries that say which files are measured how.

An entry is a line of verb, module, measure filters, file filters, tags and
options; verbs with parameters are followed by parameter lines up to their end
marker. Comments, IGNORE_START/IGNORE_STOP, line continuation, constants and
includes are resolved while reading. Nothing of a configuration is executed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from textloom.functions.patterns import flat
from textloom.plans.profile import END_MARKERS, MODULES, VERBS, Profile, profile


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Param:
    positive: bool
    raw: str
    regex: str


@dataclass(frozen=True)
class Entry:
    verb: str
    module: str
    measure_filters: tuple[str, ...]
    file_filters: tuple[str, ...]
    tags: tuple[str, ...] = ()
    options: tuple[tuple[str, str | None], ...] = ()
    params: tuple[Param, ...] = ()

    def __str__(self) -> str:
        options = [f"OPT:{n}" + (f":{v}" if v is not None else "") for n, v in self.options]
        return " ".join([self.verb, self.module, ";".join(self.measure_filters), ";".join(self.file_filters), *self.tags, *options, *(p.raw for p in self.params)])

    @property
    def profile(self) -> Profile:
        return profile(self.module, self.options)

    @property
    def out_file(self) -> str | None:
        return next((t[4:] for t in self.tags if t.startswith("OUT:")), None)

    @property
    def plain_tags(self) -> tuple[str, ...]:
        return tuple(t for t in self.tags if not t.startswith("OUT:"))


def param(line: str) -> Param:
    """A parameter line: POSITIVE__ or NEGATIVE__ before a verbose pattern; positive without."""
    for prefix, positive in (("POSITIVE__", True), ("NEGATIVE__", False)):
        if line.startswith(prefix):
            body = line[len(prefix) :].strip()
            return Param(positive, body, flat(body))
    return Param(True, line, flat(line))


def distinct_params(params: tuple[Param, ...]) -> tuple[Param, ...]:
    """One of each, told apart by sign and text without white space; the last one counts, in the first one's place."""
    found: dict[tuple[bool, str], Param] = {}
    for p in params:
        found[p.positive, " ".join(p.raw.split())] = p
    return tuple(found.values())


def entry(line: str) -> Entry:
    words = line.split()
    if len(words) < 4:
        raise ConfigError(f"an entry has a verb, a module, measure filters and file filters: {line}")
    verb, module, measures, files, *more = words
    tags, options = _tags(more)
    return checked(Entry(verb, module, tuple(x for x in measures.split(";") if x), tuple(x for x in files.split(";") if x), tags, options))


def _tags(words: list[str]) -> tuple[tuple[str, ...], tuple[tuple[str, str | None], ...]]:
    tags, options = [], []
    for w in words:
        if w.startswith("OPT:"):
            name, colon, value = w[4:].partition(":")
            options.append((name, value if colon else None))
        else:
            tags.append(w)
    return tuple(tags), tuple(options)


def checked(e: Entry) -> Entry:
    if e.module not in MODULES:
        raise ConfigError(f"no module {e.module}")
    if e.verb not in VERBS[e.module]:
        raise ConfigError(f"module {e.module} can't {e.verb}; it can {', '.join(VERBS[e.module])}")
    _ = e.profile
    return e


def _lines(text: str) -> list[str]:
    """Lines that count: without comments, ignored stretches, and with continuations joined."""
    out, ignoring, held = [], False, ""
    for raw in text.splitlines():
        line = raw.strip()
        if ignoring:
            ignoring = line != "IGNORE_STOP"
            continue
        if line == "IGNORE_START":
            ignoring = True
            continue
        if not held and (not line or line.startswith("#")):
            continue
        line = re.split(r"\s#", line, maxsplit=1)[0].rstrip() if not line.startswith("#") else line
        if line.endswith("\\"):
            held += line[:-1].rstrip() + " "
            continue
        out.append((held + line).strip())
        held = ""
    return out + ([held.strip()] if held.strip() else [])


def parse(text: str, read: Callable[[str], str] | None = None, defaults: tuple[tuple[str, str | None], ...] = (), folder: str = "") -> list[Entry]:
    """The entries of a configuration; ``read`` gives the text of an included one, whose path is relative to the folder of the file that names it. ``defaults`` go before each entry's options."""
    constants: dict[str, str] = {}
    found: list[Entry] = []

    def resolved(line: str) -> str:
        for _ in range(10):
            new = line
            for name in sorted(constants, key=len, reverse=True):
                new = new.replace(name, constants[name])
            if new == line:
                break
            line = new
        return line

    lines = iter(_lines(text))
    for line in lines:
        if line.startswith(("CONSTANT:", "CONSTANT_NOBLANK:")):
            kind, name, value = line.split(":", 2)
            constants[name] = value.replace(" ", "") if kind == "CONSTANT_NOBLANK" else value
            continue
        line = resolved(line)
        if line.startswith("INCLUDE:"):
            path, _, more = line[len("INCLUDE:") :].partition(":")
            if read is None:
                raise ConfigError(f"nothing to read {path} with")
            tags, options = _tags(more.split())
            path = path.strip()
            if folder and not path.startswith("/") and "://" not in path:
                path = f"{folder}/{path}"
            have = {e.file_filters for e in found}
            found += [replace(e, tags=e.tags + tags, options=e.options + options) for e in parse(read(path), read, defaults, path.rpartition("/")[0]) if e.file_filters not in have]
            continue
        e = entry(line)
        end = END_MARKERS.get(e.verb)
        params: list[Param] = []
        if end:
            for p in lines:
                if p == end:
                    break
                params.append((MODULES[e.module].hooks.param or param)(resolved(p)))
            else:
                raise ConfigError(f"{e.verb} without {end}")
        found.append(replace(e, options=defaults + e.options, params=distinct_params(tuple(params))))
    double_counted(found)
    return found


def matches_measure(name: str, filters: tuple[str, ...]) -> bool:
    """A name passes with an equal filter, or one that ends in * and begins alike; names without a dot always do."""
    if "." not in name or not filters:
        return True
    return any(_overlap(name, f) for f in filters)


def _overlap(a: str, b: str) -> bool:
    if a.endswith("*") and b.startswith(a[:-1]) or b.endswith("*") and a.startswith(b[:-1]):
        return True
    return a == b


def double_counted(entries: list[Entry]) -> None:
    """Two entries may not take the same measures of the same files under the same tags; pattern filters are exempt."""
    for i, a in enumerate(entries):
        for b in entries[i + 1 :]:
            same = {f for f in a.file_filters if not f.startswith("RE:")} & set(b.file_filters)
            if a.verb == b.verb and same and set(a.tags) == set(b.tags) and any(_overlap(x, y) for x in a.measure_filters or ("*",) for y in b.measure_filters or ("*",)):
                raise ConfigError(f"double counting of {';'.join(sorted(same))}: {a} and {b}")


#: Overrides for scans of everything.
SCAN_ALL = {"n": "measure NBNC file.* *", "d": "measure Code * * OPT:MEASURE_EMPTIES", "m": "measure NBNC * * OPT:METADATA_ONLY"}
