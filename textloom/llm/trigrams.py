"""Boolean trigram queries from regular expressions.

``query_of(regex)`` returns a condition that every text with a match fulfils:
``True`` (no trigram is mandatory), ``("and", parts)``, ``("or", parts)`` or a
lower-case trigram. It is derived from the parsed pattern: literal runs are
gathered across neighbouring elements, alternatives and optional elements
multiply the runs, and each finished run demands its trigrams.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: So many alternatives of a run are kept before it is finished.
_MOST = 64


def _both(kind: str, parts: list):
    """Flatten; and/or with their neutral elements."""
    flat: list = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif p not in flat:
            flat.append(p)
    if not flat:
        return True
    if kind == "or":  # what demands more than another alternative adds nothing
        need = [frozenset(p[1]) if p[0] == "and" else frozenset([p]) for p in flat]
        flat = [p for p, a in zip(flat, need, strict=True) if not any(b < a for b in need)]
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _demand(runs: set[str]):
    """One of the runs occurs."""
    return _both("or", [_both("and", [r[i : i + 3] for i in range(len(r) - 2)]) for r in sorted(runs)])


def _walk(items) -> tuple[set[str] | None, object]:
    """The exact strings that the items match (None: unknown), and what else they demand."""
    runs: set[str] = {""}
    demands: list = []
    exact = True

    def end():
        nonlocal runs, exact
        demands.append(_demand(runs))
        runs, exact = {""}, False

    for op, arg in items:
        if op is C.LITERAL:
            strings, inner = {chr(arg).lower()}, True
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            strings, inner = {chr(v).lower() for _, v in arg}, True
        elif op is C.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is C.BRANCH:
            found = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            inner = True if strings is not None else _both("or", [d if s is None else _demand(s) for s, d in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, body = arg
            strings, inner = _walk(body)
            if low == 0 and high == 1 and strings is not None:
                strings = strings | {""}
            elif low == 0:
                strings, inner = None, True
            elif (low, high) != (1, 1):
                inner, strings = _demand(strings) if strings is not None else inner, None
        elif op is C.AT:
            strings, inner = {""}, True
        else:
            strings, inner = None, True
        demands.append(inner)
        if strings is None:
            end()
        elif len(runs) * len(strings) > _MOST:
            end()
            runs = strings
        else:
            runs = {a + b for a in runs for b in strings}
    if exact:
        return runs, _both("and", demands)
    demands.append(_demand(runs))
    return None, _both("and", demands)


def query_of(regex: str):
    strings, demand = _walk(_parser.parse(regex))
    return demand if strings is None else _both("and", [_demand(strings), demand])


#: Fixed value: the letters of English by frequency, as far as they make up four fifths of its text.
_COMMON = frozenset("etaoinshrdlu ")


def thinned(query, most: int = 2):
    """A weaker query that names fewer trigrams: of those demanded together, the ``most`` with the fewest common letters."""
    if query is True or isinstance(query, str):
        return query
    parts = [p if isinstance(p, str) else thinned(p, most) for p in query[1]]
    if query[0] == "and":
        plain = sorted((p for p in parts if isinstance(p, str)), key=lambda g: (sum(c in _COMMON for c in g), g))
        parts = plain[:most] + [p for p in parts if not isinstance(p, str)]
    return _both(query[0], parts)


def grams(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*map(grams, query[1]))


def holds(query, present: set[str]) -> bool:
    """The condition on a set of lower-case trigrams."""
    if query is True:
        return True
    if isinstance(query, str):
        return query in present
    return (all if query[0] == "and" else any)(holds(p, present) for p in query[1])
