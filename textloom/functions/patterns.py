"""Default patterns of the line classes, and Python patterns turned into Java ones."""

from __future__ import annotations

import re

#: The default patterns. All are matched without regard to case; ``\s`` and ``\b`` follow Unicode.
TRUE_BLANK = r"^\s*$"
BLANK = r"""^[\s\\+.,;=\-/*'`"#!%{}()\[\]<>|]*$"""
BLANK_XML = r"^\s*(<[\w/\\]*>)+\s*$"
STRINGS = r"""(".+?")|('.+?')"""
COMMENT = r"^\s*(//|#(?!\||def|inc|if|els|end)|;|--(?!\[)|rem|!)"
COMMENT_OPEN = r"((^|[^/])/\*|--\[\[|=(begin|head|item)|#\||\{-|<!--|<%--)"
COMMENT_CLOSE = r"(\*/|\]\]|=(cut|end)|\|#|-\}|-->|--%>)"
IMPORTS = r"\b(using|import|#*include)\b"
CLASSES = r"\b(class|type|interface)\b"
PREPROCESSOR = r"^\s*#(def|if|else|end)"
ROUTINES = r"\b(def|public|private|protected|static|void|sub|func|function|prop|property|proc|procedure)\s*[(\[ {]+"
DECISIONS = r"\b(if|elseif|elif|else|unless|for|foreach|while|until|when|from|where|join|find)\b"
CASES = r"\b(case)\b"
ESCAPES = r"\b(return|continue|break|goto|except|catch|finally)\b"
BOOLEANS = r"(\s+and\s+|\s+or\s+|\|\||&&)"
DEAD_CODE = r"[;{}_\[\](]\s*$|[A-Za-z]\.[A-Za-z]|[&+\[\]|]|=(?![^>])"
MACHINE = (
    (r"region\b.*?\bgenerated", r"end\s*region"),
    (r"\bdo\s+not\s+(edit|modify)\b", None),
    (r"(generated|compiled)\b[^.]*?\b(with|by|from|date|time|auto|code|file|class|script|source)", None),
    (r"\b(auto[^\x08]*?|code|file|class|script|source|designer)\b[^.]*?\b(generated|created)\b", None),
    (r"\bcreated\b.*?\b(tool|auto|code|script)\b", None),
)
SCRIPT = ((r"[<{]%", r"%[>}]"), (r"<\?", r"\?>"), (r"<script", r"</script>"))
INLINE = ("//", "[#](?!def|inc|if)", "/*")
PYTHON_COMMENT = r"^\s*#"
PYTHON_QUOTES = r"(\"\"\"|''')"
PYTHON_STRINGS = r"""("[^"].*?")|('[^'].*?')"""
COBOL_COMMENT = r"^\s*(\*|/)"
COBOL_BLANK = r"^\s*$"
DELPHI_BLANK = r"^\s*(\bbegin\b|\bend;)?\s*$"
DELPHI_COMMENT = r"^\s*//"
DELPHI_OPEN = r"(\(\*|\{(?![/$]))"
DELPHI_CLOSE = r"(\*\)|\})"
DELPHI_DEAD = r"[;\[\]]+\s*$|[A-Za-z]\.[A-Za-z]|[=&+\[\]|]+"


def flat(pattern: str) -> str:
    """A Python verbose pattern without its layout: white space and comments outside classes go."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            inside = c != "]"
            out.append(c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1 : i + 2] == "]":
                out.append("\\]")
                i += 1
        elif c == "#":
            i = pattern.find("\n", i)
            if i < 0:
                break
        elif not c.isspace():
            out.append(c)
        i += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = True) -> str:
    """A flat Python pattern as Java reads it alike."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        step = c
        if c == "\\":
            step = rest[:2]
            out.append("\\x08" if inside and step == "\\b" else "\\z" if step == "\\Z" else step)
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[":
                step = "\\["
                out.append(step)
                i += 1
                continue
            elif rest.startswith("&&"):
                out.append("\\&\\&")
                i += 2
                continue
        elif c == "[":
            inside = True
            step = "[^" if rest.startswith("[^") else "["
        elif c == "{" and not re.match(r"\{\d*,?\d*\}", rest):
            out.append("\\{")
            i += 1
            continue
        elif rest.startswith("(?P<"):
            out.append("(?<")
            i += 4
            continue
        out.append(step)
        i += len(step)
    return f"(?d{'i' if ignore_case else ''}U)" + "".join(out)


def groups(pattern: str) -> int:
    return re.compile(pattern).groups


def glob(pattern: str) -> str:
    """A file name pattern (* ? [seq] [!seq]) as an anchored Java pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else "\\" + body if body[:1] == "^" else body) + "]")
            i = end + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + r"\z"
