"""A scanner of C-like source text: strings, templates, comments and regular expressions are told apart from code.

One pass a text, by a small state machine: a stack says which template each closing brace returns to, and the token
before a slash says whether it divides or opens a regular expression, which has up to 1,000 items. Unclosed quotes are marks of their own, unclosed comments and templates reach to the end.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

NAME, NUMBER, STRING, TEMPLATE, REGEX, MARK, COMMENT = "name", "number", "string", "template", "regex", "mark", "comment"

_START = re.compile(r"\s*+(?:(?P<name>#?(?:[^\W0-9]|\$)(?:\w|\$)*+)|(?P<number>\.?[0-9][\w.]*+)|(?P<comment>//[^\n]*+|/\*)|(?P<quote>['\"])|(?P<mark>=>|\.\.\.|\?\.(?![0-9])|[^\w\s]))")
_QUOTED = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*+{q}") for q in "'\""}
_OPEN = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*+") for q in "'\""}
_CHUNK = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*+")
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n]){0,1000}+\]|[^/\\\n\[]){1,1000}+/[A-Za-z]*+")
#: Words after which a slash opens a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}


def tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every token, comments included; a template gives its pieces, with braces between them."""
    at, returns, before = 0, [], ("", "")
    unclosed = {"'": 0, '"': 0}  # before this place no quote of the kind closes: a scan from any of them meets the same end
    while at < len(text) and (m := _START.match(text, at)):
        kind, start, end = m.lastgroup, m.start(m.lastgroup), m.end()
        s = m.group(kind)
        if kind == "comment":
            if s == "/*":
                end = text.find("*/", end)
                end = len(text) if end < 0 else end + 2
            yield COMMENT, start, end
            at = end
            continue
        if kind == "quote":
            whole = _QUOTED[s].match(text, start) if start >= unclosed[s] else None
            if whole is None and start >= unclosed[s]:
                unclosed[s] = _OPEN[s].match(text, start).end()
            kind, end = (STRING, whole.end()) if whole else (MARK, end)
        elif s == "`" or (s == "}" and returns and returns[-1] == 0):
            if s == "}":
                returns.pop()
                yield MARK, start, end
            first = start if s == "`" else end
            end = _CHUNK.match(text, end).end()
            if text.startswith("`", end):
                end += 1
            elif text.startswith("${", end):
                if end > first:
                    yield TEMPLATE, first, end
                yield MARK, end + 1, end + 2
                returns.append(0)
                at, before = end + 2, (MARK, "{")
                continue
            else:
                end = len(text)  # it is not closed
            if end > first:
                yield TEMPLATE, first, end
            at, before = end, (TEMPLATE, "")
            continue
        elif kind == "mark" and s == "/" and _opens(before) and not text.startswith(">", end) and (whole := _REGEX.match(text, start)):
            kind, end = REGEX, whole.end()
        elif kind == "mark" and returns and s in "{}":
            returns[-1] += 1 if s == "{" else -1
        yield kind, start, end
        at, before = end, (kind, s)


def _opens(before: tuple[str, str]) -> bool:
    kind, s = before
    if kind == NAME:
        return s in _BEFORE_REGEX
    return kind == "" or (kind == MARK and s not in (")", "]", "<"))


def mask(text: str) -> str:
    """The text with comments, and what strings, templates and regular expressions say, blanked; as long as before, lines kept."""
    out, done = [], 0
    for kind, a, b in tokens(text):
        if kind in (COMMENT, STRING, TEMPLATE, REGEX):
            edge = 0 if kind in (COMMENT, TEMPLATE) else 1
            out += [text[done : a + edge], "".join(c if c == "\n" else " " for c in text[a + edge : b - edge])]
            done = b - edge
    return "".join([*out, text[done:]])


class Lines:
    """Line numbers, from 1, of places in a text."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect_right(self.breaks, at - 1) + 1
