"""Path functions as Columns: classes, territory, module, globs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of paths and their patterns.
CLASSES = {
    "e2e": r"(^|/)(?:test-e2e|e2e|cypress|playwright|tests?[-_](?:e2e|integration|acceptance)|(?:e2e|integration|acceptance)[-_]tests?)(/|$)|\.(?:e2e|cy)\.[^./]+$",
    "test": r"(^|/)(?:__tests?__|tests?|spec)(/|$)|\.(?:test|itest|spec)\.[^./]+$|_test\.go$|(^|/)test(?:_[^/]*)?\.py$",
    "generated": r"(^|/)(?:generated|gen|openapi[-_]?generated|generated[-_]?client|api[-_]?client[-_]?generated)(/|$)|(^|/)(?:dist|build|out|coverage|\.next)(/|$)",
    "vendored": r"(^|/)(?:vendor|vendored|third[-_]?party)(/|$)",
    "mock": r"(^|/)(?:__mocks__|mocks?|fixtures?|__fixtures__)(/|$)|(^|/)(?:mock[-_.]?data|test[-_.]?data|fake[-_.]?data)\.[^./]+$",
    "story": r"(^|/)\.storybook(/|$)|\.stories?\.[^./]+$",
    "docs": r"(^|/)(?:docs?|documentation)(/|$)|\.(?:md|markdown|mdx|rst|adoc)$",
    "benchmark": r"(^|/)benchmarks?(/|$)",
    "temp": r"(^|/)(?:__temp|\.tmp(?:[-_][^/]*)?)(/|$)",
}


def path_classes(path: Column) -> Column:
    """Sorted array of the classes of a path; e2e implies test; null has none."""
    p = F.lower(path)
    test = F.when(p.rlike(CLASSES["test"]) | p.rlike(CLASSES["e2e"]), "test")
    rest = [F.when(p.rlike(r), k) for k, r in CLASSES.items() if k != "test"]
    return F.array_sort(F.array_compact(F.array(test, *rest)))


def territory(path: Column) -> Column:
    """The first two folders of a path, `(root)` for a file at the top."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(dirs) == 0, "(root)").otherwise(F.array_join(F.slice(dirs, 1, 2), "/"))


MODULE_SQL = "array_to_string(string_split(file, '/')[1:2], '/')"


def module_of(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


def glob_regex(glob: str) -> str:
    """An anchored regular expression of a glob: ** crosses folders, * and ? do not; a/**/b matches a/b."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Ordered globs, `!` takes a path in again; the last rule that matches decides."""
    out = F.lit(False)
    for rule in rules:
        out = F.when(path.rlike(glob_regex(rule.lstrip("!"))), F.lit(not rule.startswith("!"))).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def words_of_name(name: Column) -> Column:
    """Lower-case words of an identifier, split at case changes and signs."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")
    return F.array_remove(F.split(F.lower(F.trim(spaced)), " +"), "")


def route(path: Column) -> Column:
    """A route's shape: no host, query or end slash; {x}, :x, [x] and digit parts as :param."""
    p = F.regexp_replace(F.regexp_replace(path, r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    p = F.regexp_replace(p, r"/(\{[^/}]*\}|:[^/]+|\[[^/\]]*\]|[0-9]+)(?=/|$)", "/:param")
    return F.when(p.isin("", "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
