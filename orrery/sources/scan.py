"""Scanners of source text: definitions and references as rows (S3)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEFINE = r"(?i)\bcreate\s+(?:or\s+replace\s+)?(table|view|function|index|trigger)\s+(?:if\s+not\s+exists\s+)?([A-Za-z_][\w.]*)"
_USE = r"(?i)\b(from|join|insert\s+into|merge\s+into|update|truncate\s+table|references|execute)\s+([A-Za-z_][\w.]*)"


def html_links(files: DataFrame) -> DataFrame:
    """file, target, n of href attributes."""
    return files.select("file", F.explode(F.regexp_extract_all("text", F.lit('href="([^"]*)"'), 1)).alias("target")).groupBy("file", "target").agg(F.count("*").alias("n"))


def sql_objects(files: DataFrame) -> DataFrame:
    """file, kind, name of declared objects; a cheap test comes before the pattern."""
    hit = files.where(F.lower("text").contains("create"))
    return hit.select("file", F.explode(F.arrays_zip(F.transform(F.regexp_extract_all("text", F.lit(_DEFINE), 1), F.lower).alias("kind"), F.regexp_extract_all("text", F.lit(_DEFINE), 2).alias("name"))).alias("o")).select("file", F.col("o.kind").alias("kind"), F.col("o.name").alias("name"))


def sql_references(files: DataFrame) -> DataFrame:
    """file, verb, name of every object use."""
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all("text", F.lit(_USE), 1), lambda v: F.regexp_replace(F.lower(v), r"\s+", " ")).alias("verb"), F.regexp_extract_all("text", F.lit(_USE), 2).alias("name"))
    return files.select("file", F.explode(pairs).alias("o")).select("file", F.col("o.verb").alias("verb"), F.col("o.name").alias("name"))


_SYMBOL = "file long, name string, kind string, line int, end_line int, cyclomatic int, params int"
_CALL = "file long, caller string, callee string, line int"
_BRANCH = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp, ast.comprehension)


def _walk(tree: ast.AST, prefix: str = ""):
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if prefix else "function"
            yield prefix + node.name, kind, node
            yield from _walk(node, f"{prefix}{node.name}.")


def _parsed(text: str | None):
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError):
        return ast.parse("")  # a file that does not parse keeps its file node only


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions, classes and methods of Python files with their spans, branches and parameters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b["file"], b["text"], strict=True):
                for name, kind, node in _walk(_parsed(text)):
                    params = 0 if kind == "class" else len(node.args.args) + len(node.args.kwonlyargs)
                    rows.append((file, name, kind, node.lineno, node.end_lineno, 1 + sum(isinstance(x, _BRANCH) for x in ast.walk(node)), params))
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "line", "end_line", "cyclomatic", "params"])

    return files.select("file", "text").mapInPandas(run, _SYMBOL)


def python_calls(files: DataFrame) -> DataFrame:
    """file, caller, callee, line of every call by name inside a function or method."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, text in zip(b["file"], b["text"], strict=True):
                for name, kind, node in _walk(_parsed(text)):
                    if kind != "class":
                        rows += [(file, name, ast.unparse(c.func), c.lineno) for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
            yield pd.DataFrame(rows, columns=["file", "caller", "callee", "line"])

    return files.select("file", "text").mapInPandas(run, _CALL)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """file, caller, callee, target file: own file first, then the importing binding.

    imports: file, name, target_file.
    """
    own = symbols.select("file", F.col("name").alias("callee"), F.col("file").alias("own_file")).distinct()
    bound = imports.select("file", F.col("name").alias("callee"), "target_file").distinct()
    j = calls.join(own, ["file", "callee"], "left").join(bound, ["file", "callee"], "left")
    return j.withColumn("target", F.coalesce("own_file", "target_file")).where("target is not null").select("file", "caller", "callee", "target")
