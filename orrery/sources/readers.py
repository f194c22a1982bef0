"""Readers of reports and manifests: each takes a table with the text of one file a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lcov(reports: DataFrame) -> DataFrame:
    """file, line, hits of LCOV reports; a line that is not a number is left out."""
    rec = reports.select(F.explode(F.split("text", "end_of_record")).alias("r")).select(F.regexp_extract("r", r"(?m)^SF:(.+)$", 1).alias("file"), "r").where("file <> ''")
    lines = rec.select("file", F.explode(F.regexp_extract_all("r", F.lit(r"(?m)^DA:(\d+,\d+)"), 1)).alias("x"))
    return lines.select("file", F.split("x", ",")[0].cast("int").alias("line"), F.split("x", ",")[1].cast("long").alias("hits"))


def numstat_omitted(logs: DataFrame, max_files: int = 80) -> DataFrame:
    """commits, omitted: how many records the logs have, and how many `numstat` leaves out for their size."""
    rec = logs.select(F.explode(F.split("text", "\x1e")).alias("r")).where("r <> ''")
    files = F.size(F.filter(F.split("r", "\x00"), lambda x: F.size(F.split(x, "\t")) == 3))
    return rec.agg(F.count("*").alias("commits"), F.coalesce(F.sum((files > max_files).cast("long")), F.lit(0)).alias("omitted"))


def numstat(logs: DataFrame, max_files: int = 80) -> DataFrame:
    """commit, ts, file, additions, deletions, is_binary of `git log --numstat -z` output.

    Records: RS hash US time NUL, then `added TAB deleted TAB path NUL`. A rename has an empty path,
    then the old and the new one. A commit of more than max_files files is left out whole; `numstat_omitted` counts them.
    """
    rec = logs.select(F.explode(F.split("text", "\x1e")).alias("r")).where("r <> ''")
    head = F.split(F.substring_index("r", "\x00", 1), "\x1f")
    moved = F.regexp_replace("r", "\t\x00[^\x00]*\x00([^\x00]*)\x00", "\t$1\x00")
    items = F.filter(F.slice(F.split(moved, "\x00"), 2, 1 << 30), lambda x: F.size(F.split(x, "\t")) == 3)
    rows = rec.select(head[0].alias("commit"), head[1].cast("long").alias("ts"), items.alias("i")).where(F.size("i") <= max_files).select("commit", "ts", F.explode("i").alias("x"))
    p = F.split("x", "\t")
    number = lambda c: F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))
    return rows.select("commit", "ts", p[2].alias("file"), number(p[0]).alias("additions"), number(p[1]).alias("deletions"), (p[0] == "-").alias("is_binary"))


_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def package_json(files: DataFrame) -> DataFrame:
    """file, name, version, section of package manifests."""
    schema = ", ".join(f"{s} map<string,string>" for s in _SECTIONS)
    j = files.select("file", F.from_json("text", schema).alias("m"))
    parts = [j.select("file", F.explode(f"m.{s}").alias("name", "version"), F.lit(s).alias("section")) for s in _SECTIONS]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def requirements(files: DataFrame) -> DataFrame:
    """file, name (folded), version of requirement lines; comments and options are left out."""
    line = files.select("file", F.explode(F.split("text", "\r?\n")).alias("l")).select("file", F.trim(F.regexp_replace("l", r"\s*#.*$", "")).alias("l")).where("l rlike '^[A-Za-z0-9]'")
    return line.select("file", F.regexp_replace(F.lower(F.regexp_extract("l", r"^([A-Za-z0-9._-]+)", 1)), r"[-_.]+", "-").alias("name"), F.regexp_extract("l", r"==\s*([^\s;]+)", 1).alias("version"))


def go_mod(files: DataFrame) -> DataFrame:
    """file, name, version of the modules that go.mod requires."""
    hits = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-/]+)\s+v([\w.\-+]+)"), 0)
    return files.select("file", F.explode(hits).alias("h")).select("file", F.regexp_extract("h", r"([\w.\-]+\.[\w.\-/]+)\s+v", 1).alias("name"), F.regexp_extract("h", r"\s(v[\w.\-+]+)$", 1).alias("version"))
