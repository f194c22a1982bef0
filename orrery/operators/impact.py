"""Walks that end in evidence: representative cycles, importers of call sites, classes of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators.traverse import layered
from orrery.store import Scratch

#: The classes of a change, from the weakest to the strongest.
CLASSES = ["metadata-only", "added", "body-changed", "signature-changed", "removed", "unknown"]

#: Words that a declaration has, starts of lines that are no part of a signature, and module surface.
_DECLARES = r"\b(export|default|declare|abstract|async|function|class|interface|type|enum|const|let|var|def|func|fn|struct|trait|impl|public|private|protected|static)\b"
_STATEMENT = r"^(return|throw|yield|if|for|while|switch|match|const|let|var|this\.|self\.|[A-Za-z_$][\w$]*\s*=)"
_PARAMETER = r"^([A-Za-z_$][\w$]*\??\s*:\s*[^;]+[,)]?|[A-Za-z_$][\w$<>,.?\[\] :*&]+\s+[A-Za-z_$][\w$]*\s*[,)]|[),:<>{}\[\]|&?]+)$"
_COMMENT = r"^(//|/\*|\*|\*/|#(?!include\b)|<!--|-->|\"\"\"|''')"
_MODULE = r"^\s*(import\b|export\s+(\*|\{)|(const|let|var)\s+\w+\s*=\s*require\b|using\b|package\b|#include\b|mod\b|pub\s+use\b)"


def representative_cycles(edges: DataFrame, members: DataFrame, depth: int = 1000) -> DataFrame:
    """component, cycle: for each strongly connected component its shortest closed walk from its least member.

    members: id, component, where component is the least id. Of several shortest walks the least, id by id, is given, which is
    the one that a breadth-first search over sorted neighbours meets first. All components walk in step, each inside itself;
    a component is done in the layer in which it closes. Raises where one goes on past `depth` layers.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    own = members.select("id", "component")
    inner = edges.select("source", "target").where("source <> target").distinct()
    inner = inner.join(own.select(F.col("id").alias("source"), "component"), "source").join(own.select(F.col("id").alias("target"), F.col("component").alias("other")), "target")
    inner = scratch.write(inner.where("component = other").select("component", F.col("source").alias("id"), "target"), "inner")
    front = scratch.write(own.where("id = component").select("component", "id", F.array("id").alias("path")), "layer-0")
    seen, found = front.select("component", "id"), []
    for d in range(1, depth + 1):
        step = scratch.write(front.join(inner, ["component", "id"]).select("component", F.col("target").alias("id"), "path").groupBy("component", "id").agg(F.min("path").alias("path")), f"step-{d}")
        closed = step.where("id = component")
        found.append(closed.select("component", F.concat("path", F.array("id")).alias("cycle")))
        on = step.join(closed.select("component"), "component", "left_anti").join(seen, ["component", "id"], "left_anti")
        front = scratch.write(on.withColumn("path", F.concat("path", F.array("id"))), f"layer-{d}")
        if not front.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        seen = seen.unionByName(front.select("component", "id"))
    raise RuntimeError(f"a cycle goes on past {depth} layers")


def affected_importers(imports: DataFrame, calls: DataFrame, depth: int = 5) -> DataFrame:
    """client, file, distance: the files of each client that reach one of its call sites by runtime imports.

    imports: client, source, target; calls: client, file, at distance 0. All clients walk in step.
    """
    at = lambda c: F.struct("client", F.col(c).alias("file"))
    back = imports.where("client is not null and source is not null and target is not null").select(at("target").alias("source"), at("source").alias("target"))
    seeds = calls.where("client is not null and file is not null").select(at("file").alias("id"))
    return layered(back, seeds, depth).select("id.client", "id.file", F.col("depth").alias("distance"))


def importers(imports: DataFrame, files: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """id, depth of the files within `depth` reverse imports of `files`, those included at 0.

    The delta's importers have depth 1 (G16), a wrapper's scope 4 (G17); the impact of a file gives the nearest `most`, ties by id (G22).
    """
    found = layered(imports.select(F.col("target").alias("source"), F.col("source").alias("target")), files, depth)
    return found if most is None else found.where("depth > 0").orderBy("depth", "id").limit(most)


def _bare(label: str) -> Column:
    """A label's leading identifier, as a pattern."""
    return F.replace(F.regexp_extract(label, r"^([A-Za-z0-9_$]*)", 1), F.lit("$"), F.lit(r"\$"))


def _names(label: str, flags: str = "") -> Column:
    """Whether the text has the label as a word."""
    return (_bare(label) != "") & F.rlike("text", F.concat(F.lit(flags + r"\b"), _bare(label), F.lit(r"\b")))


def changed_symbols(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """Changed lines with the symbol each belongs to, if any: id, start, exported and whether it declares or is code.

    lines: file, kind ('added' or 'removed'), old_line, new_line, text; a removed line has as new_line the place where it would be.
    symbols: file, id, label, lo, hi, exported. A line goes to the symbol whose range holds it: one it names first, then
    the shortest range, then the least id.
    """
    removed = F.col("kind") == "removed"
    lines = lines.withColumn("number", F.when(removed, F.col("old_line")).otherwise(F.col("new_line")))
    spans = F.col("new_line").between(F.col("lo"), F.col("hi")) | (removed & F.col("old_line").between(F.col("lo"), F.col("hi")))
    near = lambda low, high: F.col("new_line").between(low, high) | (removed & F.col("old_line").between(low, high))
    place = ["file", "kind", "number", "text"]
    own = symbols.select("file", "id", "label", "lo", "hi", "exported")
    hits = lines.join(own, "file").where(spans)
    first = W.partitionBy(*place).orderBy(F.coalesce(_names("label"), F.lit(False)).desc(), F.col("hi") - F.col("lo"), "id")
    hits = hits.withColumn("r", F.row_number().over(first)).where("r = 1")
    text = F.trim("text")
    inside = near(F.col("lo") + 1, F.col("lo") + 4) & ~text.rlike(_STATEMENT) & text.rlike(_PARAMETER)
    declares = near(F.col("lo"), F.col("lo")) | inside | (_names("label", "(?i)") & text.rlike(_DECLARES))
    hits = hits.select(*place, "id", "exported", declares.alias("declares"))
    met = lines.select(*place).distinct().join(hits, place, "left")
    return met.withColumn("is_code", (text != "") & ~text.rlike(_COMMENT))


def change_classes(files: DataFrame, lines: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, id, class of each changed symbol; file, class of each changed file).

    files: file, is_new, is_deleted, is_renamed, is_binary. lines and symbols as `changed_symbols` has them. A file has the
    strongest class of its symbols, unless its own state or lines outside of symbols say more. Null flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    files = files.select("file", *[flag(c).alias(c) for c in ("is_new", "is_deleted", "is_renamed", "is_binary")])
    met = changed_symbols(lines, symbols)
    any_of = lambda kind, cond: F.bool_or((F.col("kind") == kind) & F.col("is_code") & cond)
    said, yes = F.coalesce(F.col("declares"), F.lit(False)), F.lit(True)
    by = met.where("id is not null").groupBy("file", "id").agg(any_of("added", said).alias("da"), any_of("removed", said).alias("dr"), any_of("added", yes).alias("ca"), any_of("removed", yes).alias("cr"))
    c = F.when(F.col("is_new") | (F.col("da") & ~F.col("cr")), "added").when(F.col("is_deleted") | (F.col("dr") & ~F.col("ca")), "removed")
    c = c.when(F.col("da") | F.col("dr"), "signature-changed").when(F.col("ca") | F.col("cr"), "body-changed").otherwise("metadata-only")
    own = by.join(files, "file").select("file", "id", c.alias("class"))
    rank = lambda col: F.array_position(F.array(*[F.lit(x) for x in CLASSES]), col)
    strongest = own.groupBy("file").agg(F.max(rank(F.col("class"))).cast("int").alias("rank"))
    outside = met.where("id is null and is_code").groupBy("file").agg(F.bool_or(F.col("text").rlike(_MODULE)).alias("surface"))
    all_ = files.join(strongest, "file", "left").join(outside, "file", "left")
    whole = F.when(F.col("is_binary"), "unknown").when(F.col("is_deleted"), "removed").when(F.col("is_renamed"), "signature-changed").when(F.col("is_new"), "added")
    whole = whole.when(F.col("surface"), "signature-changed").when(~F.col("surface"), "unknown").when(F.col("rank").isNotNull(), F.element_at(F.array(*[F.lit(x) for x in CLASSES]), F.col("rank"))).otherwise("metadata-only")
    return own, all_.select("file", whole.alias("class"))


#: Classes of a file that put its callers at high risk.
BREAKING = ["removed", "signature-changed", "unknown"]


def change_seeds(files: DataFrame, own: DataFrame, classes: DataFrame, symbols: DataFrame, is_test: Column, include_added: bool = False) -> tuple[DataFrame, DataFrame]:
    """(file, class of each changed file with `test-only` for tests; file, id of the nodes to follow from it).

    own, classes: as `change_classes` gives them; symbols: file, id, exported; a file's own node is its path; is_test: over `file`. Changed symbols are followed, added ones only if
    asked for; a removed or changed signature that is exported brings its file. A file that is binary, removed, renamed or unknown is followed itself, and all but renamed ones with all
    their symbols; so is one whose surface changed outside of symbols. Tests are followed nowhere.
    """
    flags = files.select("file", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("is_deleted", "is_renamed", "is_binary")])
    test = F.coalesce(is_test, F.lit(False))
    product = classes.where(~test).withColumnRenamed("class", "file_class").join(flags, "file", "left")
    changed = own.join(product.select("file"), "file").join(symbols.select("file", "id", "exported"), ["file", "id"], "left")
    followed = changed.where((F.col("class") != "metadata-only") & ((F.col("class") != "added") | F.lit(include_added)))
    bring = followed.where(F.col("class").isin("removed", "signature-changed") & F.coalesce("exported", F.lit(False))).select("file", F.col("file").alias("id"))
    bare = product.join(own.select("file").distinct().withColumn("mapped", F.lit(True)), "file", "left")
    broken = F.col("is_binary") | F.col("is_deleted") | F.col("is_renamed") | (F.col("file_class") == "unknown")
    alone = ~broken & (F.col("file_class") == "signature-changed") & F.col("mapped").isNull()
    new = ~broken & (F.col("file_class") == "added") & F.lit(include_added)
    nodes = bare.where(broken | alone | new).select("file", F.col("file").alias("id"))
    all_of = product.where(F.col("is_binary") | F.col("is_deleted") | (F.col("file_class") == "unknown")).select("file").join(symbols.select("file", "id"), "file")
    seeds = followed.select("file", "id").unionByName(bring).unionByName(nodes).unionByName(all_of).where("id is not null").distinct()
    return classes.select("file", F.when(test, "test-only").otherwise(F.col("class")).alias("class")), seeds


def change_verdict(classes: DataFrame) -> DataFrame:
    """verdict (LOW, MEDIUM, HIGH), files, breaking, bodies of all changed files: one row, LOW for none."""
    breaking, body = F.col("class").isin(*BREAKING), F.col("class") == "body-changed"
    sums = classes.agg(F.count("*").alias("files"), F.coalesce(F.sum(breaking.cast("long")), F.lit(0)).alias("breaking"), F.coalesce(F.sum(body.cast("long")), F.lit(0)).alias("bodies"))
    return sums.select(F.when(F.col("breaking") > 0, "HIGH").when(F.col("bodies") > 0, "MEDIUM").otherwise("LOW").alias("verdict"), "files", "breaking", "bodies")
