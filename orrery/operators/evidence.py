"""Affected modules, schema references, fingerprints, clone suppression, task retrieval, seeds and content search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.rules import longest_prefix

from orrery.operators.liveness import top_per
from orrery.operators.ranges import innermost

#: File names of routers and the labels of their boilerplate.
ROUTER_FILE, ROUTER_LABEL = r"(?i)(^|/)\w[^/]*\.router\.[cm]?[jt]s$", r"(?i)^(router|routes)\(?\)?$"
#: Points of a changed symbol, of an intent seed, of a contained symbol, the most for degree, a shared word.
CHANGED, INTENT, CONTAINED, MOST_DEGREE, WORD = 100, 45, 22, 12, 8


def affected_modules(files: DataFrame) -> DataFrame:
    """client, module, n_files, nearest (A21). files: client, module, file, distance, a file once a client."""
    return files.groupBy("client", "module").agg(F.count("*").alias("n_files"), F.min("distance").alias("nearest"))


def schema_references(refs: DataFrame, objects: DataFrame, symbols: DataFrame) -> DataFrame:
    """source, target (J5): each mention of a declared schema object, from the innermost symbol around it, else from its file.

    refs: point, file, line, name; objects: id, name; symbols: file, id, lo, hi. Other names give nothing; no edge leads to itself.
    Sources and names are distinct before they meet the objects, so only objects of several names can give an edge twice.
    """
    named = objects.select("name", F.col("id").cast("string").alias("target")).distinct()
    many = named.groupBy("target").agg(F.count("*").alias("n"))
    known = refs.join(objects.select("name").distinct(), "name", "left_semi")
    inner = innermost(known.select("point", "file", "line"), symbols)
    source = F.coalesce(F.col("symbol").cast("string"), F.col("file"))
    own = known.join(inner, "point", "left").select(source.alias("source"), "name").distinct()
    edges = lambda which: own.join(named.join(many.where(which), "target").drop("n"), "name").where("source <> target").select("source", "target")
    return edges("n = 1").unionByName(edges("n > 1").distinct())


def fingerprint(rule: Column, kind: Column, evidence: Column) -> Column:
    """32 hex digits of SHA-256 over rule, kind and evidence as JSON with sorted keys, line numbers left out."""
    plain = F.regexp_replace(evidence, r":\d+\b", "")
    return F.substring(F.sha2(F.to_json(F.struct(plain.alias("evidence"), kind.alias("kind"), rule.alias("ruleId"))), 256), 1, 32)


def suppressed_groups(members: DataFrame) -> DataFrame:
    """group, n_members, suppressed (R21): two or more members, all router boilerplate or all declarative.

    members: group, file, label, declarative.
    """
    router = F.coalesce(F.col("file").rlike(ROUTER_FILE) & F.trim("label").rlike(ROUTER_LABEL), F.lit(False))
    every = F.bool_and(router) | F.bool_and(F.coalesce("declarative", F.lit(False)))
    return members.groupBy("group").agg(F.count("*").alias("n_members"), (every & (F.count("*") >= 2)).alias("suppressed"))


def task_symbols(task: list[str], nodes: DataFrame, edges: DataFrame, changed: DataFrame, seeds: DataFrame, top: int = 3) -> DataFrame:
    """id, score (R16): the symbols that fit a task best; changed ones, intent seeds, and what these contain.

    task: its words, lower case; nodes: id, label, kind, is_symbol; edges: source, target, relation; changed, seeds: id, once each.
    """
    start = changed.select("id", F.lit(CHANGED).alias("base")).unionByName(seeds.select("id", F.lit(INTENT).alias("base")))
    begun = start.join(nodes.select("id", "is_symbol"), "id")
    own = begun.select("id", "is_symbol").distinct()
    inside = own.where("not is_symbol").join(edges.where("relation = 'contains'"), F.col("id") == F.col("source")).select(F.col("target").alias("id"))
    held = own.where("is_symbol").select("id").unionByName(inside)
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    degree = ends.join(held.distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    more = held.join(degree, "id", "left").select("id", (CONTAINED + F.least(F.lit(MOST_DEGREE), F.coalesce("degree", F.lit(0)))).alias("base"))
    words = F.split(F.lower(F.concat_ws(" ", "label", "id", "kind")), "[^a-z0-9]+")
    shared = F.size(F.array_intersect(words, F.array(*map(F.lit, task)))) * WORD
    sums = begun.select("id", "base").unionByName(more).groupBy("id").agg(F.sum("base").alias("base"), F.count("*").alias("times"))
    ranked = sums.join(nodes.where("is_symbol"), "id").select("id", (F.col("base") + F.col("times") * shared).alias("score"))
    return ranked.orderBy(F.desc("score"), "id").limit(top)


def concept_seeds(scores: DataFrame, concepts: int) -> DataFrame:
    """concept, id, score (W5): for each concept in turn the best node that no earlier one took.

    scores: concept from 0, id, score. A concept needs no more than its first `concepts` nodes, so the turn-taking
    sees at most concepts squared rows.
    """
    best = top_per(scores.where("score > 0"), ["concept"], [F.desc("score"), "id"], concepts)
    item = F.struct("concept", (-F.col("score")).alias("low"), "id")
    line = best.groupBy().agg(F.sort_array(F.collect_list(item)).alias("line"))
    kind = best.select(item.alias("x")).schema["x"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    taken = F.aggregate("line", none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["id"] == x["id"]) | (y["concept"] == x["concept"])), acc).otherwise(F.concat(acc, F.array(x))))
    return line.select(F.explode(taken).alias("x")).select("x.concept", "x.id", (-F.col("x.low")).alias("score"))


def content_search(files: DataFrame, literal: str) -> DataFrame:
    """repo, path, line (F12): lines that hold a literal, in any case. files: repo, path, text; lines count from 1."""
    held = files.where(F.contains(F.lower("text"), F.lit(literal.lower())))
    lines = held.select("repo", "path", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    return lines.where(F.contains(F.lower("body"), F.lit(literal.lower()))).select("repo", "path", (F.col("line") + 1).cast("long").alias("line"))


def fresh_evidence(evidence: DataFrame, now: Column, days: int) -> DataFrame:
    """Run-time evidence (a column ts) of at most so many days before `now`; later or unknown times are no evidence."""
    return evidence.where((F.col("ts") >= now - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= now))


def owned_dependencies(imports: DataFrame, manifests: DataFrame, dependencies: DataFrame) -> DataFrame:
    """file, name, manifest, state (J22): an import against the manifest that owns its file, the deepest folder on its path.

    imports: file, name; manifests: manifest (a folder), package; dependencies: manifest, alias, package. An import matches
    an alias or a package name, `declared`; the manifest's own package is `self` and never missing; the rest is `missing`. Files without a manifest are left out.
    """
    own = longest_prefix(imports.select("file").distinct(), manifests.select(F.col("manifest").alias("prefix"))).select("file", F.col("owner").alias("manifest"))
    at = imports.select("file", "name").distinct().join(own, "file").join(manifests.select("manifest", F.col("package").alias("itself")), "manifest")
    names = dependencies.select("manifest", F.col("alias").alias("name")).union(dependencies.select("manifest", "package")).where("name is not null").distinct().withColumn("declared", F.lit(True))
    state = F.when(F.col("name") == F.col("itself"), "self").when(F.col("declared"), "declared").otherwise("missing")
    return at.join(names, ["manifest", "name"], "left").select("file", "name", "manifest", state.alias("state"))


def contract_verdict(contracts: Column, matches: Column, mismatches: Column) -> Column:
    """The verdict on a set of contracts (R20) from three totals: contracts, calls that match one, calls that match but for the method."""
    called = F.when(mismatches > 0, "CLIENTS_AT_RISK_WITH_METHOD_MISMATCHES").otherwise("CLIENTS_AT_RISK")
    uncalled = F.when(mismatches > 0, "HTTP_METHOD_MISMATCH").otherwise("NO_STATIC_CLIENT_CALLERS")
    return F.when(matches > 0, called).when(contracts > 0, uncalled).otherwise("NO_ENDPOINTS_MATCHED")
