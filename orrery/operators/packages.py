"""Package graphs from npm lock files (S12): records, declarations, and the install each one means.

A lock file is JSON with a map of unknown keys, read as VARIANT; every record is a row, and a declaration looks for its name in its own install folder, then in each
folder above, as an equi-join of exploded candidate paths, of which the nearest counts. Limits on what is shown are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.rules import top_per
from orrery.store import Scratch

#: Names and versions of packages.
NAME = r"^(?:@[A-Za-z0-9._-]+/)?[A-Za-z0-9][A-Za-z0-9._-]*$"
VERSION = r"^[A-Za-z0-9][A-Za-z0-9._+~-]*$"
_INSTALLED = r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$"


def lock_path(raw: Column) -> Column:
    """An install path with forward slashes; null for absolute ones, URLs, control characters, empty or dotted parts."""
    p = F.regexp_replace(F.translate(raw, "\\", "/"), "/$", "")
    bad = (F.length(raw) > 4096) | raw.rlike(r"[\x00-\x1f\x7f]") | F.translate(raw, "\\", "/").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|/)")
    parts = F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return F.when(~bad & ((p == "") | ~parts), p)


def package_name(path: Column) -> Column:
    """The package installed at a path; null where it is none."""
    name = F.regexp_extract(path, _INSTALLED, 1)
    return F.when((F.length(name) <= 256) & name.rlike(NAME), name)


def lock_records(locks: DataFrame) -> DataFrame:
    """file, path, name, version, id, link, dev, optional, peer, record, valid, node of every record of supported locks (lockfileVersion 2 and 3).

    Of records whose paths are equal once they are normalised the first by its raw path is valid. id: npm:name@version:first 12 hex digits of the path's SHA-256.
    """
    v = locks.select("file", F.expr("try_parse_json(text)").alias("v"))
    packages = F.expr("try_variant_get(v, '$.packages', 'map<string, variant>')")
    v = v.where(F.expr("try_variant_get(v, '$.lockfileVersion', 'int') in (2, 3)"))
    rows = v.select("file", F.explode(packages).alias("raw", "record")).withColumn("path", lock_path(F.col("raw")))

    def get(field: str, kind: str) -> Column:
        return F.expr(f"try_variant_get(record, '$.{field}', '{kind}')")

    rows = rows.withColumn("name", package_name(F.col("path"))).withColumn("object", F.expr("schema_of_variant(record) like 'OBJECT%'"))
    installed = F.col("path").rlike(r"(^|/)node_modules/")
    fine = F.coalesce(F.col("path").isNotNull() & F.col("object") & (~installed | F.col("name").isNotNull()), F.lit(False))
    order = top_per(rows.where(fine), ["file", "path"], ["raw"], 1).select("file", "raw", F.lit(True).alias("first"))
    rows = rows.join(order, ["file", "raw"], "left").withColumn("valid", F.coalesce("first", F.lit(False)))
    text = F.trim(get("version", "string"))
    version = F.when((F.length(text) <= 128) & text.rlike(VERSION), text)
    flag = {c: F.coalesce(get(c, "boolean"), F.lit(False)) for c in ("link", "dev", "optional", "devOptional", "peer")}
    rows = rows.select("file", "raw", "path", "name", version.alias("version"), flag["link"].alias("link"), (flag["dev"] | flag["devOptional"]).alias("dev"), (flag["optional"] | flag["devOptional"]).alias("optional"), flag["peer"].alias("peer"), "record", "valid")
    node = F.col("valid") & F.col("name").isNotNull() & ~F.col("link") & F.col("version").isNotNull()
    ident = F.concat(F.lit("npm:"), "name", F.lit("@"), "version", F.lit(":"), F.substring(F.sha2("path", 256), 1, 12))
    return rows.withColumn("node", node).withColumn("id", F.when(F.col("node"), ident))


def declarations(records: DataFrame) -> DataFrame:
    """file, path, source, wanted, kind of what the root, workspaces and installed packages ask for.

    Optional comes before runtime, dev and peer where a name is in several lists.
    """
    keys = lambda f: F.coalesce(F.map_keys(F.expr(f"try_variant_get(record, '$.{f}', 'map<string, variant>')")), F.array().cast("array<string>"))
    optional = keys("optionalDependencies")
    runtime = F.array_except(keys("dependencies"), optional)
    dev = F.array_except(keys("devDependencies"), F.concat(optional, runtime))
    peer = F.array_except(keys("peerDependencies"), F.concat(optional, runtime, dev))
    meta = F.expr("try_variant_get(record, '$.peerDependenciesMeta', 'map<string, variant>')")
    said = F.filter(F.coalesce(F.map_entries(meta), F.array().cast("array<struct<key:string,value:variant>>")), lambda e: F.coalesce(F.try_variant_get(e["value"], "$.optional", "boolean"), F.lit(False)))
    soft = F.array_intersect(peer, F.transform(said, lambda e: e["key"]))
    tagged = []
    for names, kind in ((optional, "optional"), (runtime, "runtime"), (dev, "dev"), (F.array_except(peer, soft), "peer"), (soft, "optional-peer")):
        tagged.append(_tagged(names, kind))
    sources = records.where(F.col("valid") & (F.col("name").isNull() | F.col("node")))
    out = sources.select("file", "path", F.coalesce("id", F.lit("(root)")).alias("source"), F.explode(F.concat(*tagged)).alias("d")).select("file", "path", "source", "d.wanted", "d.kind")
    return out.where((F.length("wanted") <= 256) & F.col("wanted").rlike(NAME))


def _tagged(names: Column, kind: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("wanted"), F.lit(kind).alias("kind")))


def resolved(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """The declarations with target (id) and state: external, local (a link), missing (optional ones) or unresolved."""
    parts = F.split("path", "/node_modules/")
    above = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/node_modules/"))
    above = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))
    tried = wanted.select("file", "path", "source", "wanted", "kind", F.posexplode(above).alias("up", "folder"))
    tried = tried.withColumn("at", F.concat(F.when(F.col("folder") != "", F.concat("folder", F.lit("/"))).otherwise(""), F.lit("node_modules/"), "wanted"))
    there = records.where("valid").select("file", F.col("path").alias("at"), "id", "link")
    near = tried.join(there, ["file", "at"]).groupBy("file", "path", "wanted").agg(F.min_by(F.struct("id", "link"), "up").alias("r"))
    out = wanted.join(near, ["file", "path", "wanted"], "left")
    state = F.when(F.col("r.link"), "local").when(F.col("r.id").isNotNull(), "external").when(F.col("kind").isin("optional", "optional-peer"), "missing").otherwise("unresolved")
    return out.select("file", "path", "source", "wanted", "kind", F.when(~F.col("r.link"), F.col("r.id")).alias("target"), state.alias("state"))


def lock_graph(locks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) of lock files (file, text); `file` is one lock file each.

    nodes: file, id, name, version, direct, dev, optional, peer. edges: file, source, target, kind; the source is (root) for the root and workspaces. summary: file, state (complete,
    partial, unsupported), reasons, and counts of declarations. Text that is no JSON, or null, is unsupported.
    """
    scratch = Scratch(locks.sparkSession, "locks")
    records = scratch.write(lock_records(locks), "records")
    found = scratch.write(resolved(declarations(records), records), "resolved")
    edges = found.where("state = 'external' and source <> target").select("file", "source", "target", "kind").distinct()
    direct = edges.where("source = '(root)'").select("file", F.col("target").alias("id"), F.lit(True).alias("is_direct")).distinct()
    nodes = records.where("node").select("file", "id", "name", "version", "dev", "optional", "peer").join(direct, ["file", "id"], "left")
    nodes = nodes.select("file", "id", "name", "version", F.coalesce("is_direct", F.lit(False)).alias("direct"), "dev", "optional", "peer")
    counted = lambda state: F.sum((F.col("state") == state).cast("long")).alias(state)
    asked = found.groupBy("file").agg(F.count("*").alias("total"), counted("external"), counted("local"), counted("missing"), counted("unresolved"))
    odd = records.groupBy("file").agg(F.sum((~F.col("valid")).cast("long")).alias("invalid"), F.sum((F.col("valid") & F.col("name").isNotNull() & ~F.col("link") & F.col("version").isNull()).cast("long")).alias("unversioned"))
    out = locks.select("file").distinct().join(odd, "file", "left").join(asked, "file", "left")
    reasons = F.array_compact(F.array(F.when(F.col("invalid") > 0, "invalid-records"), F.when(F.col("unversioned") > 0, "invalid-versions"), F.when(F.col("unresolved") > 0, "unresolved-dependencies"), F.when(F.col("invalid").isNull(), "lock-v2-or-v3-required")))
    state = F.when(F.col("invalid").isNull(), "unsupported").when(F.size("reasons") > 0, "partial").otherwise("complete")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "external", "local", "missing", "unresolved")]
    return nodes, edges, out.withColumn("reasons", reasons).select("file", state.alias("state"), F.array_join("reasons", ",").alias("reasons"), *zero)
