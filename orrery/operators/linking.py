"""Linking the facts of source files (S4, J1, J3, J4): specifiers to files, exports to origins, calls to symbols.

Everything is an equi-join on (file, name) or (file, specifier); repeated uses are made distinct before they are linked and joined back after it.
Ambiguity is a state of its own: a name with several origins links to none of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.rules import top_per
from orrery.store import Scratch

#: What a specifier may lack, in the order in which it is tried.
ENDINGS = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".json", "/index.js", "/index.ts", "/index.jsx", "/index.tsx"]
#: Endings of files that are no code.
ASSETS = r"(?i)\.(svg|png|jpe?g|gif|webp|avif|ico|bmp|woff2?|ttf|eot|otf|mp[34]|webm|wasm|pdf|txt|md|html?)$"


def folder_of(file: Column) -> Column:
    return F.regexp_replace(F.when(file.contains("/"), file).otherwise(F.lit("")), "/[^/]*$", "")


def normalised(path: Column) -> Column:
    """A path without empty, `.` and `..` parts; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(s, p):
        up, size = p == "..", F.size(s["at"])
        at = F.when(up, F.slice(s["at"], 1, F.greatest(size - 1, F.lit(0)))).otherwise(F.concat(s["at"], F.array(p)))
        return F.struct(at.alias("at"), (s["out"] | (up & (size == 0))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: F.when(~s["out"], F.array_join(s["at"], "/")))


def package_of(spec: Column) -> Column:
    """The package of a bare specifier: two parts for a scope, else one; null for relative and absolute ones and for those without a name."""
    parts = F.split(spec, "/")
    name = F.when(spec.startswith("@") & (F.size(parts) > 1), F.concat_ws("/", parts[0], parts[1])).when(~spec.startswith("@"), parts[0])
    return F.when(~spec.rlike(r"^[./]") & (spec != ""), F.regexp_replace(name, "^node:", ""))


def modules(uses: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """file, spec, target, state of every distinct (file, spec): a file, `package`, `asset` or `unresolved`.

    A relative specifier starts at its file's folder, one that begins with an alias (the longest wins) at the alias's folder; endings are tried
    in order, first with and then without a query. What is neither is a package. Null specifiers are left out.
    """
    spec = F.col("spec")
    base = F.when(spec.startswith("."), F.concat(folder_of(F.col("file")), F.lit("/"), spec))
    for alias in sorted(aliases or {}, key=lambda a: (-len(a), a)):
        base = F.coalesce(base, F.when(spec.startswith(alias), F.concat(F.lit(aliases[alias]), F.expr(f"substring(spec, {len(alias) + 1})"))))
    one = uses.select("file", "spec").where("spec is not null").distinct().withColumn("base", base)
    paths = F.array(normalised(F.col("base")), F.when(F.col("base").contains("?"), normalised(F.regexp_replace("base", r"\?.*$", ""))))
    tried = one.select("file", "spec", F.posexplode(paths).alias("turn", "path")).where("path is not null")
    tried = tried.select("file", "spec", "turn", F.posexplode(F.transform(F.array(*[F.lit(e) for e in ENDINGS]), lambda e: F.concat("path", e))).alias("rank", "target"))
    met = tried.join(files.select(F.col("file").alias("target")).where("target is not null").distinct(), "target")
    best = met.groupBy("file", "spec").agg(F.min(F.struct("turn", "rank", "target")).alias("b")).select("file", "spec", F.col("b.target").alias("target"))
    state = F.when(F.col("target").isNotNull(), "file").when(F.col("base").isNull(), "package").when(F.regexp_replace("spec", r"\?.*$", "").rlike(ASSETS), "asset").otherwise("unresolved")
    return one.join(best, ["file", "spec"], "left").select("file", "spec", "target", state.alias("state"))


def origins(exports: DataFrame, bindings: DataFrame, bound: int = 10_000) -> DataFrame:
    """module, name, origin, origin_name, state of every exported name, through barrels of any depth.

    exports: module, name, kind (local, named, star, namespace, member), imported, target; bindings: module, name, imported, target.
    A local export of an imported name passes on like a named one. An own name shadows a star's, `default` passes no star, cycles end, and
    several origins are `ambiguous`. A member of a default object is exported as `default.member`. Names no origin of which is known are not in the result.
    """
    scratch = Scratch(exports.sparkSession, "origins")
    own = exports.where("kind <> 'star'").select("module", F.when(F.col("kind") == "member", F.concat(F.lit("default."), "name")).otherwise(F.col("name")).alias("name"), "kind", "imported", "target")
    bound_to = bindings.where("imported <> '*' and target is not null").select("module", F.col("name").alias("imported"), F.col("imported").alias("theirs"), F.col("target").alias("from"))
    local = own.where("kind in ('local', 'member')").drop("target").join(bound_to.distinct(), ["module", "imported"], "left")
    forward = own.where("kind = 'named' and target is not null").select("module", "name", F.col("target").alias("from"), F.col("imported").alias("theirs"))
    forward = scratch.write(forward.unionByName(local.where("from is not null").select("module", "name", "from", "theirs")).distinct(), "forward")
    stars = scratch.write(exports.where("kind = 'star' and target is not null").select("module", F.col("target").alias("from")).distinct(), "stars")
    shadow = scratch.write(own.select("module", "name").distinct(), "shadow")
    here = local.where("from is null").select("module", "name", F.col("module").alias("origin"), F.col("imported").alias("origin_name"))
    spaces = own.where("kind = 'namespace' and target is not null").select("module", "name", F.col("target").alias("origin"), F.lit("*").alias("origin_name"))
    front = scratch.write(here.unionByName(spaces).distinct(), "step-0")
    seen, k = front, 0
    while True:
        k += 1
        if k > bound:
            raise RuntimeError(f"exports still pass names on after {bound} steps")
        known = front.select(F.col("module").alias("from"), F.col("name").alias("theirs"), "origin", "origin_name")
        named = known.join(forward, ["from", "theirs"]).select("module", "name", "origin", "origin_name")
        passed = known.where("theirs <> 'default' and theirs not like 'default.%'").join(stars, "from").select("module", F.col("theirs").alias("name"), "origin", "origin_name")
        more = named.unionByName(passed.join(shadow, ["module", "name"], "left_anti")).distinct().join(seen, ["module", "name", "origin", "origin_name"], "left_anti")
        front = scratch.write(more, f"step-{k}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    one = seen.groupBy("module", "name").agg(F.count("*").alias("n"), F.min(F.struct("origin", "origin_name")).alias("o"))
    single = F.col("n") == 1
    return one.select("module", "name", F.when(single, F.col("o.origin")).alias("origin"), F.when(single, F.col("o.origin_name")).alias("origin_name"), F.when(single, "resolved").otherwise("ambiguous").alias("state"))


def named_symbols(symbols: DataFrame, space: str = "value") -> DataFrame:
    """file, name, id: the symbol a name means in a space: one of that space first, then one of both, by line. symbols: file, name, line, space, id."""
    fit = symbols.where(F.col("space").isin(space, "both")).withColumn("far", (F.col("space") != space).cast("int"))
    return top_per(fit, ["file", "name"], ["far", "line", "id"], 1).select("file", "name", "id")


def symbols_of(facts: DataFrame) -> DataFrame:
    """file, name, kind, space, owner, line, end_line, exported, top, id (file#name@line, with `:type` for type space) of the symbol facts."""
    f = facts.where("fact = 'symbol'")
    ident = F.concat("file", F.lit("#"), "name", F.lit("@"), F.col("line"), F.when(F.col("imported") == "type", ":type").otherwise(""))
    return f.select("file", "name", "kind", F.col("imported").alias("space"), "owner", "line", "end_line", "exported", "top", ident.alias("id"))


def file_imports(facts: DataFrame, found: DataFrame) -> DataFrame:
    """file, target, relation (imports, re_exports, dynamic), line, type_only, spec, state of every import fact; `found` as `modules` gives it."""
    imports = facts.where("fact = 'import' and spec is not null").select("file", "spec", "kind", "line", "type_only").join(found, ["file", "spec"])
    relation = F.when(F.col("kind") == "reexport", "re_exports").when(F.col("kind") == "dynamic", "dynamic").otherwise("imports")
    return imports.select("file", "target", relation.alias("relation"), "line", "type_only", "spec", "state")


def bindings_of(facts: DataFrame, found: DataFrame) -> DataFrame:
    """file, name, imported, target, type_only of imported names; the last binding of a name holds."""
    at = found.select("file", "spec", "target").where("target is not null")
    bound = facts.where("fact = 'binding'").select("file", "spec", "name", "imported", "type_only", "line").join(at, ["file", "spec"])
    return top_per(bound, ["file", "name"], [F.desc("line"), F.desc("spec"), F.desc("imported")], 1).select("file", "name", "imported", "target", "type_only")


def exports_of(facts: DataFrame, found: DataFrame) -> DataFrame:
    """module, name, kind, imported, target, type_only of export facts."""
    at = found.select("file", "spec", "target").where("target is not null")
    return facts.where("fact = 'export'").select("file", "spec", "name", "kind", "imported", "type_only").join(at, ["file", "spec"], "left").drop("spec").withColumnRenamed("file", "module")


def specs_of(facts: DataFrame) -> DataFrame:
    return facts.where("spec is not null and fact in ('import', 'binding', 'export')").select("file", "spec")


def link_calls(facts: DataFrame, bound: DataFrame, source: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, line, caller, relation, name, owner, target, layer, state of the calls, JSX uses and base classes in `facts`.

    A call means, in this order, a symbol of its own file; the origin of what its name is bound to, through barrels; the symbol of that name in
    the file it is imported from. A member call means a member of a namespace or default import; others are left out. Layer: own, import, barrel; state: resolved,
    ambiguous, missing. bound, source, symbols: as `bindings_of`, `origins`, `symbols_of` give them; they are read several times.
    """
    source = source.select(F.col("module").alias("from"), F.col("name").alias("wanted"), "origin", "origin_name", F.col("state").alias("passed"))
    value = named_symbols(symbols)
    direct = symbols.where("exported and space <> 'type'").select(F.col("file").alias("from"), F.col("name").alias("wanted"), F.lit(True).alias("open")).distinct()
    calls = facts.where("fact in ('call', 'base')").select("file", "line", "caller", "name", "kind", "owner")
    need = calls.select("file", "name", "kind", "owner").distinct()
    plain = need.where("kind in ('call', 'inherits', 'jsx') and owner is null").join(value.select("file", "name", F.col("id").alias("own")), ["file", "name"], "left")
    plain = plain.withColumn("own", F.when(F.col("kind") != "jsx", F.col("own"))).join(bound, ["file", "name"], "left").withColumn("wanted", F.col("imported"))
    spaces = bound.where("imported in ('*', 'default') and not type_only").withColumnRenamed("name", "owner")
    member = need.where("owner is not null").join(spaces, ["file", "owner"]).withColumn("own", F.lit(None).cast("string"))
    member = member.withColumn("wanted", F.when(F.col("imported") == "*", F.col("name")).otherwise(F.concat(F.lit("default."), "name")))
    every = plain.unionByName(member).withColumn("from", F.when(F.col("own").isNull(), F.col("target"))).drop("target")
    every = every.join(source, ["from", "wanted"], "left").join(direct, ["from", "wanted"], "left")
    # A name without an export record is looked up in the imported file itself; a member only if the file exports it some other way.
    plainly = F.col("passed").isNull() & (F.col("owner").isNull() | F.col("open"))
    every = every.withColumn("file_of", F.when(F.col("passed") == "resolved", F.col("origin")).when(plainly, F.col("from")))
    every = every.withColumn("name_of", F.when(F.col("passed") == "resolved", F.col("origin_name")).when(plainly, F.col("wanted")))
    every = every.join(value.select(F.col("file").alias("file_of"), F.col("name").alias("name_of"), F.col("id").alias("far")), ["file_of", "name_of"], "left")
    layer = F.when(F.col("own").isNotNull(), "own").when(F.col("far").isNotNull() & (F.col("file_of") == F.col("from")), "import").when(F.col("far").isNotNull(), "barrel")
    state = F.when(F.coalesce("own", "far").isNotNull(), "resolved").when(F.col("passed") == "ambiguous", "ambiguous").otherwise("missing")
    every = every.select("file", "name", "kind", "owner", F.coalesce("own", "far").alias("target"), layer.alias("layer"), state.alias("state"))
    every = every.withColumnsRenamed({c: f"_{c}" for c in ("file", "name", "kind", "owner")})
    same = (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")) & (F.col("kind") == F.col("_kind")) & F.col("owner").eqNullSafe(F.col("_owner"))
    relation = F.when(F.col("kind") == "inherits", "inherits").when(F.col("kind") == "jsx", "references").otherwise("calls")
    who = F.when(F.col("caller").isNotNull(), F.concat("file", F.lit("#"), "caller"))
    return calls.join(every, same).select("file", "line", who.alias("caller"), relation.alias("relation"), "name", "owner", "target", "layer", "state")


def link(facts: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(file imports, calls) of extracted facts, all layers in one. `facts` is read several times: give a written table."""
    scratch = Scratch(facts.sparkSession, "link")
    found = scratch.write(modules(specs_of(facts), files, aliases), "modules")
    bound = scratch.write(bindings_of(facts, found), "bindings")
    source = scratch.write(origins(exports_of(facts, found), bound.withColumnRenamed("file", "module")), "origins")
    return file_imports(facts, found), link_calls(facts, bound, source, symbols_of(facts))


def call_edges(calls: DataFrame) -> DataFrame:
    """source, target, relation, line of resolved calls; JSX outside all symbols comes from its file; nothing calls itself."""
    source = F.coalesce("caller", F.when(F.col("relation") == "references", F.col("file")))
    return calls.where("state = 'resolved'").select(source.alias("source"), "target", "relation", "line").where("source is not null and source <> target")


def external_references(uses: DataFrame, bound: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, refs: how often other files use each symbol by a name imported from its file.

    A named import counts each use of its local name; a namespace counts the accesses to each member; a re-export counts one. Type-only imports count for symbols of
    type space, others for those of value space, both for classes and enums. uses: as `javascript.uses` gives them; bound, exports: with targets. Symbols that
    nothing uses are left out.
    """
    total = uses.groupBy("file", "name").agg(F.sum("n").alias("n"))
    named = bound.where("imported not in ('*', 'default')").join(total, ["file", "name"]).select(F.col("target").alias("of"), F.col("imported").alias("wanted"), "type_only", "n")
    spaces = bound.where("imported = '*'").select("file", "name", "target", "type_only")
    member = spaces.join(uses.where("member is not null"), ["file", "name"]).select(F.col("target").alias("of"), F.col("member").alias("wanted"), "type_only", "n")
    passed = exports.where("kind = 'named' and target is not null").select(F.col("target").alias("of"), F.col("imported").alias("wanted"), "type_only", F.lit(1).cast("long").alias("n"))
    sums = named.unionByName(member).unionByName(passed).groupBy("of", "wanted", "type_only").agg(F.sum("n").alias("n"))
    fits = (F.col("space") == "both") | F.when(F.col("type_only"), F.col("space") == "type").otherwise(F.col("space") != "type")
    own = symbols.select(F.col("file").alias("of"), F.col("name").alias("wanted"), "space", "id")
    return sums.join(own, ["of", "wanted"]).where(fits).groupBy("id").agg(F.sum("n").alias("refs"))
