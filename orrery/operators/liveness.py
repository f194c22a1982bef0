"""Reach over files and calls, tests near a file, and verdicts on dead code, twins and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.rules import top_per
from orrery.operators.traverse import layered
from orrery.store import Scratch

#: Severities from least to greatest.
SEVERITY = ["info", "low", "medium", "high", "critical"]


def file_imports(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_file, to_file, kind (G20): imports between different files; `type` where no run-time edge is beside it."""
    own = nodes.select(F.col("id").alias("source"), F.col("file").alias("from_file"))
    other = nodes.select(F.col("id").alias("target"), F.col("file").alias("to_file"))
    met = edges.join(own, "source").join(other, "target").where("from_file <> to_file")
    late = F.col("type_only") | F.col("compile_only")
    return met.groupBy("from_file", "to_file").agg(F.when(F.bool_and(late), "type").otherwise("runtime").alias("kind"))


def file_reach(edges: DataFrame, nodes: DataFrame, entries: DataFrame, depth: int = 1000) -> DataFrame:
    """file of all that entries reach over links other than contains (G8). entries: id (a file). Raises where a chain is longer than depth."""
    files = file_imports(edges.where("relation <> 'contains'"), nodes).select(F.col("from_file").alias("source"), F.col("to_file").alias("target"))
    return layered(files, entries, depth, whole=True).select(F.col("id").alias("file"))


def nearest_tests(edges: DataFrame, tests: DataFrame, depth: int = 10, keep: int = 3, most_tests: int = 250) -> DataFrame:
    """file, test, distance, score (G12, W6): the nearest tests of every file, ties by score, then test.

    edges: source, target, confidence. A path's score is its least confidence, a pair's the best of its shortest paths.
    The walk starts at the first `most_tests` tests, a limit of the operator.
    """
    scratch = Scratch(edges.sparkSession, "tests")
    steps = scratch.write(edges.groupBy("source", "target").agg(F.max("confidence").alias("confidence")).where("source <> target"), "steps")
    start = tests.select("id").distinct().orderBy("id").limit(most_tests)
    front = scratch.write(start.select(F.col("id").alias("test"), F.col("id").alias("file"), F.lit(0).alias("distance"), F.lit(3).alias("score")), "layer-0")
    seen = front
    for d in range(1, depth + 1):
        on = front.withColumnRenamed("file", "source").join(steps, "source").groupBy("test", F.col("target").alias("file")).agg(F.max(F.least("score", "confidence")).alias("score"))
        front = scratch.write(on.join(seen, ["test", "file"], "left_anti").select("test", "file", F.lit(d).alias("distance"), "score"), f"layer-{d}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    near = top_per(seen.where("distance > 0"), ["file"], ["distance", F.desc("score"), "test"], keep)
    return near.select("file", "test", "distance", "score")


def call_trace(calls: DataFrame, root: str, depth: int = 4, callees: int = 6, most: int = 40) -> DataFrame:
    """depth, id (G13): calls from one handler, at most `callees` of a node by line then id, `most` nodes in all."""
    first = calls.where("source <> target and not type_only and not compile_only").groupBy("source", "target").agg(F.min("line").alias("line"))
    few = top_per(first, ["source"], ["line", "target"], callees).select("source", "target")
    seen = layered(few, calls.sparkSession.createDataFrame([(root,)], "id string"), depth)
    return seen.orderBy("depth", "id").limit(most).select("depth", "id")


def mount_paths(mounts: DataFrame, routes: DataFrame, depth: int = 32) -> DataFrame:
    """router, path (G15): the prefixes of every chain of mounts put together, before the routes of the router.

    mounts: parent, child, prefix; routes: router, path. A router without a parent starts with nothing; chains longer than `depth` end (cycles).
    """
    scratch = Scratch(mounts.sparkSession, "mounts")
    tops = routes.select(F.col("router")).union(mounts.select("parent")).distinct().join(mounts.select(F.col("child").alias("router")), "router", "left_anti")
    front = scratch.write(tops.withColumn("prefix", F.lit("")), "step-0")
    every = front
    for d in range(1, depth + 1):
        on = front.select(F.col("router").alias("parent"), F.col("prefix").alias("before")).join(mounts, "parent")
        front = scratch.write(on.select(F.col("child").alias("router"), F.concat("before", "prefix").alias("prefix")).distinct(), f"step-{d}")
        if not front.limit(1).count():
            break
        every = every.unionByName(front)
    return every.distinct().join(routes, "router").select("router", F.concat("prefix", "path").alias("path")).distinct()


def cycle_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """component, state (D6): cycles of the new graph or the old, equal ones left out; `changed` shares two members or more.

    old, new: id, component.
    """
    o, n = old.select("id", F.col("component").alias("o")), new.select("id", F.col("component").alias("n"))
    both = o.join(n, "id").groupBy("o", "n").agg(F.count("*").alias("shared"))
    both = both.join(o.groupBy("o").agg(F.count("*").alias("no")), "o").join(n.groupBy("n").agg(F.count("*").alias("nn")), "n")
    same, changed = both.where("shared = no and shared = nn"), both.where("shared >= 2 and (shared < no or shared < nn)")
    parts = [changed.select(F.col("n").alias("component"), F.lit("changed").alias("state")).distinct()]
    for side, key, state in ((n, "n", "introduced"), (o, "o", "resolved")):
        rest = side.select(key).distinct().join(same.select(key), key, "left_anti").join(changed.select(key), key, "left_anti")
        parts.append(rest.select(F.col(key).alias("component"), F.lit(state).alias("state")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def symbol_liveness(symbols: DataFrame, uses: DataFrame, frequency: DataFrame) -> DataFrame:
    """id, file, n_inbound, dead, test_only.

    symbols: id, file, name, is_exported, is_special; uses: target, from_test; frequency: name, n (occurrences in all files).
    Dead: no use, no more than one occurrence of an identifier-like name, not special. Test-only: used, and only by tests.
    """
    own = uses.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.count_if(~F.col("from_test")).alias("product"))
    out = symbols.join(own, "id", "left").join(frequency.withColumnRenamed("n", "seen"), "name", "left")
    n = F.coalesce("n", F.lit(0))
    named = F.col("name").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$") & ~F.col("name").rlike("^__.*__$")
    dead = (n == 0) & named & ~F.col("is_special") & (F.coalesce("seen", F.lit(0)) <= 1)
    return out.select("id", "file", "name", "is_exported", n.alias("n_inbound"), F.coalesce(dead, F.lit(False)).alias("dead"), ((n > 0) & (F.col("product") == 0)).alias("test_only"))


def dead_files(live: DataFrame, entries: DataFrame) -> DataFrame:
    """file, n_symbols of files whose symbols are all dead and that are no entry (R8); live: as of symbol_liveness."""
    full = live.groupBy("file").agg(F.count("*").alias("n_symbols"), F.bool_and("dead").alias("dead"), F.sum("n_inbound").alias("n_in"))
    return full.where("dead and n_in = 0").join(entries, "file", "left_anti").select("file", "n_symbols")


def unused_exports(live: DataFrame, words: DataFrame) -> DataFrame:
    """id of exported symbols without a use whose name is a word of no other file (R9); words: file, name."""
    spread = words.distinct().groupBy("name").agg(F.min("file").alias("lo"), F.max("file").alias("hi"))
    out = live.where("is_exported and n_inbound = 0").join(spread, "name", "left")
    return out.where("(lo is null or lo = file) and (hi is null or hi = file)").select("id")


def first_gate(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that stops a row, else `kept` (F16): gates are asked in order."""
    out = F.lit("kept")
    for name, stops in reversed(gates):
        out = F.when(stops, name).otherwise(out)
    return out


def audit_filter(findings: DataFrame, least: str, categories: list[str]) -> DataFrame:
    """Findings with no path or any path outside the classes, of `least` severity or more, of a category.

    findings: paths (array), classified (array of boolean), severity, category.
    """
    open_path = F.coalesce(F.size("paths"), F.lit(0)).__le__(0) | F.exists("classified", lambda c: ~c)
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    return findings.where(open_path & (rank >= SEVERITY.index(least) + 1) & F.col("category").isin(categories))


def external_use(uses: DataFrame, key: str = "id") -> DataFrame:
    """key, verdict (A23): any use of high or medium confidence NOT_DEAD, any low POSSIBLE, else UNKNOWN."""
    sure, some = F.bool_or(F.col("confidence").isin("high", "medium")), F.bool_or(F.col("confidence") == "low")
    return uses.groupBy(key).agg(F.when(sure, "NOT_DEAD").when(some, "POSSIBLE").otherwise("UNKNOWN").alias("verdict"))


def dead_code_confidence(internal: Column, no_reference: Column, is_open: Column, is_file: Column) -> Column:
    """high, medium or low (R10): high only for an internal symbol exactly without references; a file has medium at most."""
    return F.when(is_open, "low").when(internal & no_reference & ~is_file, "high").otherwise("medium")


def lowered_severity(severity: Column, direct: Column) -> Column:
    """A vulnerability's severity, one level lower unless a product file imports the package itself."""
    steps = F.array(*map(F.lit, SEVERITY))
    at = F.greatest(F.array_position(steps, severity) - 1, F.lit(1)).cast("int")
    return F.when(direct, severity).otherwise(F.element_at(steps, at))


def change_verdict(blocked: Column, unknown: Column) -> Column:
    """BLOCKED, UNKNOWN or PASS of a group (R19), from two conditions of its rows."""
    return F.when(F.bool_or(blocked), "BLOCKED").when(F.bool_or(unknown), "UNKNOWN").otherwise("PASS")


def section_verdict(findings: Column, complete: Column) -> Column:
    """FAIL with any finding, PASS only where the section is complete, else UNKNOWN."""
    return F.when(findings > 0, "FAIL").when(complete, "PASS").otherwise("UNKNOWN")


def twin_verdicts(pairs: DataFrame, clone: int = 85, collision: int = 45) -> DataFrame:
    """name, closest, farthest, verdict (R22); pairs: name, similarity (percent)."""
    ends = pairs.groupBy("name").agg(F.max("similarity").alias("closest"), F.min("similarity").alias("farthest"))
    return ends.withColumn("verdict", F.when(F.col("closest") >= clone, "clone").when(F.col("farthest") <= collision, "collision").otherwise("review"))


def divergence(pairs: DataFrame, ceiling: int = 60) -> DataFrame:
    """name, a, b, similarity (R26): of each name the least similar pair below a ceiling, ties by ids."""
    low = pairs.where(F.col("similarity") < ceiling).groupBy("name").agg(F.min(F.struct("similarity", "a", "b")).alias("p"))
    return low.select("name", "p.a", "p.b", "p.similarity")


def component_directions(pairs: DataFrame, top: int = 100, samples: int = 3) -> DataFrame:
    """from_module, to_module, n_pairs, samples, state (A39): observed directions as proposed rules, most file pairs first."""
    key = ["from_module", "to_module"]
    files = pairs.select(*key, "from_file", "to_file").distinct()
    best = files.groupBy(key).agg(F.count("*").alias("n_pairs")).orderBy(F.desc("n_pairs"), *key).limit(top)
    few = top_per(files.join(best, key, "left_semi"), key, ["from_file", "to_file"], samples)
    shown = few.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(">", "from_file", "to_file"))), ",").alias("samples"))
    return best.join(shown, key).withColumn("state", F.lit("proposed"))


def malware_score(signals: DataFrame, allowed: DataFrame) -> DataFrame:
    """package, n_strong, severity (A36): two distinct strong keys make it high, one medium; weak ones alone are nothing.

    signals: package, key, strong; allowed: package.
    """
    own = signals.join(allowed, "package", "left_anti").groupBy("package").agg(F.countDistinct(F.when(F.col("strong"), F.col("key"))).alias("n_strong"))
    return own.where("n_strong > 0").withColumn("severity", F.when(F.col("n_strong") >= 2, "high").otherwise("medium"))


def precision_targets(edges: DataFrame, top: int = 40) -> DataFrame:
    """id, score (R23): calls 30, inheritance 20, references 10, 8 more where inferred; summed over a target's edges, best first."""
    base = F.when(F.col("relation") == "calls", 30).when(F.col("relation").isin("extends", "implements"), 20).when(F.col("relation") == "references", 10).otherwise(0)
    sums = edges.groupBy(F.col("target").alias("id")).agg(F.sum(base + F.when(F.col("inferred"), 8).otherwise(0)).alias("score"))
    return sums.orderBy(F.desc("score"), "id").limit(top)


def ranked_items(items: DataFrame, top: int = 24) -> DataFrame:
    """item, refs, weight (A41): the most referenced items; weight = round(100 log2(refs + 1))."""
    sums = items.groupBy("item").agg(F.count("*").alias("refs"))
    return sums.orderBy(F.desc("refs"), "item").limit(top).withColumn("weight", F.round(100 * F.log2(F.col("refs") + 1)).cast("long"))


def low_signal(nodes: DataFrame, degree: DataFrame, kinds: list[str], terms: list[str]) -> DataFrame:
    """Nodes without those of a minor kind that have no edge and share no word with the query (F8). nodes: id, label, kind."""
    held = F.lit(False)
    for t in terms:
        held = held | F.contains(F.lower("label"), F.lit(t.lower()))
    out = nodes.join(degree.select("id", "degree"), "id", "left")
    return out.where(~F.col("kind").isin(kinds) | (F.coalesce("degree", F.lit(0)) > 0) | held).select("id")


def technology_rules(used: DataFrame, required: list[str], forbidden: list[str]) -> DataFrame:
    """owner, technology, state (R4): `missing` for a required one that is not used, `forbidden` for a used one that is."""
    have = used.select("owner", "technology").distinct()
    want = have.select("owner").distinct().select("owner", F.explode(F.array(*map(F.lit, required))).alias("technology"))
    missing = want.join(have, ["owner", "technology"], "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(have.where(F.col("technology").isin(forbidden)).withColumn("state", F.lit("forbidden")))


def complexity_rank(depth: Column, sorts: Column) -> Column:
    """Time rank 0, 2, 3, 4, 5 (R12): by loop depth; a sort outside loops is 3."""
    loops = F.when(depth <= 0, 0).when(depth == 1, 2).when(depth == 2, 4).otherwise(5)
    return F.greatest(loops, F.when(sorts > 0, 3).otherwise(0))
