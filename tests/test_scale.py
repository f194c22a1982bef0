"""Operators whose work must grow with their input and not with pairs: results against enumeration, and inputs that the pairs would end."""

import os
import random
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from orrery.operators import evidence, ranges, resolve, rollup, rules
from orrery.plans import CORE_QUERIES


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


DATA = "/root/testdata/sf0.001"


def shuffles(spark, name):
    """How often a query shuffles if it may broadcast nothing of its own accord."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        return CORE_QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(key, before)


@contextmanager
def within(spark, seconds):
    """Jobs that still run after so many seconds are cancelled, and the test fails."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_cover_has_each_line_once(spark):
    spans = [(lo, hi) for lo in range(-9, 10) for hi in range(lo, 10)]
    df = spark.createDataFrame([(i, lo, hi, x) for i, (lo, hi) in enumerate(spans) for x in range(-12, 13)], "i int, lo long, hi long, x long")
    met = F.size(F.array_intersect(ranges.cover(F.col("lo"), F.col("hi")), ranges.above(F.col("x"), F.lit(6))))
    assert df.where(met != F.col("x").between(F.col("lo"), F.col("hi")).cast("int")).count() == 0
    ends = spark.createDataFrame([(0, 2**63 - 1), (-(2**63), 2**63 - 1), (5, 5)], "lo long, hi long").select(F.size(ranges.cover(F.col("lo"), F.col("hi"))).alias("n"))
    assert sorted(r["n"] for r in ends.collect()) == [1, 2, 4]


def _ranges(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lo = r.randrange(-20, 60)
        out.append((r.choice("fg"), i, lo, lo + r.choice([-1, 0, 1, 3, 9, 40])))
    return [*out, ("f", n, 3, 2**40)]


def test_innermost_against_enumeration_with_a_range_to_the_end_of_file(spark):
    held = _ranges(1, 60)
    points = [(p, f, line) for p, (f, line) in enumerate((f, line) for f in "fgh" for line in range(-25, 70))] + [(900, "f", 2**39), (0, "g", 5)]
    want = {}
    for p, f, line in points:
        for g, i, lo, hi in held:
            if f == g and lo <= line <= hi:
                want[p] = min(want.get(p, (2**60, 0, 0)), (-lo, hi, i))
    got = ranges.innermost(spark.createDataFrame(points, "point long, file string, line long"), spark.createDataFrame(held, "file string, id long, lo long, hi long"))
    assert rows(got, "point", "symbol") == sorted((p, m[2]) for p, m in want.items())
    none = spark.createDataFrame([], "file string, id long, lo long, hi long")
    assert ranges.innermost(spark.createDataFrame(points, "point long, file string, line long"), none).count() == 0


def test_schema_references_meet_objects_of_several_names_once(spark):
    refs = spark.createDataFrame([(1, "f", 5, "a"), (2, "f", 5, "b"), (3, "f", 90, "a"), (4, "g", 1, "c"), (5, "g", 1, "none")], "point long, file string, line long, name string")
    objects = spark.createDataFrame([(7, "a"), (7, "b"), (7, "b"), (8, "c"), (9, "a"), (1, "a")], "id long, name string")
    symbols = spark.createDataFrame([("f", 1, 1, 9), ("f", 2, 90, 2**40)], "file string, id long, lo long, hi long")
    got = evidence.schema_references(refs, objects, symbols)
    assert rows(got, "source", "target") == [("1", "7"), ("1", "9"), ("2", "1"), ("2", "7"), ("2", "9"), ("g", "8")]


def test_hunk_symbols_against_enumeration_with_a_range_to_the_end_of_file(spark):
    held, r = _ranges(2, 60), random.Random(3)
    hunks = [(h, r.choice("fgh"), x := r.randrange(-25, 70), x + r.choice([-1, 0, 1, 5, 33]), r.choice([None, 0, 1, 2])) for h in range(300)]
    hunks += [(900, "f", 2**39, 2**39 + 1, 1), (0, "f", 5, 6, 1), (0, "f", 5, 6, 2)]  # hunk 0 is given with several mentions
    want = {}
    for h, f, a, b, key in hunks:
        for g, i, lo, hi in held:
            if f == g and a <= b and lo <= hi and a <= hi and lo <= b:
                want[h] = min(want.get(h, (True, 2**60, 0)), (key is None or i % 3 != key, hi - lo, i))
    h = spark.createDataFrame(hunks, "hunk long, file string, `from` long, `to` long, key int")
    got = ranges.hunk_symbols(h, spark.createDataFrame(held, "file string, id long, lo long, hi long"), (F.col("key"), F.col("id") % 3))
    assert rows(got, "hunk", "symbol") == sorted((h, m[2]) for h, m in want.items())


def test_handlers_against_enumeration(spark):
    r = random.Random(4)
    side = lambda n: [(i, r.choice("xyz"), r.choice(["f", "g", None]), r.choice(["d", "e", None]), r.choice([None, *range(0, 90, 7)])) for i in range(n)]
    ends, held = [*side(80), (0, "x", "f", "e", 5)], [*side(25), (7, "y", "f", "d", 1)]  # endpoint 0 and symbol 7 are given twice
    imported = [(r.choice(["f", "g", None]), r.randrange(30)) for _ in range(20)]
    want = {}
    for e, name, f, d, line in ends:
        for i, other, f2, d2, l2 in held:
            if name == other:
                same = f is not None and f == f2
                score = 100 * same + 40 * (d is not None and d == d2) + 35 * (f is not None and (f, i) in imported) + 20 * (same and None not in (line, l2) and abs(line - l2) <= 20)
                want.setdefault(e, {}).setdefault(score, []).append(i)
    best = {e: (max(by), by[max(by)]) for e, by in want.items()}
    cols = "name string, file string, folder string, line int"
    got = resolve.handlers(spark.createDataFrame(ends, f"endpoint long, {cols}"), spark.createDataFrame(held, f"id long, {cols}"), spark.createDataFrame(imported, "file string, id long"))
    assert rows(got.fillna(-1), "endpoint", "handler", "score", "state") == sorted((e, ids[0] if len(ids) == 1 else -1, k, "resolved" if len(ids) == 1 else "ambiguous") for e, (k, ids) in best.items())


def test_handlers_do_not_meet_namesakes_one_by_one(spark):
    many = spark.range(250_000).select(F.col("id").alias("endpoint"), F.lit("x").alias("name"), F.lit("f").alias("file"), F.lit("d").alias("folder"), (F.col("id") % 9000).cast("int").alias("line"))
    got = resolve.handlers(many, many.withColumnRenamed("endpoint", "id"), many.select("file", F.col("endpoint").alias("id")))
    with within(spark, 60):
        assert rows(got.groupBy("score", "state").count(), "score", "state", "count") == [(195, "ambiguous", 250_000)]


def test_reexports_against_enumeration_and_stars_are_read_once(spark):
    r = random.Random(5)
    own = {(f"m{r.randrange(14)}", r.choice(["x", "y", "default"])) for _ in range(16)}
    star = {(f"m{r.randrange(14)}", f"m{r.randrange(14)}") for _ in range(22)}
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        read.add(1)
        return x

    mine = spark.createDataFrame(sorted(own), "module string, name string")
    stars = spark.createDataFrame(sorted(star), "`module` string, `from` string").withColumn("from", seen("from"))
    for depth in (2, None):
        found, front, k = {(m, n, m) for m, n in own}, {(m, n, m) for m, n in own}, 0
        while front and (depth is None or k < depth):
            k += 1
            front = {(m, n, o) for f, n, o in front if n != "default" for m, g in star if f == g and (m, n) not in own} - found
            found |= front
        want = {}
        for m, n, o in found:
            want.setdefault((m, n), []).append(o)
        got = rows(resolve.reexports(mine, stars, depth).fillna(""), "module", "name", "origin", "state")
        assert got == sorted((m, n, *((os[0], "resolved") if len(os) == 1 else ("", "ambiguous"))) for (m, n), os in want.items())
        assert {x[3] for x in got} == {"resolved", "ambiguous"}
    assert read.value == 2 * len(star)


def _graph(seed):
    r = random.Random(seed)
    nodes = [(f"n{i}", f"{r.choice('ab')}/{r.choice('xy')}/{i // r.choice([1, 4])}") for i in range(24)]
    edges = [(f"n{r.randrange(26)}", f"n{r.randrange(26)}", r.choice(["calls", "imports", "contains"]), r.random() < 0.3, r.random() < 0.3, r.random() < 0.2) for _ in range(150)]
    return nodes, edges


def test_fitness_against_enumeration_with_files_of_several_nodes(spark):
    nodes, edges = _graph(6)
    file, module = dict(nodes), lambda f: f.rsplit("/", 1)[0]
    want = {}
    for a, b in {(file[e[0]], file[e[1]]) for e in edges if e[0] in file and e[1] in file}:
        for m in {module(a), module(b)}:
            want.setdefault(m, [0, 0])[module(a) != module(b)] += 1
    e = spark.createDataFrame([x[:2] for x in edges], "source string, target string")
    got = rules.fitness(e, spark.createDataFrame(nodes, "id string, file string"))
    assert rows(got, "module", "internal", "boundary") == sorted((m, *c) for m, c in want.items())
    assert len({f for _, f in nodes}) < len(nodes) and any(0 not in c for c in want.values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_fitness_shuffles_edges_by_source_and_by_target_only(spark):
    # 8 for the graph's edges, 4 for the nodes on both sides, 2 for the edges, 3 for counts of modules
    assert shuffles(spark, "rules_fitness") <= 17


@pytest.mark.parametrize("alone", [False, True])
def test_file_edges_against_enumeration_with_and_without_files_of_several_nodes(spark, alone):
    nodes, edges = _graph(7)
    nodes = [(i, f"{f}/{i}") for i, f in nodes] if alone else nodes
    file, want = dict(nodes), {}
    for a, b, relation, t, c, proxy in edges:
        if a in file and b in file and relation != "contains" and not proxy and file[a] != file[b]:
            by = want.setdefault((file[a], file[b], "type" if t else "compile" if c else "runtime"), {})
            by[relation] = by.get(relation, 0) + 1
    cols = "source string, target string, relation string, type_only boolean, compile_only boolean, barrel_proxy boolean"
    got = rollup.file_edges(spark.createDataFrame(edges, cols), spark.createDataFrame(nodes, "id string, file string"))
    assert rows(got, "from_file", "to_file", "edge_class", "n", "relation") == sorted((*k, sum(by.values()), min(by, key=lambda r: (-by[r], r))) for k, by in want.items())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_file_edges_shuffle_edges_by_source_and_by_target_only(spark):
    # 8 for the graph's edges, 2 for the nodes on both sides, 2 for the edges
    assert shuffles(spark, "rollup_file_edges") <= 12
