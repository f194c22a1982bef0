"""Behaviours on small literals: roll-ups, reach, components, history, rules, versions, names."""

from pyspark.sql import functions as F

from orrery.functions.paths import glob_regex, path_classes, route, territory
from orrery.operators import clones, compare, components, history, rollup, rules, traverse
from orrery.sources import readers, scan


def edges(spark, rows):
    return spark.createDataFrame([(a, b, r, t, False, p, 1) for a, b, r, t, p in rows], "source string, target string, relation string, type_only boolean, compile_only boolean, barrel_proxy boolean, line int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_paths(spark):
    import re

    assert re.match(glob_regex("a/**/b.js"), "a/b.js") and not re.match(glob_regex("src/*.js"), "src/x/y.js")
    df = spark.createDataFrame([("e2e/a.js",), ("src/x.test.js",), ("lib/a.js",), (None,)], "p string")
    assert [r[0] for r in df.select(path_classes(F.col("p"))).collect()] == [["e2e", "test"], ["test"], [], []]
    assert spark.range(1).select(territory(F.lit("a/b/c.js")), territory(F.lit("x.js")), route(F.lit("http://h/u/12/?q=1"))).first()[:] == ("a/b", "(root)", "/u/:param")


def test_file_edges_take_the_dominant_relation(spark):
    n = spark.createDataFrame([("a", "src/api/a.py", 1), ("b", "src/web/b.py", 1)], "id string, file string, loc int")
    e = edges(spark, [("a", "b", "calls", False, False), ("a", "b", "calls", False, False), ("a", "b", "references", False, False), ("a", "b", "contains", False, False)])
    assert rows(rollup.file_edges(e, n), "edge_class", "n", "relation") == [("runtime", 3, "calls")]


def test_reverse_reach_keeps_both_depths(spark):
    e = edges(spark, [("run", "t", "calls", False, False), ("typ", "t", "calls", True, False), ("grand", "typ", "calls", False, False)])
    got = rows(traverse.reverse_reach(e, spark.createDataFrame([("t",)], "id string"), 3).fillna(-1), "id", "runtime_depth", "compile_depth")
    assert got == [("grand", -1, 2), ("run", 1, -1), ("typ", -1, 1)]


def test_strong_components_agree_on_both_paths(spark):
    e = edges(spark, [("a", "b", "imports", False, False), ("b", "c", "imports", False, False), ("c", "a", "imports", False, False), ("f", "a", "imports", False, False), ("x", "y", "imports", False, False), ("y", "x", "imports", False, False)])
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert rows(traverse.strong_components(e), "id", "component") == want
    assert rows(traverse.strong_components(e, driver_edges=0), "id", "component") == want


def test_connected_components_of_a_long_path(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.connected_components(path)
    assert got.count() == 61 and got.where("component <> 0").count() == 0
    assert components.connected_components(path.limit(0)).count() == 0


def test_connected_components_of_stars_cliques_and_odd_rows(spark):
    star, clique = [(500, i) for i in range(40)], [(600 + i, 600 + j) for i in range(8) for j in range(i)]
    odd = [(None, 1), (700, 700), (3, None), (800, 801), (801, 800), (800, 801)]
    got = components.connected_components(spark.createDataFrame(star + clique + odd, "a long, b long"))
    want = [(i, 0) for i in range(40)] + [(500, 0)] + [(600 + i, 600) for i in range(8)] + [(800, 800), (801, 800)]
    assert rows(got, "id", "component") == want
    named = spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert rows(components.connected_components(named), "id", "component") == [("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")]


def test_shortest_path(spark):
    e = edges(spark, [("a", "b", "calls", False, False), ("c", "b", "calls", False, False), ("c", "d", "calls", False, False)])
    assert rows(traverse.shortest_path(e, "a", "d"), "hop", "id") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert traverse.shortest_path(e, "a", "zz").count() == 0


def test_cochange_metrics(spark):
    c = spark.createDataFrame([(1, "a"), (1, "d"), (2, "a"), (2, "d"), (3, "a"), (4, "b"), (5, "c")], "commit long, file string").selectExpr("*", "1L additions", "0L deletions")
    assert rows(history.cochange(c), "a", "b", "n", "jaccard", "lift", "confidence") == [("a", "d", 2, 0.6667, 1.6667, 1.0)]


def test_snapshots_compare(spark):
    a = spark.createDataFrame([("x",), ("y",)], "finding string")
    b = spark.createDataFrame([("y",), ("z",)], "finding string")
    assert rows(compare.debt(a, b), "finding", "state") == [("x", "fixed"), ("y", "existing"), ("z", "new")]
    assert compare.changed(a, a, ["finding"]).count() == 0


def test_versions_and_ranges(spark):
    order = ["1.2-alpha", "1.2-alpha.1", "1.2.0", "1.2.3", "1.10.0", "1!0.1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").withColumn("k", rules.version_key(F.col("v")))
    assert [r["i"] for r in df.orderBy("k").collect()] == list(range(6))
    assert spark.range(1).select(rules.version_key(F.lit("1.2")) == rules.version_key(F.lit("v1.2.0+build"))).first()[0]
    # Any many numbers, of any length.
    order = ["0.0", "1.2.3.4.5.6.7", "1.2.3.4.5.6.8", "1.2.3.4.5.6.8.1", "1.20250101000000", "1.120250101000000", "1.120250101000001"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string").withColumn("k", rules.version_key(F.col("v")))
    assert [r["i"] for r in df.orderBy("k").collect()] == list(range(len(order))) and df.select("k").distinct().count() == len(order)


def test_path_classes(spark):
    from orrery.functions.paths import path_classes

    want = {
        "a/x_test.go": "test", "pkg/test_util.py": "test", "cypress/x.cy.ts": "e2e,test", "dist/a.js": "generated", "web/.storybook/main.js": "story", "mock-data.json": "mock",
        "scratch/a.py": "", "bench/a.py": "", "benchmarks/a.py": "benchmark", "a.pb.go": "", "specs/a.js": "", "third_party/a.c": "vendored", "notes.adoc": "docs", ".tmp-1/a": "temp", "integration-tests/a.js": "e2e,test",
    }
    df = spark.createDataFrame([(k,) for k in want], "p string").select("p", F.array_join(path_classes(F.col("p")), ",").alias("c"))
    assert {r["p"]: r["c"] for r in df.collect()} == want


def test_cursors_and_omitted_commits(spark):
    import pytest

    from orrery.operators import history, paging

    own = paging.fingerprint("snapshot", "query")
    assert paging.offset_of(paging.cursor(own, 40), own) == 40 and paging.offset_of(None, own) == 0
    for bad in ("%%", paging.cursor(own, 40)[:-4], paging.cursor(paging.fingerprint("other"), 40), paging.cursor(own, -1)):
        with pytest.raises(ValueError):
            paging.offset_of(bad, own)
    rows = spark.range(7).toDF("x")
    last = paging.page(rows, [F.col("x")], own, paging.cursor(own, 5), 5).collect()
    assert [(r["x"], r["rank"], r["total"], r["next_cursor"]) for r in last] == [(5, 6, 7, None), (6, 7, 7, None)]
    changes = spark.createDataFrame([("big", f"f{i}") for i in range(90)] + [("c1", "a"), ("c1", "b"), ("c2", "a"), ("c2", "b")], "commit string, file string")
    assert tuple(history.omitted_commits(changes).first()) == (3, 1)
    assert [(r["a"], r["b"], r["n"]) for r in history.cochange(changes).collect()] == [("a", "b", 2)]


def test_walks_that_do_not_end_in_time_are_errors(spark):
    import pytest

    from orrery.operators import traverse

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(6)], "source string, target string")
    seed = spark.createDataFrame([("n0",)], "id string")
    assert traverse.layered(chain, seed, 3).count() == 4
    with pytest.raises(RuntimeError):
        traverse.layered(chain, seed, 3, whole=True)


def test_near_names(spark):
    own = spark.createDataFrame([("lodahs",), ("expres",), ("lodash",), ("other",)], "name string")
    popular = spark.createDataFrame([("lodash",), ("express",)], "name string")
    assert rows(rules.near_names(own, popular), "name", "popular", "distance") == [("expres", "express", 1), ("lodahs", "lodash", 1)]


def test_clones_find_a_shared_run(spark):
    base = " ".join(f"w{i}" for i in range(40))
    t = spark.createDataFrame([(1, base), (2, base), (3, " ".join(f"z{i}" for i in range(40))), (4, None)], "id long, text string")
    assert rows(clones.clone_pairs(clones.fingerprints(t)), "a", "b", "similarity") == [(1, 2, 100)]


def test_readers(spark):
    log = spark.createDataFrame([("\x1eh1\x1f5\x003\t1\ta.py\x000\t0\t\x00old.py\x00new.py\x00-\t-\tb.bin\x00",)], "text string")
    assert rows(readers.numstat(log), "file", "additions", "is_binary") == [("a.py", 3, False), ("b.bin", 0, True), ("new.py", 0, False)]
    req = spark.createDataFrame([(1, "Foo_Bar==1.2 # x\n-r other\nbaz>=2")], "file long, text string")
    assert rows(readers.requirements(req), "name", "version") == [("baz", ""), ("foo-bar", "1.2")]
    bad = spark.createDataFrame([(1, "def broken(:"), (2, "def f():\n  if x: g()\n")], "file long, text string")
    assert rows(scan.python_symbols(bad), "file", "name", "cyclomatic") == [(2, "f", 2)]
    assert rows(scan.python_calls(bad), "caller", "callee") == [("f", "g")]
