"""Small literals: enclosing ranges, re-exports, mounts, overlays, liveness, cycles."""

import pytest
from pyspark.sql import functions as F

from orrery.operators import liveness, ranges, resolve


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_innermost_range_across_bins(spark):
    symbols = spark.createDataFrame([("f", "outer", 1, 300), ("f", "inner", 60, 70), ("g", "other", 1, 99)], "file string, id string, lo long, hi long")
    points = spark.createDataFrame([(1, "f", 65), (2, "f", 200), (3, "f", 301), (4, "g", 1)], "point long, file string, line long")
    assert rows(ranges.innermost(points, symbols), "point", "symbol") == [(1, "inner"), (2, "outer"), (4, "other")]


def test_uncovered_symbol_takes_the_file_share(spark):
    symbols = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 8, 9), ("g", "c", 1, 2)], "file string, id string, lo long, hi long")
    lines = spark.createDataFrame([("f", 1, True), ("f", 2, False), ("f", 5, True)], "file string, line long, hit boolean")
    assert rows(ranges.range_coverage(symbols, lines).fillna(-1), "id", "total", "pct") == [("a", 2, 50), ("b", 0, 66), ("c", 0, -1)]


def test_reexports_go_on_until_nothing_changes(spark):
    own = spark.createDataFrame([("m0", "x"), ("m13", "y")], "module string, name string")
    star = spark.createDataFrame([(f"m{k}", f"m{k - 1}") for k in range(1, 13)], "`module` string, `from` string")
    got = {r["module"]: r["origin"] for r in resolve.reexports(own, star).collect() if r["name"] == "x"}
    assert got == {f"m{k}": "m0" for k in range(13)}
    with pytest.raises(RuntimeError):
        resolve.reexports(own, star, bound=5)


def test_reexports_shadow_default_cycle_and_ambiguity(spark):
    own = spark.createDataFrame([("a", "x"), ("a", "default"), ("b", "x"), ("b", "y"), ("d", "y")], "module string, name string")
    star = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "d"), ("a", "c")], "module string, from string")
    got = {r[:2]: r[2:] for r in rows(resolve.reexports(own, star), "module", "name", "origin", "state")}
    assert got["b", "x"] == ("b", "resolved") and got["c", "x"] == ("b", "resolved") and got["c", "y"] == (None, "ambiguous")
    assert ("b", "default") not in got and got["a", "y"] == (None, "ambiguous")


def test_mounts_compose_and_cycles_end(spark):
    mounts = spark.createDataFrame([("app", "v1", "/v1"), ("v1", "users", "/users"), ("x", "y", "/y"), ("y", "x", "/x")], "parent string, child string, prefix string")
    routes = spark.createDataFrame([("users", "/:id"), ("app", "/ping")], "router string, path string")
    assert rows(liveness.mount_paths(mounts, routes), "router", "path") == [("app", "/ping"), ("users", "/v1/users/:id")]


def test_overlay_replaces_adds_and_never_dangles(spark):
    base = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls")], "source string, target string, relation string")
    exact = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "calls"), ("a", "gone", "calls")], "source string, target string, relation string")
    alive = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(resolve.merge_overlay(base, exact, alive), "source", "target", "provenance") == [("a", "b", "EXACT"), ("a", "c", "EXACT"), ("b", "c", "INFERRED")]


def test_nearest_tests_prefer_confidence(spark):
    e = spark.createDataFrame([("t1", "core", 1), ("t2", "core", 3), ("t2", "feat", 2), ("feat", "leaf", 3)], "source string, target string, confidence int")
    got = rows(liveness.nearest_tests(e, spark.createDataFrame([("t1",), ("t2",)], "id string"), keep=1), "file", "test", "distance", "score")
    assert got == [("core", "t2", 1, 3), ("feat", "t2", 1, 2), ("leaf", "t2", 2, 2)]


def test_liveness_and_empty_inputs(spark):
    s = spark.createDataFrame([("1", "f", "used", True, False), ("2", "f", "idle", True, False), ("3", "g", "__init__", False, False)], "id string, file string, name string, is_exported boolean, is_special boolean")
    uses = spark.createDataFrame([("1", True)], "target string, from_test boolean")
    live = liveness.symbol_liveness(s, uses, spark.createDataFrame([("idle", 1)], "name string, n long"))
    assert rows(live, "id", "dead", "test_only") == [("1", False, True), ("2", True, False), ("3", False, False)]
    assert rows(liveness.unused_exports(live, spark.createDataFrame([("f", "idle")], "file string, name string")), "id") == [("2",)]
    assert liveness.symbol_liveness(s.limit(0), uses.limit(0), live.select("name", F.lit(1).alias("n")).limit(0)).count() == 0


def test_cycle_delta(spark):
    old = spark.createDataFrame([(i, c) for c, m in {"a": "123", "b": "45", "c": "67"}.items() for i in m], "id string, component string")
    new = spark.createDataFrame([(i, c) for c, m in {"a": "12", "b": "45", "n": "89"}.items() for i in m], "id string, component string")
    assert rows(liveness.cycle_delta(old, new), "component", "state") == [("a", "changed"), ("c", "resolved"), ("n", "introduced")]
