"""Cycles, importers and change classes on small literals."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from orrery.operators import compare, impact, rules
from orrery.sources import diffs


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _first_cycle(edges, start):
    """Brute force: a breadth-first search over sorted neighbours."""
    came, todo = {start: None}, deque([start])
    while todo:
        at = todo.popleft()
        for nxt in sorted(b for a, b in edges if a == at):
            if nxt == start:
                path = []
                while at is not None:
                    path.append(at)
                    at = came[at]
                return [*path[::-1], start]
            if nxt not in came:
                came[nxt] = at
                todo.append(nxt)


def test_cycles_are_those_of_a_sorted_search(spark):
    one = [("a", "d"), ("a", "c"), ("c", "e"), ("d", "b"), ("b", "a"), ("e", "a"), ("c", "b"), ("a", "a")]
    two = [("p", "q"), ("q", "r"), ("r", "s"), ("s", "p"), ("r", "q"), ("q", "a"), (None, "p")]
    members = [(x, "a") for x in "abcde"] + [(x, "p") for x in "pqrs"]
    e, m = spark.createDataFrame(one + two, "source string, target string"), spark.createDataFrame(members, "id string, component string")
    want = [("a", _first_cycle([x for x in one if x[0] != x[1]], "a")), ("p", ["p", "q", "r", "s", "p"])]
    assert rows(impact.representative_cycles(e.union(e), m), "component", "cycle") == want
    assert impact.representative_cycles(e.limit(0), m).count() == 0
    with pytest.raises(RuntimeError):
        impact.representative_cycles(e, m, depth=2).count()


def test_importers_stay_within_their_client(spark):
    e = spark.createDataFrame([("x", "b", "a"), ("x", "c", "b"), ("y", "d", "a"), ("y", "a", "d"), (None, "z", "a"), ("x", "b", "a")], "client string, source string, target string")
    calls = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", None)], "client string, file string")
    assert rows(impact.affected_importers(e, calls, 1), "client", "file", "distance") == [("x", "a", 0), ("x", "b", 1)]
    ids = spark.createDataFrame([("a",)], "id string")
    assert rows(impact.importers(e, ids, 4), "id", "depth") == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("z", 1)]
    assert rows(impact.importers(e, ids, 4, 2), "id", "depth") == [("b", 1), ("d", 1)]


DIFF = """diff --git a/one.py b/two.py
similarity index 90%
rename from one.py
rename to two.py
--- a/one.py
+++ b/two.py
@@ -1,3 +1,4 @@ def f():
 keep
-gone
--- not a head
+new
+newer
+newest
@@ -10 +11 @@
-x
\\ No newline at end of file
+y
diff --git a/bin b/bin
Binary files a/bin and b/bin differ
diff --git a/old b/old
deleted file mode 100644
--- a/old
+++ /dev/null
@@ -1 +0,0 @@
-last
"""


def test_diffs_give_files_and_numbered_lines(spark):
    files, lines = diffs.unified_diff(spark.createDataFrame([(1, DIFF), (2, None), (3, "no diff"), (4, DIFF.replace("\n", "\r\n"))], "diff int, text string"))
    for k in (1, 4):
        assert rows(files.where(F.col("diff") == k), "file", "old_file", "is_new", "is_deleted", "is_renamed", "is_binary") == [("bin", "bin", False, False, False, True), ("old", "old", False, True, False, False), ("two.py", "one.py", False, False, True, False)]
        want = [("added", None, 2, "new"), ("added", None, 3, "newer"), ("added", None, 4, "newest"), ("added", None, 11, "y")]
        want += [("removed", 2, 2, "gone"), ("removed", 3, 2, "-- not a head"), ("removed", 10, 11, "x")]
        got = lines.where((F.col("diff") == k) & (F.col("file") == "two.py"))
        assert sorted(got.select("kind", F.coalesce("old_line", F.lit(0)).alias("o"), "new_line", "text").collect()) == [(a, b or 0, c, d) for a, b, c, d in want]
    assert files.count() == 6


def test_the_strongest_class_wins_and_odd_labels_match(spark):
    files = spark.createDataFrame([("a", None, None, None, None), ("b", False, False, False, False)], "file string, is_new boolean, is_deleted boolean, is_renamed boolean, is_binary boolean")
    lines = spark.createDataFrame([("a", "added", None, 5, "  $x += 1"), ("a", "removed", 20, 21, "function $go() {"), ("a", "added", None, 21, "function $go(b) {"), ("b", "added", None, 1, "  // note"), ("b", "added", None, 2, "")], "file string, kind string, old_line int, new_line int, text string")
    symbols = spark.createDataFrame([("a", "a#s", "s()", 1, 30, True), ("a", "a#go", "$go()", 21, 25, True), ("a", "a#n", None, 4, 6, True)], "file string, id string, label string, lo int, hi int, exported boolean")
    by, whole = impact.change_classes(files, lines, symbols)
    assert rows(by, "id", "class") == [("a#go", "signature-changed"), ("a#n", "body-changed")]
    assert rows(whole, "file", "class") == [("a", "signature-changed"), ("b", "metadata-only")]
    assert impact.change_classes(files.limit(0), lines, symbols)[1].count() == 0


def test_new_groups_of_changed_files_block(spark):
    g = "group int, member string, file string"
    base = spark.createDataFrame([(1, "a", "a"), (1, "b", "b")], g)
    now = spark.createDataFrame([(9, "b", "b"), (9, "a", "a"), (2, "a", "a"), (2, "c", "c"), (3, "d", "d"), (3, "e", "e")], g)
    got = compare.group_ratchet(base, now, spark.createDataFrame([("c",), ("b",)], "file string"))
    assert rows(got, "group", "n", "blocked") == [(2, 2, True), (3, 2, False)]


def test_scoped_names_are_near_scoped_ones_only(spark):
    n = lambda *x: spark.createDataFrame([(i,) for i in x], "name string")
    got = rules.near_names(n("loadsh", "@my/lodash", "@types/nodr", "ract", "rea"), n("lodash", "react", "@types/node"))
    assert rows(got, "name", "popular", "distance") == [("@types/nodr", "@types/node", 1), ("loadsh", "lodash", 1), ("ract", "react", 1)]
