"""Evidence operators on small literals."""

from pyspark.sql import functions as F

from orrery.operators import evidence


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_clone_groups_are_suppressed_only_as_a_whole(spark):
    m = [("a", "x/a.router.ts", "router()", False), ("a", "b.router.mjs", "Routes", False), ("b", "b.router.ts", "router", False), ("b", "b.ts", "router", False), ("c", "t.ts", "t", True), ("c", None, None, True), ("d", "t.ts", "t", True)]
    got = evidence.suppressed_groups(spark.createDataFrame(m, "group string, file string, label string, declarative boolean"))
    assert rows(got, "group", "suppressed") == [("a", True), ("b", False), ("c", True), ("d", False)]


def test_fingerprint_leaves_line_numbers_out(spark):
    df = spark.createDataFrame([("a.js:10 > b.js:3",), ("a.js:11 > b.js",), ("a.js:1x > b.js",)], "e string")
    one, two, other = (r[0] for r in df.select(evidence.fingerprint(F.lit("r"), F.lit("k"), F.col("e"))).collect())
    assert one == two != other and len(one) == 32


def test_concepts_take_turns(spark):
    s = spark.createDataFrame([(0, "a", 9), (0, "b", 5), (1, "a", 8), (1, "c", 7), (2, "a", 6), (2, "c", 4), (2, "b", 0)], "concept int, id string, score int")
    assert rows(evidence.concept_seeds(s, 3), "concept", "id", "score") == [(0, "a", 9), (1, "c", 7)]
    assert evidence.concept_seeds(s.limit(0), 3).count() == 0


def test_task_symbols_sum_over_seeds(spark):
    n = spark.createDataFrame([("f", "file", "file", False), ("f#go", "go", "function", True), ("f#stop", "stop", "function", True)], "id string, label string, kind string, is_symbol boolean")
    e = spark.createDataFrame([("f", "f#go", "contains"), ("f", "f#stop", "contains")], "source string, target string, relation string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = evidence.task_symbols(["go"], n, e, ids("f#stop"), ids("f"))
    # stop: changed 100, itself and by its file 22 + 1 each; go: by its file 22 + 1, and the shared word.
    assert rows(got, "id", "score") == [("f#go", 31), ("f#stop", 146)]


def test_search_gives_lines(spark):
    f = spark.createDataFrame([("r", "p", "one\nTwo LICENSE\n\nlicense"), ("r", "q", None), ("r", "z", "")], "repo string, path string, text string")
    assert rows(evidence.content_search(f, "License"), "repo", "path", "line") == [("r", "p", 2), ("r", "p", 4)]
