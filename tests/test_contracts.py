"""Routes against calls by the rule itself on random shapes, odd rows, and the nodes and verdict of changes."""

import random

from pyspark.sql import functions as F

from orrery.operators import contracts, impact


def shape(e, c):
    catch = bool(e) and e[-1] == "*"
    if (len(c) < len(e) - 1) if catch else len(e) != len(c):
        return False
    n = len(e) - 1 if catch else len(e)
    return all(e[i] == ":param" or (c[i] not in (":param", "*") and e[i] == c[i]) for i in range(n))


def fit(e, c, dynamic, prefix):
    if shape(e, c):
        concrete = any(s == ":param" and (i >= len(c) or c[i] != ":param") for i, s in enumerate(e))
        return ("exact-dynamic", 0.78) if prefix else ("exact", 0.96 if concrete else 1.0)
    if len(e) != len(c) and min(len(e), len(c)) >= 2 and (shape(e, c[len(c) - len(e) :]) if len(e) < len(c) else shape(e[len(e) - len(c) :], c)):
        return ("suffix", 0.55 if dynamic or prefix else 0.72)
    return None


def test_fits_are_those_of_the_rule(spark):
    rnd = random.Random(3)
    part = lambda: rnd.choice(["a", "b", ":param", ":param", "*"])
    routes = [(i, rnd.choice(["GET", "any", "All", "POST"]), "/" + "/".join(part() for _ in range(rnd.randint(0, 5)))) for i in range(120)]
    calls = [(i, rnd.choice(["GET", "POST"]), "/" + "/".join(part() for _ in range(rnd.randint(0, 5))) + rnd.choice(["", "/"]), rnd.random() < 0.3, rnd.random() < 0.3) for i in range(120)]
    e = spark.createDataFrame(routes + routes[:2] + [(900, None, "/a"), (901, "GET", None)], "endpoint long, method string, path string")
    c = spark.createDataFrame(calls + calls[:2] + [(900, "GET", None, False, False), (901, "GET", "", False, False), (902, None, "/a", None, None)], "call long, method string, path string, dynamic boolean, prefix boolean")
    want = set()
    for i, m, p in routes:
        for j, called, q, d, x in calls:
            if m.upper() in ("ANY", "ALL", called) and (f := fit([s for s in p.split("/") if s], [s for s in q.split("/") if s], d, x)):
                want.add((j, i, *f))
    got = contracts.match_routes(e, c).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 300
    assert contracts.match_routes(e.limit(0), c).count() == 0


def test_changes(spark):
    files = spark.createDataFrame([("a", True, None, None), ("b", None, True, False), ("c", None, None, None), ("t/a", True, None, None)], "file string, is_deleted boolean, is_renamed boolean, is_binary boolean")
    classes = spark.createDataFrame([("a", "removed"), ("b", "signature-changed"), ("c", "added"), ("d", "unknown"), ("t/a", "removed")], "file string, class string")
    own = spark.createDataFrame([("a", "a#1", "removed"), ("b", "b#1", "body-changed"), ("c", "c#1", "added"), ("t/a", "t/a#1", "removed")], "file string, id string, class string")
    symbols = spark.createDataFrame([("a", "a#1", True), ("a", "a#2", False), ("b", "b#1", True), ("c", "c#1", True), ("d", "d#1", None), ("t/a", "t/a#1", True)], "file string, id string, exported boolean")
    test = F.col("file").startswith("t/")
    said, seeds = impact.change_seeds(files, own, classes, symbols, test)
    assert {tuple(r) for r in seeds.collect()} == {("a", "a#1"), ("a", "a"), ("a", "a#2"), ("b", "b#1"), ("b", "b"), ("d", "d"), ("d", "d#1")}
    assert {r.file: r["class"] for r in said.collect()}["t/a"] == "test-only"
    more = impact.change_seeds(files, own, classes, symbols, test, include_added=True)[1]
    assert {r.id for r in more.where("file = 'c'").collect()} == {"c", "c#1"}
    verdict = lambda rows: impact.change_verdict(spark.createDataFrame([(x,) for x in rows], "class string")).first().verdict
    assert [verdict(x) for x in (["added", "unknown"], ["body-changed", "test-only"], ["metadata-only", "added"], [])] == ["HIGH", "MEDIUM", "LOW", "LOW"]
