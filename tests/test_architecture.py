"""Backing services, components and seeds: each rule, ties, nulls and empty tables, and random trees against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import architecture as arch

REGISTRY = [("pg", "dep", "pg"), ("pg", "image", "bitnami/postgresql"), ("pg", "env-weak", "DATABASE"), ("redis", "image", "redis"), ("redis", "env", "REDIS"), ("mongo", "image", "mongo"), ("kafka", "import", "kafkajs"), ("jvm", "dep", "org.x:y")]


def signals(spark, rows):
    evidence = spark.createDataFrame(rows, "repo long, kind string, value string")
    return {tuple(r) for r in arch.service_signals(evidence, spark.createDataFrame(REGISTRY, "service string, kind string, token string")).collect()}


def test_signals(spark):
    fits = [("dep", "PG", "pg"), ("dep", "pg/native", "pg"), ("dep", "org.x:y:1.2", "jvm"), ("dep", "pg@8", "pg"), ("image", "'ghcr.io:443/bitnami/postgresql:15@sha256:aa'", "pg"), ("image", "bitnami/redis", "redis"), ("env", "redis", "redis"), ("env", "REDIS_X", "redis"), ("env", "DATABASE_URL", "pg")]
    others = [("dep", "pgx"), ("dep", "pg-mock"), ("dep", "pg.native"), ("dep", ""), ("dep", None), ("image", "mongo-express"), ("image", "redis/exporter"), ("image", "postgresql"), ("image", ""), ("image", None), ("env", "DATABASE"), ("env", "DATABASE_COLOR"), ("env", "REDISX"), ("env", None), ("other", "pg")]
    rows = [(i, k, v) for i, (k, v, _) in enumerate(fits)] + [(100 + i, k, v) for i, (k, v) in enumerate(others)] + [(0, "dep", "PG")]
    assert {(r[0], r[1]) for r in signals(spark, rows)} == {(i, s) for i, (_, _, s) in enumerate(fits)}


def test_services(spark):
    registry = spark.createDataFrame(REGISTRY, "service string, kind string, token string")
    evidence = spark.createDataFrame([(1, "env", "REDIS_URL"), (2, "image", "redis"), (3, "env", "KAFKA_X")], "repo long, kind string, value string")
    files = spark.createDataFrame([(1, "a", 'x "kafkajs/lib"'), (1, "b", "`KafkaJS`"), (1, "c", "kafkajs"), (2, "d", None), (2, "e", "")], "repo long, file string, text string")
    got = {tuple(r) for r in arch.backing_services(evidence, files, registry).collect()}
    assert got == {(1, "redis", "env", 1, 0, "medium"), (1, "kafka", "import", 0, 2, "medium"), (2, "redis", "image", 1, 0, "high")}
    both = registry.unionByName(spark.createDataFrame([("kafka", "env", "KAFKA")], registry.schema))
    assert {(r.repo, r.confidence) for r in arch.backing_services(evidence.unionByName(spark.createDataFrame([(1, "env", "KAFKA_X")], evidence.schema)), files, both).where("service = 'kafka'").collect()} == {(1, "high"), (3, "medium")}
    assert arch.backing_services(evidence.limit(0), files.limit(0), registry).count() == 0 and arch.backing_services(evidence, files, registry.limit(0)).count() == 0


def java_by_rounds(files, most):
    """The definition: parts too large are cut again, round by round."""
    roots = {}
    for f in files:
        root, tail = f.split("src/main/java/")
        roots.setdefault(root + "src/main/java", []).append((f, tail.split("/")[:-1]))
    at = {}
    for root, entries in roots.items():
        common = []
        for parts in zip(*(d for _, d in entries)):
            if len(set(parts)) > 1:
                break
            common.append(parts[0])
        common = common[: max(0, min(len(d) for _, d in entries) - 1)]
        for f, d in entries:
            at[f] = ("/".join([root, *common, d[len(common)]]) if len(d) > len(common) else f, None)
    again = True
    while again:
        again, groups = False, {}
        for f, (key, loose) in at.items():
            groups.setdefault((key, loose), []).append(f)
        for (key, loose), own in groups.items():
            rest = [f[len(key) + 1 :].split("/") for f in own]
            if loose or len(own) <= most or len({r[0] for r in rest if len(r) > 1}) < 2:
                continue
            for f, r in zip(own, rest):
                at[f] = (f"{key}/{r[0]}", None) if len(r) > 1 else (key, True)
            again = True
    return {f: k + "::root" * bool(loose) for f, (k, loose) in at.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_java_territories_are_those_of_rounds(spark, seed):
    rnd = random.Random(seed)
    files = {"/".join([rnd.choice(["src", "a/src"]), "main/java", *(["org", "x"] if seed == 1 else []), *(rnd.choice("pqr") for _ in range(rnd.randint(seed - 1, 5))), f"K{i}.java"]) for i in range(300)}
    df = spark.createDataFrame([(f,) for f in files] + [(None,)], "file string")
    got = {r.file: r.key for r in arch.territories(df, most=9).collect()}
    assert got == java_by_rounds(files, 9)


def test_other_territories(spark):
    want = {
        "a.py": "root-code", "src/a.py": "src-root", "src/x/a.py": "src/x", "lib/y/z/a.py": "lib/y", "tools/a.py": "tools", "tools/b/c/a.py": "tools", "pkg/src/m/a.ts": "pkg/src/m", "pkg/src/a.ts": "pkg/src/a.ts",
        "x/src/main/java/notes.txt": "x", "src/main/a.py": "src/main",
    }
    df = spark.createDataFrame([(f,) for f in [*want, "a.py"]], "file string")
    assert {r.file: r.key for r in arch.territories(df).collect()} == want
    assert arch.components(arch.territories(df), top=2).collect()[0].key == "tools"
    assert arch.territories(df.limit(0)).collect() == []


def test_seeds(spark):
    nodes = [
        ("src/auth.ts", "auth.ts", "src/auth.ts", False, 80), ("src/auth.ts#login@1", "login", "src/auth.ts", True, 0), ("src/session/store.ts", "store.ts", "src/session/store.ts", False, 4), ("src/x.ts#authGate@3", "authGate", "src/x.ts", True, 0),
        ("docs/unauthorised.md", "unauthorised.md", "docs/unauthorised.md", False, 0), ("src/other.ts", "other.ts", None, False, 0), ("zz", None, None, True, 0),
    ]
    df = spark.createDataFrame(nodes, "id string, label string, file string, is_symbol boolean, degree long")
    scores = arch.seed_scores(df, [["auth", "login", "session"], ["store"]])
    got = {(r.concept, r.id): r.score for r in scores.collect()}
    assert got == {
        (0, "src/auth.ts"): 60 + 7 + 2 + 2, (0, "src/auth.ts#login@1"): 48 + 2.0, (0, "src/session/store.ts"): 36 + 7 + 1 + 0.1, (0, "src/x.ts#authGate@3"): 36 + 2.0, (0, "docs/unauthorised.md"): 12 + 7 + 2.0, (1, "src/session/store.ts"): 60 + 7 + 1 + 0.1,
    }
    assert [r.id for r in arch.seeds(scores, 2, 4).orderBy("position").collect()] == ["src/auth.ts", "src/session/store.ts", "src/auth.ts#login@1", "src/x.ts#authGate@3"]
    assert [r.id for r in arch.seeds(scores, 2, 1).collect()] == ["src/auth.ts"] and arch.seeds(scores.limit(0), 2).collect() == []
    structural = {(r.concept, r.id): r.score for r in arch.seed_scores(df, [["auth"]], structural=True).collect()}
    assert structural[(0, "docs/unauthorised.md")] == 0 if (0, "docs/unauthorised.md") in structural else True
    assert structural[(0, "src/x.ts#authGate@3")] == 36 + 2 - 18
