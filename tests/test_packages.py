"""Lock graphs against a walk up the folders, and runtime evidence: odd texts, equal keys, sides, dates, and a stream."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from orrery.operators import packages, runtime


def walk(lock):
    """Edges and states of one lock file, by plain loops."""
    records = {p: r for p, r in lock["packages"].items()}
    name = lambda p: p.rsplit("node_modules/", 1)[1] if "node_modules/" in p else None
    ident = {p: f"npm:{name(p)}@{r['version']}:{hashlib.sha256(p.encode()).hexdigest()[:12]}" for p, r in records.items() if name(p) and not r.get("link") and "version" in r}
    edges, states = set(), []
    for p, r in records.items():
        if name(p) and p not in ident:
            continue
        kinds = {}
        for n in r.get("optionalDependencies", {}):
            kinds[n] = "optional"
        for f, k in (("dependencies", "runtime"), ("devDependencies", "dev")):
            for n in r.get(f, {}):
                kinds.setdefault(n, k)
        for n in r.get("peerDependencies", {}):
            kinds.setdefault(n, "optional-peer" if r.get("peerDependenciesMeta", {}).get(n, {}).get("optional") else "peer")
        for n, k in kinds.items():
            at, state = p, None
            while state is None:
                found = f"{at}/node_modules/{n}" if at else f"node_modules/{n}"
                if found in records:
                    state = "local" if records[found].get("link") else "external" if found in ident else "missing" if k.startswith("optional") else "unresolved"
                    if state == "external" and ident.get(p) != ident[found]:
                        edges.add((ident.get(p, "(root)"), ident[found], k))
                elif not at:
                    state = "missing" if k.startswith("optional") else "unresolved"
                else:
                    at = at.rsplit("/node_modules/", 1)[0] if "/node_modules/" in at else ""
            states.append(state)
    return edges, states


def random_lock(rnd):
    names = ["a", "b", "@s/c", "d"]
    paths = {""}
    for _ in range(12):
        base = rnd.choice(sorted(paths | {"packages/w"}))
        paths.add(f"{base}/node_modules/{rnd.choice(names)}".lstrip("/"))
    out = {}
    for p in paths | {"packages/w"}:
        r = {"version": f"{rnd.randint(0, 3)}.0"} if rnd.random() < 0.9 else {}
        if "node_modules" in p and rnd.random() < 0.1:
            r["link"] = True
        for f in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"):
            if rnd.random() < 0.5:
                r[f] = {n: "*" for n in rnd.sample(names + ["gone"], 2)}
        r["peerDependenciesMeta"] = {n: {"optional": rnd.random() < 0.5} for n in names[:2]}
        out[p] = r
    return {"lockfileVersion": rnd.choice([2, 3]), "packages": out}


def test_lock_graphs_are_those_of_a_walk(spark):
    rnd = random.Random(11)
    locks = {f"l{i}": random_lock(rnd) for i in range(25)}
    odd = [("n", None), ("e", ""), ("t", "{not json"), ("v1", '{"lockfileVersion": 1, "packages": {}}'), ("p", '{"lockfileVersion": 3, "packages": []}'), ("empty", '{"lockfileVersion": 3, "packages": {}}')]
    odd.append(("odd", json.dumps({"lockfileVersion": 3, "packages": {"": None, "node_modules/a": "1", "/abs": {}, "a//b": {}, "node_modules/b": {"version": "1 2"}, "c:/x": {}, "node_modules/b/": {"version": "2"}}})))
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in locks.items()] + odd, "file string, text string")
    nodes, edges, summary = packages.lock_graph(df)
    want = {(f, *e) for f, lock in locks.items() for e in walk(lock)[0]}
    assert {tuple(r) for r in edges.collect()} == want and len(want) > 50
    got = {r.file: r for r in summary.collect()}
    for f, lock in locks.items():
        states = walk(lock)[1]
        assert [got[f][s] for s in ("total", "external", "local", "missing", "unresolved")] == [len(states), *(states.count(s) for s in ("external", "local", "missing", "unresolved"))]
    assert {k: (got[k].state, got[k].reasons) for k, _ in odd} == {
        **{k: ("unsupported", "lock-v2-or-v3-required") for k in ("n", "e", "t", "v1", "p")}, "odd": ("partial", "invalid-records,invalid-versions"), "empty": ("unsupported", "lock-v2-or-v3-required"),
    }
    direct = {(f, t) for f, s, t, _ in want if s == "(root)"}
    assert {(r.file, r.id) for r in nodes.where("direct").collect()} == direct
    assert [d.count() for d in packages.lock_graph(df.limit(0))] == [0, 0, 0]


def span(key=None, **more):
    return {"traceId": "t", "spanId": "s", "kind": 2, "attributes": [{"key": k, "value": v} for k, v in (key or [])]} | more


def report(**more):
    full = {"schema": "v1", "repositoryRevision": "r", "generatedAt": "2026-01-01T00:00:00Z", "coverage": {t: "COMPLETE" for t in runtime.TRANSPORTS}}
    return json.dumps({k: v for k, v in (full | more).items() if v is not None})


def test_reports(spark):
    s = lambda v: {"stringValue": v}
    grpc = [("rpc.system", s("grpc")), ("rpc.method", s("Old")), ("rpc.method", s("Get"))]
    texts = {
        "fine": report(resourceSpans=[{"instrumentationLibrarySpans": [{"spans": [span(grpc, name="S/Get")]}]}]),
        "empty": report(),
        "sides": report(observations=[{"transport": "event", "side": "server", "name": "x"}, {"transport": "graphql", "side": "server", "name": "q", "operation": "query"}, {"transport": "graphql", "side": "server", "name": "q"}, {"transport": "ws", "side": "server", "name": "q"}, {"transport": "grpc", "side": "client", "name": " "}]),
        "old": report(generatedAt="2025-12-01T00:00:00Z"), "future": report(generatedAt="2026-01-02T00:06:00Z"), "soon": report(generatedAt="2026-01-02T00:04:00Z"), "date": report(generatedAt="today"), "schema": report(schema=None),
        "revision": report(repositoryRevision="q"), "coverage": report(coverage={"grpc": "complete"}), "text": "no json", "null": None, "list": "[]",
    }
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    kept, states = runtime.evidence(df, spark.createDataFrame([(k, "r") for k in texts], "id string, revision string"), "v1", "2026-01-02T00:00:00Z")
    got = {r.id: (r.status, r.reasons, r.observed, r.ignored) for r in states.collect()}
    none = "schema,revision,date,graphql-not_checked,grpc-not_checked,event-not_checked"
    assert got == {
        "fine": ("complete", "", 1, 0), "empty": ("complete", "", 0, 0), "sides": ("partial", "ignored", 1, 4), "old": ("partial", "stale", 0, 0), "future": ("partial", "stale", 0, 0), "soon": ("complete", "", 0, 0), "date": ("partial", "date", 0, 0),
        "schema": ("partial", "schema", 0, 0), "revision": ("partial", "revision", 0, 0), "coverage": ("partial", "graphql-not_checked,event-not_checked", 0, 0), "text": got["text"], "null": ("partial", f"invalid-json,{none}", 0, 0), "list": got["list"],
    }
    assert got["text"][0] == got["list"][0] == "partial" and got["text"][1].endswith(none)
    assert {(r.id, r.transport, r.side, r.name, r.service) for r in kept.collect()} == {("fine", "grpc", "server", "Get", "S"), ("sides", "graphql", "server", "q", None)}


def test_files_and_attributes(spark):
    paths = ["a.ts", "./a.ts", "a\\b.ts", "/etc/x", "C:/x", "../x", "a/../x", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(runtime.safe_file(F.col("p"))).collect()] == ["a.ts", "a.ts", "a/b.ts", None, None, None, None, None, None]
    df = spark.createDataFrame([([("k", '{"intValue": 7}'), ("k", '{"boolValue": true}'), ("p", "plain"), (None, "x"), ("a", "[1]")],), (None,)], "a array<struct<key: string, value: string>>")
    assert [tuple(r) for r in df.select(runtime.attribute(F.col("a"), "k"), runtime.attribute(F.col("a"), "no", "p"), runtime.attribute(F.col("a"), "a")).collect()] == [("true", "plain", None), (None, None, None)]


def test_spans_as_a_stream(spark, tmp_path):
    schema = "id string, at timestamp, s " + runtime._SPAN
    at = "2026-01-01 10:0{}:00"
    rows = [("r", at.format(i % 3), ("t", f"s{i % 4}", None, "S/Get", "2", None, [("rpc.system", "grpc")])) for i in range(8)]
    df = spark.createDataFrame([(i, t, s) for i, t, s in rows], "id string, at string, s " + runtime._SPAN).withColumn("at", F.to_timestamp("at"))
    df.write.json(str(tmp_path / "in"))
    for k in range(3):  # later spans move the watermark past the first hour
        stream = runtime.activity(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        late = spark.createDataFrame([("r", f"2026-01-01 1{3 + k}:00:00", ("t", f"z{k}", None, "S/Get", "2", None, [("rpc.system", "grpc")]))], "id string, at string, s " + runtime._SPAN)
        late.withColumn("at", F.to_timestamp("at")).write.mode("append").json(str(tmp_path / "in"))
    done = spark.read.parquet(str(tmp_path / "out")).orderBy("window.start").collect()
    assert [(r.name, r.side, r.n) for r in done][:1] == [("Get", "server", 4)] and [(r.name, r.n) for r in runtime.activity(df).collect()] == [("Get", 4)]
