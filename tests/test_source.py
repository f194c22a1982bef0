"""The lexer, the facts of source files, how they link, and the maintained graph."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import linking
from orrery.sources import javascript, lexer
from orrery.streaming.incremental import SourceGraph


def kinds(text):
    return [(k, text[a:b]) for k, a, b in lexer.tokens(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a / b / c", [("name", "a"), ("mark", "/"), ("name", "b"), ("mark", "/"), ("name", "c")]),
        ("x = /[/'\"]+/g.test(y)", [("name", "x"), ("mark", "="), ("regex", "/[/'\"]+/g"), ("mark", "."), ("name", "test"), ("mark", "("), ("name", "y"), ("mark", ")")]),
        ("return /a/", [("name", "return"), ("regex", "/a/")]),
        ("'it\\'s' + \"\\\"\"", [("string", "'it\\'s'"), ("mark", "+"), ("string", '"\\""')]),
        ("`a ${b} c`", [("template", "`a "), ("mark", "{"), ("name", "b"), ("mark", "}"), ("template", " c`")]),
        ("`${`x${{a:1}}`}`", [("template", "`"), ("mark", "{"), ("template", "`x"), ("mark", "{"), ("mark", "{"), ("name", "a"), ("mark", ":"), ("number", "1"), ("mark", "}"), ("mark", "}"), ("template", "`"), ("mark", "}"), ("template", "`")]),
        ("// a 'b\n/* ` */ c", [("comment", "// a 'b"), ("comment", "/* ` */"), ("name", "c")]),
        ("a /* open", [("name", "a"), ("comment", "/* open")]),
        ("'open\nb", [("mark", "'"), ("name", "open"), ("name", "b")]),
        ("<a/> </b>", [("mark", "<"), ("name", "a"), ("mark", "/"), ("mark", ">"), ("mark", "<"), ("mark", "/"), ("name", "b"), ("mark", ">")]),
        ("#p.$q_1?.[0]", [("name", "#p"), ("mark", "."), ("name", "$q_1"), ("mark", "?."), ("mark", "["), ("number", "0"), ("mark", "]")]),
        ("", []),
    ],
)
def test_tokens(text, want):
    assert kinds(text) == want


def test_tokens_cover_any_text():
    rnd = random.Random(4)
    pieces = ["'", '"', "`", "${", "}", "{", "/", "*/", "/*", "//", "\n", "\\", "a", " ", "é", "1.5", "(", ")", "=>", "#"]
    for _ in range(3000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 25)))
        done = 0
        for _, a, b in lexer.tokens(text):
            assert done <= a < b <= len(text)
            assert not text[done:a].strip() or text[done:a].strip() in ("$", "\\")
            done = b
        hidden = lexer.mask(text)
        assert len(hidden) == len(text) and [i for i, c in enumerate(hidden) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_long_texts_take_one_pass():
    for text in ["'" * 400_000, "`${" * 100_000, "/" * 300_000, "(" * 300_000, "{" * 200_000, "a." * 200_000, "/*" * 200_000, '"\\' * 200_000]:
        list(lexer.tokens(text))
    javascript.facts_of("a.ts", "export const x = 1, y = () => z(2)\n" * 20_000)


def found(text, fact, *columns, file="a.ts"):
    return [tuple(r[c] for c in columns) for r in javascript.facts_of(file, text) if r["fact"] == fact]


def test_imports_in_all_shapes():
    text = """import React, {useState as use, type FC} from 'react'
import * as ns from "./ns"
import type {Props} from './props'
import def from './def'
import './side.css'
const {a, b: bee, c = 1} = require('./cjs')
let whole = require("pkg"), other = require('./other')
require(name); const lazy = await import('./lazy'); import(where)
// import x from './no'
const s = "import y from './no'", t = `import z from './no'`, r = /import 'no'/
"""
    assert found(text, "import", "kind", "spec", "type_only", "line") == [
        ("esm", "react", False, 1), ("esm", "./ns", False, 2), ("esm", "./props", True, 3), ("esm", "./def", False, 4), ("esm", "./side.css", False, 5), ("cjs", "./cjs", False, 6), ("cjs", "pkg", False, 7),
        ("cjs", "./other", False, 7), ("dynamic", None, False, 8), ("dynamic", "./lazy", False, 8), ("dynamic", None, False, 8),
    ]
    assert found(text, "binding", "name", "imported", "spec", "type_only") == [
        ("React", "default", "react", False), ("use", "useState", "react", False), ("FC", "FC", "react", True), ("ns", "*", "./ns", False), ("Props", "Props", "./props", True), ("def", "default", "./def", False),
        ("a", "a", "./cjs", False), ("bee", "b", "./cjs", False), ("c", "c", "./cjs", False), ("whole", "*", "pkg", False), ("other", "*", "./other", False),
    ]


def test_exports_in_all_shapes():
    text = """export * from './star'
export * as space from './space'
export {default as main, thing, type T} from './barrel'
export type {U} from './types'
export { own as alias, other }
export default own
"""
    assert found(text, "export", "kind", "name", "imported", "spec", "type_only") == [
        ("star", "*", "*", "./star", False), ("namespace", "space", "*", "./space", False), ("named", "main", "default", "./barrel", False), ("named", "thing", "thing", "./barrel", False),
        ("named", "T", "T", "./barrel", True), ("named", "U", "U", "./types", True), ("local", "alias", "own", None, False), ("local", "other", "other", None, False), ("local", "default", "own", None, False),
    ]
    assert found("const a = 1\nexport default { a, go: run, n: 3, s() {} }\nfunction run() {}", "export", "kind", "name", "imported") == [("facade", "default", "default"), ("member", "a", "a"), ("member", "go", "run")]
    assert found("function a() {}\nfunction b() {}\nfunction c() {}\nmodule.exports = { a }\nexports.b = b", "symbol", "name", "exported", file="a.js") == [("a", True), ("b", True), ("c", False)]


def test_symbols():
    text = """export default class Widget<T> extends Base<T> implements I {
  static count = make()
  private async load(id: string): Promise<{a: number}> { await fetchIt(id) }
  get size() { return this.n / 2 / 3 }
  abstract later(): void
  handler = () => { inner() }
}
export abstract class Other extends mixin(A) {}
export async function* gen() { function nested() {} }
const fn = function named() {}, {x, y} = z, [q] = w, last = 1
interface Props { run(x: number): void }
export type Alias<T> = { a: T } | null
export const enum Color { Red, Green }
declare function ambient(x: number): void
"""
    assert found(text, "symbol", "name", "kind", "imported", "line", "end_line", "exported", "top", "owner") == [
        ("Widget", "class", "both", 1, 7, True, True, None), ("load", "method", "value", 3, 3, False, False, "Widget"), ("size", "method", "value", 4, 4, False, False, "Widget"), ("Other", "class", "both", 8, 8, True, True, None),
        ("gen", "function", "value", 9, 9, True, True, None), ("nested", "function", "value", 9, 9, False, False, None), ("fn", "variable", "value", 10, 10, False, True, None), ("last", "variable", "value", 10, 10, False, True, None),
        ("Props", "interface", "type", 11, 11, False, True, None), ("Alias", "type", "type", 12, 12, True, True, None), ("Color", "enum", "both", 13, 13, True, True, None),
    ]
    assert found(text, "base", "name", "caller") == [("Base", "Widget@1")]
    assert ("make", "Widget@1") in found(text, "call", "name", "caller") and ("inner", "Widget@1") in found(text, "call", "name", "caller")
    assert not {"run", "later", "ambient"} & {n for (n,) in found(text, "call", "name")}
    assert found("interface A {}\ntype B = 1\nenum C {}", "symbol", "name", file="a.js") == []


def test_calls():
    text = "function f() {\n  g(1); ns.h(); new K(); a.b.c(); if (x) y?.z(); return <Panel.Item/>\n}\nconst el = () => <Thing>no()</Thing>\ntop()\n"
    assert found(text, "call", "kind", "owner", "name", "caller", file="a.jsx") == [
        ("call", None, "g", "f@1"), ("member", "ns", "h", "f@1"), ("member", "y", "z", "f@1"), ("jsx", "Panel", "Item", "f@1"), ("jsx", None, "Thing", "el@4"), ("call", None, "no", "el@4"), ("call", None, "top", None),
    ]


def test_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([("a.js", None), ("b.js", ""), (None, "f()"), ("c.js", "f("), ("c.js", "f(")], "file string, text string")
    rows = javascript.facts(df).collect()
    assert [(r.file, r.fact, r.name) for r in rows] == [("", "call", "f"), ("c.js", "call", "f"), ("c.js", "call", "f")]
    assert javascript.facts(df.limit(0)).collect() == []
    assert [r.text for r in javascript.masked(df.where("file = 'c.js'")).collect()] == ["f(", "f("]


REPO = {
    "src/a.js": "export function one() { return two() }\nfunction two() {}\nexport const util = 1\nexport default one\n",
    "src/b.ts": "export const util = 2\nexport function three() {}\nexport class K {}\n",
    "src/index.ts": "export * from './a'\nexport * from './b.ts'\nexport { three as drei } from './b'\nexport * as all from './b'\n",
    "src/deep/index.js": "export * from '..'\nexport * from './loop'\nexport const own = () => {}\n",
    "src/deep/loop.ts": "export * from './index'\nexport { own as again } from '.'\n",
    "src/relay.ts": "import { one } from './a'\nexport { one, one as uno }\nimport dflt from './a'\nexport { dflt }\n",
    "src/facade.ts": "import { three } from './b'\nfunction save() {}\nexport default { three, keep: save }\n",
    "src/old.js": "function legacy() {}\nfunction hidden() {}\nmodule.exports = { legacy }\n",
    "src/use.tsx": """import { drei, util, K, missing } from '.'
import * as deep from './deep'
import { uno, dflt } from './relay'
import svc from './facade'
import old, { legacy } from './old'
import * as whole from './old'
import { helper } from '@/lib/help'
import Box from '@/lib/Box?raw'
import React from 'react'
import sub from '@scope/pkg/sub'
import gone from './gone'
import pic from './pic.svg'
class Sub extends K {}
function run() { drei(); util(); missing(); deep.one(); deep.again(); deep.util(); uno(); dflt(); svc.three(); svc.keep(); legacy(); whole.legacy(); whole.hidden(); helper(); React.memo(); run() }
const el = () => <Box/>
""",
    "lib/help.ts": "export function helper() {}\nfunction drei() {}\n",
    "lib/Box.tsx": "export default function Box() {}\n",
}


def repo(spark, texts=None):
    return spark.createDataFrame(list((texts or REPO).items()), "file string, text string")


def test_linking(spark):
    files = repo(spark)
    facts = javascript.facts(files).cache()
    imports, calls = linking.link(facts, files, {"@/": ""})
    state = {(r.file, r.spec): (r.target, r.state) for r in imports.collect()}
    at = lambda spec: state[("src/use.tsx", spec)]
    assert at(".") == ("src/index.ts", "file") and at("./deep") == ("src/deep/index.js", "file") and at("@/lib/help") == ("lib/help.ts", "file") and at("@/lib/Box?raw") == ("lib/Box.tsx", "file")
    assert at("react") == (None, "package") and at("@scope/pkg/sub") == (None, "package") and at("./gone") == (None, "unresolved") and at("./pic.svg") == (None, "asset")
    assert state[("src/deep/index.js", "..")] == ("src/index.ts", "file")
    got = {((r.owner + ".") if r.owner else "") + r.name: (r.target, r.layer, r.state) for r in calls.where("file = 'src/use.tsx'").collect()}
    assert got == {
        "K": ("src/b.ts#K@3", "barrel", "resolved"), "drei": ("src/b.ts#three@2", "barrel", "resolved"), "util": (None, None, "ambiguous"), "missing": (None, None, "missing"), "deep.one": ("src/a.js#one@1", "barrel", "resolved"),
        "deep.again": ("src/deep/index.js#own@3", "import", "resolved"), "deep.util": (None, None, "ambiguous"), "uno": ("src/a.js#one@1", "barrel", "resolved"), "dflt": ("src/a.js#one@1", "barrel", "resolved"),
        "svc.three": ("src/b.ts#three@2", "barrel", "resolved"), "svc.keep": ("src/facade.ts#save@2", "import", "resolved"), "legacy": ("src/old.js#legacy@1", "import", "resolved"), "whole.legacy": ("src/old.js#legacy@1", "import", "resolved"),
        "whole.hidden": (None, None, "missing"), "helper": ("lib/help.ts#helper@1", "import", "resolved"), "run": ("src/use.tsx#run@14", "own", "resolved"), "Box": ("lib/Box.tsx#Box@1", "import", "resolved"),
    }
    edges = {(r.source, r.target, r.relation) for r in linking.call_edges(calls).collect()}
    assert ("src/use.tsx#Sub@13", "src/b.ts#K@3", "inherits") in edges and ("src/use.tsx#el@15", "lib/Box.tsx#Box@1", "references") in edges and ("src/a.js#one@1", "src/a.js#two@2", "calls") in edges
    assert not any(a == b for a, b, _ in edges)
    none = linking.link(facts.limit(0), files)
    assert none[0].count() == 0 and none[1].count() == 0


def test_packages_and_paths(spark):
    df = spark.createDataFrame([("react", "a/b/../c"), ("@s/p/x", "./a//b/."), ("./a", "../a"), ("node:fs", "a/../../b"), (None, None), ("@s", "")], "spec string, path string")
    got = df.select(linking.package_of(F.col("spec")), linking.normalised(F.col("path"))).collect()
    assert [tuple(r) for r in got] == [("react", "a/c"), ("@s/p", "a/b"), (None, None), ("fs", None), (None, None), (None, "")]


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def same_graph(a, b):
    return all(rows(a.table(t)) == rows(b.table(t)) for t in ("facts", "files", "imports", "calls", "origins"))


def test_incremental_is_a_full_build(spark, tmp_path):
    rnd, texts = random.Random(6), dict(REPO)
    graph = SourceGraph(spark, str(tmp_path / "g"), {"@/": ""})
    graph.refresh(repo(spark, texts))
    assert (graph.head().kind, graph.head().reason) == ("full", "no-baseline")
    graph.refresh(repo(spark, texts))
    assert (graph.head().kind, graph.head().reason, graph.head().version) == ("none", "unchanged", 1)
    edits = ["// moved\n", "\n\n", "function extra() { one(); helper() }\n", "import './side'\n"]
    for turn in range(2):
        for file in rnd.sample(["src/a.js", "src/b.ts", "src/facade.ts", "src/use.tsx", "lib/help.ts", "src/old.js"], 2):
            texts[file] = rnd.choice(edits) + texts[file]
        graph.refresh(repo(spark, texts))
        assert graph.head().kind == "incremental"
        fresh = SourceGraph(spark, str(tmp_path / f"f{turn}"), {"@/": ""})
        fresh.rebuild(repo(spark, texts))
        assert same_graph(graph, fresh)


def test_every_fallback(spark, tmp_path):
    texts = {k: v for k, v in REPO.items() if k in ("src/a.js", "src/b.ts", "src/index.ts", "src/use.tsx")} | {"package.json": "{}", "notes.md": "a"}
    graph = SourceGraph(spark, str(tmp_path))
    graph.rebuild(repo(spark, texts))
    moved = lambda *files: {f: "// x\n" + texts[f] for f in files}
    steps = [
        (lambda: {"src/new.js": "f()"}, {}, "files-changed"), (lambda: {"src/new.js": None}, {}, "files-changed"), (lambda: moved("src/a.js", "src/b.ts"), {"most_changed": 1}, "too-many-changed"), (lambda: {"package.json": "{ }"}, {}, "config-changed"),
        (lambda: {"notes.md": "b"}, {}, "language"), (lambda: moved("src/index.ts"), {}, "barrel-changed"), (lambda: {"src/b.ts": texts["src/b.ts"] + "export const more = 1\n"}, {}, "exports-changed"), (lambda: moved("src/b.ts"), {"most_affected": 1}, "too-many-affected"),
    ]
    for change, most, reason in steps:
        texts = {k: v for k, v in (texts | change()).items() if v is not None}
        graph.most_changed, graph.most_affected = most.get("most_changed", 24), most.get("most_affected", 80)
        graph.refresh(repo(spark, texts))
        head = graph.head()
        assert (head.kind, head.reason) == ("full", reason)


def test_a_stream_maintains_the_graph(spark, tmp_path):
    graph = SourceGraph(spark, str(tmp_path / "g"))
    sink = graph.sink(str(tmp_path / "texts"))
    schema = "file string, text string, removed boolean, at long"
    one = spark.createDataFrame([("a.js", "export function f() {}", False, 1), ("b.js", "old()", False, 1), ("b.js", "import {f} from './a'\nfunction g() { f() }", False, 2)], schema)
    sink(one, 0)
    two = spark.createDataFrame([("a.js", "\nexport function f() {}", None, 3)], schema)
    sink(two, 1)
    sink(two, 1)  # given again
    assert [r.kind for r in graph.commits().orderBy("version").collect()] == ["full", "incremental"]
    assert [r.target for r in graph.table("calls").collect()] == ["a.js#f@2"]
    sink(spark.createDataFrame([("a.js", None, True, 4)], schema), 2)
    assert graph.head().reason == "files-changed" and [r.state for r in graph.table("calls").collect()] == ["missing"]


def test_external_references(spark):
    texts = {
        "a.ts": "export function one() { one() }\nexport interface Two {}\nexport class Three {}\nfunction hidden() {}\n",
        "b.ts": "import { one as uno, Three } from './a'\nimport type { Two } from './a'\nimport * as ns from './a'\nuno(uno); new Three(); ns.one(); ns . one; ns?.hidden(); // uno\nlet x: Two = 'uno', y: Two; z.uno\n",
        "c.ts": "export { one, Three as T } from './a'\nexport type { Two } from './a'\nexport * from './a'\n",
        "d.js": "const { one } = require('./a')\none(`${one}`)\n",
        "e.ts": "import './a'\nimport def from './a'\ndef(); one()\n",
    }
    files = repo(spark, texts)
    facts = javascript.facts(files).cache()
    found = linking.modules(linking.specs_of(facts), files)
    got = linking.external_references(javascript.uses(files), linking.bindings_of(facts, found), linking.exports_of(facts, found), linking.symbols_of(facts))
    assert {r.id: r.refs for r in got.collect()} == {"a.ts#one@1": 2 + 2 + 1 + 2, "a.ts#Two@2:type": 2 + 1, "a.ts#Three@3": 1 + 1, "a.ts#hidden@4": 1}
    assert javascript.uses(spark.createDataFrame([("x.js", None), ("y.js", "")], "file string, text string")).collect() == []
