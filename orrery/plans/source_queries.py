"""Source files made from the test tables, their facts, and how the facts link.

A supplier is a module; a barrel of its own passes it and the barrels before it on (up to five); a part is a module that uses its
first supplier in one of four import shapes. Comments, strings, templates and regular expressions hold words that are no code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import linking
from orrery.plans.star import table
from orrery.sources import javascript
from orrery.store import Scratch
from orrery.streaming import incremental

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SUPPLIER = """// import {ghost} from './s0'
import {log} from 'logger'
const note = "export function fake() {}", kind = 'it\\'s import'
export function supply@(x) { return check(x, `a ${check(1)} export`) }
function check(v) { return /import\\('no["']/.test(v) }
export const rate = (q) => supply@(q)
export class Depot@ extends Base { /* } */
  open(n) { return check(n) }
}
class Base {}
"""
_BARREL = "export * from './s@'\nexport { supply@ as supply } from './s@'\n"
_CHAIN = "export * from './b#'\n"
_SHAPES = [
    "import {supply@ as get, rate} from '../supp/s@'\nexport function make#(x) { return get(rate(x)) }\n",
    "import * as sup from '../supp/b@.ts'\nexport const make# = () => sup.supply(sup.rate(1))\n",
    "const {supply@: get, missing#} = require('../supp/s@.js')\nfunction make#() { get(1); missing#(2); make#() }\nmodule.exports = { make# }\n",
    "import {Depot@, rate as pace, type Depot@ as T} from '../supp/b@'\nexport class Part# extends Depot@ {\n  run(x: T): number { return pace(x) }\n}\n",
]


def _filled(text: str, at, hash_=None):
    out = F.replace(F.lit(text), F.lit("@"), at.cast("string"))
    return F.replace(out, F.lit("#"), hash_.cast("string")) if hash_ is not None else out


def source_files(spark, d) -> DataFrame:
    """file, text."""
    s = F.col("s_suppkey")
    supp = table(spark, d, "supplier")
    modules = supp.select(F.concat(F.lit("src/supp/s"), s, F.lit(".js")).alias("file"), _filled(_SUPPLIER, s).alias("text"))
    chain = F.when(s % 5 != 0, _filled(_CHAIN, s, s - 1)).otherwise("")
    barrels = supp.select(F.concat(F.lit("src/supp/b"), s, F.lit(".ts")).alias("file"), F.concat(_filled(_BARREL, s), chain).alias("text"))
    first = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_suppkey").alias("s"))
    shape = F.element_at(F.array(*[_filled(t, F.col("s"), F.col("k")) for t in _SHAPES]), (F.col("k") % 4 + 1).cast("int"))
    parts = first.select(F.concat(F.lit("src/p"), F.col("k") % 10, F.lit("/p"), "k", F.when(F.col("k") % 4 == 2, ".js").otherwise(".ts")).alias("file"), shape.alias("text"))
    return modules.unionByName(barrels).unionByName(parts)


def _facts(spark, d) -> tuple[DataFrame, DataFrame]:
    files = source_files(spark, d)
    return Scratch(spark, "facts").write(javascript.facts(files), "facts"), files.select("file")


_P = """p as (select l_partkey as k, min(l_suppkey) as s, 'src/p' || l_partkey % 10 || '/p' || l_partkey || case when l_partkey % 4 = 2 then '.js' else '.ts' end as file from lineitem group by l_partkey),
s as (select s_suppkey as s, 'src/supp/s' || s_suppkey || '.js' as file, 'src/supp/b' || s_suppkey || '.ts' as barrel from supplier)"""


@query(f"""with {_P}
select file, name, kind, space, line, end_line, owner, exported from s, lateral (values
  ('note', 'variable', 'value', 3, 3, null, false), ('kind', 'variable', 'value', 3, 3, null, false), ('supply' || s, 'function', 'value', 4, 4, null, true), ('check', 'function', 'value', 5, 5, null, false), ('rate', 'variable', 'value', 6, 6, null, true),
  ('Depot' || s, 'class', 'both', 7, 9, null, true), ('open', 'method', 'value', 8, 8, 'Depot' || s, false), ('Base', 'class', 'both', 10, 10, null, false)) v(name, kind, space, line, end_line, owner, exported)
union all select file, 'make' || k, case when k % 4 = 1 then 'variable' else 'function' end, 'value', 2, 2, null, true from p where k % 4 <> 3
union all select file, 'Part' || k, 'class', 'both', 2, 4, null, true from p where k % 4 = 3
union all select file, 'run', 'method', 'value', 3, 3, 'Part' || k, false from p where k % 4 = 3""")
def extract_javascript_symbols(spark, d):
    """Symbols, with the masking lexer in front"""
    facts, _ = _facts(spark, d)
    return linking.symbols_of(facts).select("file", "name", "kind", "space", "line", "end_line", "owner", "exported")


@query(f"""with {_P}
select file, null as target, 'imports' as relation, 2 as line, false as type_only, 'logger' as spec, 'package' as state from s
union all select barrel, file, 're_exports', l, false, './s' || s, 'file' from s, (values (1), (2)) v(l)
union all select barrel, 'src/supp/b' || s - 1 || '.ts', 're_exports', 3, false, './b' || s - 1, 'file' from s where s % 5 <> 0
union all select p.file, case when k % 2 = 0 then s.file else barrel end, 'imports', 1, false, '../supp/' || case k % 4 when 0 then 's' || s when 1 then 'b' || s || '.ts' when 2 then 's' || s || '.js' else 'b' || s end, 'file' from p join s using (s)""")
def link_file_imports(spark, d):
    """ESM, CommonJS and re-exports, each specifier resolved to a file or package"""
    facts, files = _facts(spark, d)
    return linking.file_imports(facts, linking.modules(linking.specs_of(facts), files))



@query("""with r as (select s_suppkey as s, s_suppkey - s_suppkey % 5 as a, 'src/supp/b' || s_suppkey || '.ts' as module from supplier),
own as (select s, 'src/supp/s' || s || '.js' as origin, unnest(['supply' || s, 'rate', 'Depot' || s]) as name from r),
every as (
  select module, name, origin, name as origin_name from r join own on own.s between r.a and r.s
  union select module, 'supply', 'src/supp/s' || s || '.js', 'supply' || s from r
  union select origin, name, origin, name from own
  union select 'src/p' || k % 10 || '/p' || k || '.ts' as f, n, f, n from (select distinct l_partkey as k, case when l_partkey % 4 = 3 then 'Part' else 'make' end || l_partkey as n from lineitem) where k % 4 <> 2)
select module, name, case when count(*) = 1 then min(origin) end as origin, case when count(*) = 1 then min(origin_name) end as origin_name, case when count(*) = 1 then 'resolved' else 'ambiguous' end as state from every group by module, name""")
def link_origins(spark, d):
    """Named, renamed and star exports through chains of barrels, to the end"""
    facts, files = _facts(spark, d)
    found = linking.modules(linking.specs_of(facts), files)
    return linking.origins(linking.exports_of(facts, found), linking.bindings_of(facts, found).withColumnRenamed("file", "module"))


def _calls_sql(moved: str) -> str:
    """The linked calls; `moved`: by how many lines a supplier's file is moved down."""
    return f"""with {_P}, t as (select *, {moved} as m from s), c as (
select file, v.* from t, lateral (values
  (4 + m, 'supply' || s || '@' || 4 + m, 'calls', 'check', null, file || '#check@' || 5 + m, 'own', 'resolved'), (4 + m, 'supply' || s || '@' || 4 + m, 'calls', 'check', null, file || '#check@' || 5 + m, 'own', 'resolved'),
  (6 + m, 'rate@' || 6 + m, 'calls', 'supply' || s, null, file || '#supply' || s || '@' || 4 + m, 'own', 'resolved'),
  (7 + m, 'Depot' || s || '@' || 7 + m, 'inherits', 'Base', null, file || '#Base@' || 10 + m, 'own', 'resolved'), (8 + m, 'open@' || 8 + m, 'calls', 'check', null, file || '#check@' || 5 + m, 'own', 'resolved')) v(line, who, relation, name, owner, target, layer, state)
union all select p.file, v.* from p join t using (s), lateral (values
  (0, 2, 'make' || k || '@2', 'calls', 'get', null, t.file || '#supply' || s || '@' || 4 + m, 'import', 'resolved'), (0, 2, 'make' || k || '@2', 'calls', 'rate', null, t.file || '#rate@' || 6 + m, 'import', 'resolved'),
  (1, 2, 'make' || k || '@2', 'calls', 'supply', 'sup', t.file || '#supply' || s || '@' || 4 + m, 'barrel', 'resolved'),
  (1, 2, 'make' || k || '@2', 'calls', 'rate', 'sup', case when s % 5 = 0 then t.file || '#rate@' || 6 + m end, case when s % 5 = 0 then 'barrel' end, case when s % 5 = 0 then 'resolved' else 'ambiguous' end),
  (2, 2, 'make' || k || '@2', 'calls', 'get', null, t.file || '#supply' || s || '@' || 4 + m, 'import', 'resolved'), (2, 2, 'make' || k || '@2', 'calls', 'missing' || k, null, null, null, 'missing'), (2, 2, 'make' || k || '@2', 'calls', 'make' || k, null, p.file || '#make' || k || '@2', 'own', 'resolved'),
  (3, 2, 'Part' || k || '@2', 'inherits', 'Depot' || s, null, t.file || '#Depot' || s || '@' || 7 + m, 'barrel', 'resolved'),
  (3, 3, 'run@3', 'calls', 'pace', null, case when s % 5 = 0 then t.file || '#rate@' || 6 + m end, case when s % 5 = 0 then 'barrel' end, case when s % 5 = 0 then 'resolved' else 'ambiguous' end)) w(shape, line, who, relation, name, owner, target, layer, state),
  lateral (select w.line, w.who, w.relation, w.name, w.owner, w.target, w.layer, w.state) v where k % 4 = shape)
select file, line, file || '#' || who as caller, relation, name, owner, target, layer, state from c"""


@query(_calls_sql("0"))
def link_calls(spark, d):
    """Own symbols, then import bindings, then barrel origins, with ambiguity as a state"""
    facts, files = _facts(spark, d)
    return linking.link(facts, files)[1]


@query(_calls_sql("case when s % 10 = 3 then 1 else 0 end"))
def streaming_maintained_calls(spark, d):
    """A graph built whole, then brought up to date after a tenth of the suppliers' files moved down a line"""
    scratch = Scratch(spark, "maintained")
    graph = incremental.SourceGraph(spark, f"{scratch.base}/graph", most_changed=1 << 40, most_affected=1 << 40)
    files = scratch.write(source_files(spark, d), "files")
    graph.rebuild(files)
    moved = F.when(F.col("file").rlike(r"supp/s\d*3\.js$"), F.concat(F.lit("// moved\n"), "text")).otherwise(F.col("text"))
    graph.refresh(scratch.write(files.withColumn("text", moved), "later"))
    return graph.table("calls")


@query(f"""with {_P}, u as (
  select s.file || '#supply' || s || '@4' as id, count(*) as refs from p join s using (s) where k % 4 in (0, 2) group by all
  union all select s.file || '#rate@6', count(*) from p join s using (s) where k % 4 = 0 group by all
  union all select file || '#supply' || s || '@4', 1 from s)
select id, cast(sum(refs) as bigint) as refs from u group by id""")
def link_external_references(spark, d):
    """Uses of imported names and namespace members, re-exports as one"""
    files = source_files(spark, d)
    facts, names = _facts(spark, d)
    found = linking.modules(linking.specs_of(facts), names)
    return linking.external_references(javascript.uses(files), linking.bindings_of(facts, found), linking.exports_of(facts, found), linking.symbols_of(facts))
