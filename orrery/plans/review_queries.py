"""Range, resolution, liveness and verdict queries bound to the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.paths import path_classes
from orrery.operators import liveness, ranges, resolve, rollup, traverse
from orrery.plans.graph_queries import CLS, SEM
from orrery.plans.star import GRAPH_SQL, edges, nodes, table

G = GRAPH_SQL
QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# Brands are files, parts are symbols with a range of lines, orders are points in a file.
_SYM = "s as (select p_brand as file, p_partkey as id, p_name as name, p_partkey % 1000 as lo, p_partkey % 1000 + p_size as hi from part)"
_PT = "q as (select o_orderkey as point, 'Brand#' || (1 + o_orderkey % 5) || (1 + o_custkey % 5) as file, o_custkey % 1000 as line, o_orderkey % 20 as more from orders)"


def _symbols(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_partkey") % 1000).alias("lo"), (F.col("p_partkey") % 1000 + F.col("p_size")).alias("hi"))


def _points(spark, d):
    file = F.concat(F.lit("Brand#"), 1 + F.col("o_orderkey") % 5, 1 + F.col("o_custkey") % 5)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("point"), file.alias("file"), (F.col("o_custkey") % 1000).alias("line"), (F.col("o_orderkey") % 20).alias("more"))


@query(f"with {_SYM}, {_PT} select distinct on (point) point, id as symbol from q join s on q.file = s.file and line between lo and hi order by point, lo desc, hi, id")
def range_innermost_symbol(spark, d):
    """F19, J6"""
    return ranges.innermost(_points(spark, d), _symbols(spark, d))


@query(f"with {_SYM}, {_PT} select distinct on (point) point as hunk, id as symbol from q join s on q.file = s.file and line <= hi and lo <= line + more order by point, id % 7 = point % 7 desc, hi - lo, id")
def range_hunk_symbols(spark, d):
    """J16"""
    hunks = _points(spark, d).select(F.col("point").alias("hunk"), "file", F.col("line").alias("from"), (F.col("line") + F.col("more")).alias("to"))
    return ranges.hunk_symbols(hunks, _symbols(spark, d), (F.col("hunk") % 7, F.col("id") % 7))


@query(f"with {_SYM}, {_PT}, l as (select file, line, bool_or(more >= 10) as hit from q group by 1, 2), fp as (select file, (100 * count(*) filter (hit)) // count(*) as pct from l group by 1), o as (select id, count(*) as total, count(*) filter (hit) as covered from s join l on s.file = l.file and line between lo and hi group by 1) select s.id, coalesce(total, 0) as total, coalesce(covered, 0)::bigint as covered, coalesce((100 * covered) // total, fp.pct)::bigint as pct from s left join o on s.id = o.id left join fp on fp.file = s.file")
def range_coverage(spark, d):
    """A25"""
    lines = _points(spark, d).groupBy("file", "line").agg(F.bool_or(F.col("more") >= 10).alias("hit"))
    return ranges.range_coverage(_symbols(spark, d), lines)


@query(f"with {_SYM}, {_PT}, k as (select file, id, lo, hi, id % 20 as name from s), o as (select file, more as name, line, count(*) as n from q group by all) select k.id, coalesce(sum(n) filter (line < lo or line > hi), 0)::bigint as n_outside from k left join o on k.file = o.file and k.name = o.name group by 1")
def range_references_outside(spark, d):
    """A28"""
    occurrences = _points(spark, d).select("file", F.col("more").alias("name"), "line", F.lit(1).alias("n"))
    return ranges.references_outside(_symbols(spark, d).withColumn("name", F.col("id") % 20), occurrences)


@query(G + f", r as (select source as container, {CLS} as kind, line from edges where relation = 'calls'), x as (select container, string_agg(line::varchar, ',' order by line) as lines from (select *, row_number() over (partition by container order by line) as k from (select distinct container, line from r)) where k <= 3 group by 1) select r.container, count(*) as n, count(*) filter (kind = 'runtime') as n_runtime, count(*) filter (kind = 'compile') as n_compile, count(*) filter (kind = 'type') as n_type, any_value(lines) as lines from r join x on r.container = x.container group by 1")
def refs_usage_groups(spark, d):
    """A38"""
    refs = edges(spark, d, ("calls",)).select(F.col("source").alias("container"), rollup.edge_class().alias("kind"), "line")
    return ranges.usage_groups(refs, ["runtime", "compile", "type"])


_SCOPES = """with c as (select distinct l_suppkey as file, l_suppkey % 10 as folder, l_partkey % 200 as name from lineitem), own as (select l_suppkey as file, l_partkey % 200 as name, min(l_orderkey) as near from lineitem where l_linenumber = 1 group by all),
wide as (select l_suppkey % 10 as folder, l_partkey % 200 as name, min(l_orderkey) as far from lineitem where l_linenumber >= 6 group by all having min(l_orderkey) = max(l_orderkey))
select file, name, coalesce(near, far) as target, case when near is not null then 'file' when far is not null then 'folder' end as scope from c left join own using (file, name) left join wide using (folder, name)"""


@query(_SCOPES)
def resolve_scopes(spark, d):
    """J2"""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), (F.col("l_suppkey") % 10).alias("folder"), (F.col("l_partkey") % 200).alias("name"), F.col("l_orderkey").alias("id"), "l_linenumber")
    return resolve.scopes(li.select("file", "folder", "name").distinct(), li.where("l_linenumber = 1"), li.where("l_linenumber >= 6"))


def _side(df, key, nation):
    kind = F.element_at(F.array(F.lit("graphql"), F.lit("grpc"), F.lit("event")), (F.col(key) % 3 + 1).cast("int"))
    return df.select(F.col(key).alias("id"), kind.alias("transport"), F.when(F.col(key) % 4 > 0, F.col(nation)).alias("service"), (F.col(key) % 40).alias("method"), (F.col(key) % 2).alias("side"))


_SIDE = "select {0} as id, ['graphql', 'grpc', 'event'][{0} % 3 + 1] as transport, case when {0} % 4 > 0 then {1} end as service, {0} % 40 as method, {0} % 2 as side from {2}"
_TRANSPORT = f"""with c as ({_SIDE.format('c_custkey', 'c_nationkey', 'customer')}), s as ({_SIDE.format('s_suppkey', 's_nationkey', 'supplier')})
select c.id as client, s.id as server, c.transport from c join s using (transport, service, method) where c.transport <> 'event'
union all select c.id, u.id, 'grpc' from c join (select method, min(id) as id from s where transport = 'grpc' group by 1 having count(*) = 1) u on c.method = u.method where c.transport = 'grpc' and c.service is null
union all select c.id, s.id, 'event' from c join s on c.transport = 'event' and s.transport = 'event' and c.method = s.method and c.side <> s.side"""


@query(_TRANSPORT)
def resolve_transports(spark, d):
    """J9"""
    return resolve.transports(_side(table(spark, d, "customer"), "c_custkey", "c_nationkey"), _side(table(spark, d, "supplier"), "s_suppkey", "s_nationkey"))


@query("""with e as (select s_suppkey as endpoint, s_suppkey % 50 as name, s_nationkey as folder, s_nationkey || '/' || s_suppkey % 4 as file, s_suppkey % 90 as line from supplier),
s as (select c_custkey as id, c_custkey % 50 as name, c_nationkey as folder, c_nationkey || '/' || c_custkey % 4 as file, c_custkey % 90 as line from customer),
i as (select distinct s_nationkey || '/' || s_suppkey % 4 as file, o_custkey as id from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey),
m as (select endpoint, s.id, (case when e.file = s.file then 100 else 0 end + case when e.folder = s.folder then 40 else 0 end + case when i.id is not null then 35 else 0 end + case when e.file = s.file and abs(e.line - s.line) <= 20 then 20 else 0 end) as score from e join s on e.name = s.name left join i on i.file = e.file and i.id = s.id),
b as (select *, rank() over (partition by endpoint order by score desc) as k from m)
select endpoint, case when count(*) = 1 then min(id) end as handler, min(score) as score, case when count(*) = 1 then 'resolved' else 'ambiguous' end as state from b where k = 1 group by 1""")
def resolve_handlers(spark, d):
    """J10"""
    su, cu = table(spark, d, "supplier"), table(spark, d, "customer")
    file = F.concat_ws("/", "s_nationkey", F.col("s_suppkey") % 4)
    endpoints = su.select(F.col("s_suppkey").alias("endpoint"), (F.col("s_suppkey") % 50).alias("name"), F.col("s_nationkey").alias("folder"), file.alias("file"), (F.col("s_suppkey") % 90).alias("line"))
    symbols = cu.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 50).alias("name"), F.col("c_nationkey").alias("folder"), F.concat_ws("/", "c_nationkey", F.col("c_custkey") % 4).alias("file"), (F.col("c_custkey") % 90).alias("line"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("id"))
    imports = table(spark, d, "lineitem").join(orders, "l_orderkey").join(su.withColumnRenamed("s_suppkey", "l_suppkey").select("l_suppkey", "s_nationkey"), "l_suppkey")
    return resolve.handlers(endpoints, symbols, imports.select(F.concat_ws("/", "s_nationkey", F.col("l_suppkey") % 4).alias("file"), "id"))


@query("with s as (select p_partkey as id, lower(p_brand || p_size) as name, p_type as file from part), k as (select name from s group by 1 having count(*) between 2 and 12) select x.name, x.id as a, y.id as b from s x join s y on x.name = y.name and x.id < y.id and x.file <> y.file where x.name in (select name from k)")
def resolve_name_twins(spark, d):
    """J14"""
    return resolve.name_twins(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_size").alias("name"), F.col("p_type").alias("file")))


@query("with s as (select distinct event_type, user_id from events where user_id % 3 = 0), o as (select event_type, user_id, count(*) as n from events where value > 0 group by all) select event_type, user_id, coalesce(n, 0) as n_observed, case when s.user_id is null then 'runtime' else 'static' end as origin from (select event_type, user_id, n from o) o2 full join s using (event_type, user_id)")
def resolve_contract_merge(spark, d):
    """J17"""
    e = table(spark, d, "events")
    return resolve.merge_contracts(e.where("user_id % 3 = 0"), e.where("value > 0"), ["event_type", "user_id"])


@query(G + ", b as (select distinct source, target, relation from edges where relation = 'imports'), a as (select id from nodes where kind = 'part' and loc <= 400), x as (select source, target, relation from b where source like '%3' union select target, source, relation from b where target like '%7'), e as (select * from x where source in (select id from a) and target in (select id from a)) select *, 'INFERRED' as provenance from (select * from b except select * from e) union all select *, 'EXACT' from e")
def resolve_overlay(spark, d):
    """J18"""
    b = edges(spark, d, ("imports",)).select("source", "target", "relation")
    turned = b.where("target like '%7'").select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
    return resolve.merge_overlay(b, b.where("source like '%3'").unionByName(turned), nodes(spark, d).where("kind = 'part' and loc <= 400"))


@query(G + ", r as (select distinct case loc % 3 when 0 then file when 1 then 'ci/work/' || file else 'other/' || id end as path from nodes), e as (select path, array_to_string(p[i:len(p)], '/') as file from (select path, string_split(path, '/') as p, unnest(range(1, len(string_split(path, '/')) + 1)) as i from r)), m as (select path, arg_max(e.file, length(e.file)) as file from e join (select distinct file from nodes) k on e.file = k.file group by 1) select r.path, m.file from r left join m on r.path = m.path")
def resolve_report_files(spark, d):
    """J19"""
    n = nodes(spark, d)
    path = F.when(F.col("loc") % 3 == 0, F.col("file")).when(F.col("loc") % 3 == 1, F.concat(F.lit("ci/work/"), "file")).otherwise(F.concat(F.lit("other/"), "id"))
    return resolve.report_files(n.select(path.alias("path")), n)


@query("select p_partkey as call, (i - 1)::int as position, a[i] as argument, b[i] as parameter from (select p_partkey, string_split(p_type, ' ') as a, string_split(p_name, ' ') as b, unnest(range(1, least(12, greatest(len(string_split(p_type, ' ')), len(string_split(p_name, ' ')))) + 1)) as i from part)")
def resolve_call_arguments(spark, d):
    """J20"""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("call"), F.split("p_type", " ").alias("arguments"), F.split("p_name", " ").alias("parameters"))
    return resolve.call_arguments(p)


@query(G.replace("with ", "with recursive ", 1) + """, own as (select id as module, case when loc % 50 = 0 then 'default' else label end as name from nodes where kind = 'part'), st as (select source as module, target as src from edges where relation = 'imports'),
a(module, name, origin) as (select module, name, module from own union select st.module, a.name, a.origin from a join st on st.src = a.module where a.name <> 'default' and not exists (select 1 from own where own.module = st.module and own.name = a.name))
select module, name, case when count(*) = 1 then min(origin) end as origin, case when count(*) = 1 then 'resolved' else 'ambiguous' end as state from a group by 1, 2""")
def resolve_reexports(spark, d):
    """J4, G14"""
    own = nodes(spark, d).where("kind = 'part'").select(F.col("id").alias("module"), F.when(F.col("loc") % 50 == 0, "default").otherwise(F.col("label")).alias("name"))
    star = edges(spark, d, ("imports",)).select(F.col("source").alias("module"), F.col("target").alias("from"))
    return resolve.reexports(own, star)


@query("select l_orderkey as name, min(l_returnflag) as method, min(l_linestatus) as argument, min(l_suppkey % 3) as file from lineitem group by 1 having count(distinct (l_returnflag, l_linestatus, l_suppkey % 3)) = 1")
def resolve_wrappers(spark, d):
    """F21"""
    li = table(spark, d, "lineitem")
    return resolve.wrappers(li.select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("argument"), (F.col("l_suppkey") % 3).alias("file")))


@query("""with i as (select distinct n_name || '.' || c_mktsegment || '.' || c_custkey as name, n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey), a as (select n_nationkey as artifact, n_name as prefix from nation union all select n_nationkey, n_name || '.BUILDING' from nation union all select n_nationkey + 100, n_name || '.BUILDING' from nation where n_nationkey % 2 = 0)
, m as (select name, prefix, min(artifact) as artifact, count(distinct artifact) as n from i join a on prefix = n_name or prefix = n_name || '.' || c_mktsegment group by 1, 2), b as (select name, arg_max(case when n = 1 then artifact else -1 end, length(prefix)) as artifact from m group by 1) select i.name, nullif(artifact, -1) as artifact from i left join b on i.name = b.name""")
def resolve_artifact_owner(spark, d):
    """J21"""
    n = table(spark, d, "nation")
    names = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "n_name", "c_mktsegment", "c_custkey").alias("name"))
    long = F.concat(F.col("n_name"), F.lit(".BUILDING")).alias("prefix")
    a = n.select(F.col("n_nationkey").alias("artifact"), F.col("n_name").alias("prefix"))
    a = a.unionByName(n.select(F.col("n_nationkey").alias("artifact"), long)).unionByName(n.where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 100).alias("artifact"), long))
    return resolve.artifact_owner(names, a)


_FILES = G + ", m as (select a.file as from_file, b.file as to_file, a.module as from_module, b.module as to_module, type_only or compile_only as late, relation from edges join f a on a.id = source join f b on b.id = target where a.file <> b.file)"


@query(_FILES + " select from_file, to_file, case when bool_and(late) then 'type' else 'runtime' end as kind from m where relation in ('imports', 'calls') group by 1, 2")
def reach_file_imports(spark, d):
    """G20"""
    return liveness.file_imports(edges(spark, d, ("imports", "calls")), nodes(spark, d))


@query(_FILES.replace("with ", "with recursive ", 1) + ", r as (select file from nodes where id in ('P1', 'P2', 'P3') union select to_file from r join (select distinct from_file, to_file from m where relation = 'imports') e on r.file = e.from_file) select * from r")
def reach_files(spark, d):
    """G8"""
    n = nodes(spark, d)
    return liveness.file_reach(edges(spark, d, ("imports",)), n, n.where("id in ('P1', 'P2', 'P3')").select(F.col("file").alias("id")))


@query(G + """, e as (select source, target, max(case when relation = 'imports' then 3 when relation = 'calls' then 2 else 1 end) as c from edges where relation in ('imports', 'calls', 'references') and source <> target group by 1, 2),
t as (select distinct id from nodes where file like 'test/%' order by id limit 250), l0 as (select id as test, id as file, 0 as distance, 3 as score from t),
l1 as (select test, e.target as file, 1 as distance, max(least(score, c)) as score from l0 join e on e.source = l0.file where test <> e.target group by all),
l2 as (select test, e.target as file, 2 as distance, max(least(score, c)) as score from l1 join e on e.source = l1.file where test <> e.target group by all),
s as (select * from l1 union all select * from l2 x where not exists (select 1 from l1 y where y.test = x.test and y.file = x.file))
select file, test, distance, score from (select *, row_number() over (partition by file order by distance, score desc, test) as k from s) where k <= 3""")
def reach_nearest_tests(spark, d):
    """G12, W6"""
    e = edges(spark, d, ("imports", "calls", "references"))
    c = F.when(F.col("relation") == "imports", 3).when(F.col("relation") == "calls", 2).otherwise(1)
    tests = nodes(spark, d).where(F.array_contains(path_classes(F.col("file")), "test"))
    return liveness.nearest_tests(e.select("source", "target", c.alias("confidence")), tests, 2)


@query(G.replace("with ", "with recursive ", 1) + """, c as (select source, target, min(line) as line from edges where relation in ('calls', 'references') and not type_only and not compile_only group by 1, 2), w as (select source, target from (select *, row_number() over (partition by source order by line, target) as k from c) where k <= 6),
r as (select 'C1' as id, 0 as depth union select target, depth + 1 from r join w on source = id where depth < 4) select min(depth)::int as depth, id from r group by id order by 1, id limit 40""")
def reach_call_trace(spark, d):
    """G13"""
    return liveness.call_trace(edges(spark, d, ("calls", "references")), "C1")


@query("with m as (select r_name, n_name from region join nation on r_regionkey = n_regionkey), p as (select n_name as router, '/' || r_name || '/' || n_name as prefix from m) select distinct router, prefix || '/' || c_mktsegment as path from p join nation on n_name = router join customer on c_nationkey = n_nationkey")
def reach_mount_paths(spark, d):
    """G15"""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    mounts = r.select(F.lit("app").alias("parent"), F.concat(F.lit("R."), "r_name").alias("child"), F.concat(F.lit("/"), "r_name").alias("prefix"))
    mounts = mounts.unionByName(r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat(F.lit("R."), "r_name").alias("parent"), F.col("n_name").alias("child"), F.concat(F.lit("/"), "n_name").alias("prefix")))
    routes = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("router"), F.concat(F.lit("/"), "c_mktsegment").alias("path")).distinct()
    return liveness.mount_paths(mounts, routes)


_LIVE = G + """, u as (select target as id, count(*) as n, count(*) filter (s.file not like 'test/%') as product from edges join nodes s on s.id = source where relation = 'imports' group by 1),
w as (select label as name, count(*) as seen from nodes where kind in ('part', 'supplier') group by 1), sy as (select id, replace(file, '/part/' || id, '') as file, 'n' || id as name, loc > 250 as is_exported, loc = 500 as is_special from nodes where kind = 'part'),
fr as (select 'nP' || l_partkey as name, count(*) as seen from lineitem where l_linenumber >= 5 and l_quantity >= 49 group by 1),
v as (select sy.id, file, sy.name, is_exported, coalesce(n, 0) as n_inbound, coalesce(n, 0) = 0 and not is_special and coalesce(seen, 0) <= 1 as dead, coalesce(n, 0) > 0 and coalesce(product, 0) = 0 as test_only from sy left join u on sy.id = u.id left join fr on fr.name = sy.name)"""


def _live(spark, d):
    n = nodes(spark, d)
    tests = n.select(F.col("id").alias("source"), F.array_contains(path_classes(F.col("file")), "test").alias("from_test"))
    uses = edges(spark, d, ("imports",)).join(tests, "source").select("target", "from_test")
    file = F.regexp_replace("file", "/part/P[0-9]+$", "")
    symbols = n.where("kind = 'part'").select("id", file.alias("file"), F.concat(F.lit("n"), "id").alias("name"), (F.col("loc") > 250).alias("is_exported"), (F.col("loc") == 500).alias("is_special"))
    seen = table(spark, d, "lineitem").where("l_linenumber >= 5 and l_quantity >= 49").groupBy(F.concat(F.lit("nP"), "l_partkey").alias("name")).agg(F.count("*").alias("n"))
    return liveness.symbol_liveness(symbols, uses, seen)


@query(_LIVE + " select id, file, n_inbound, dead, test_only from v")
def liveness_symbols(spark, d):
    """R6, R7"""
    return _live(spark, d).select("id", "file", "n_inbound", "dead", "test_only")


@query(_LIVE + ", g as (select *, file || '#' || length(id) || right(id, 2) as piece from v) select piece as file, count(*) as n_symbols from g group by 1 having bool_and(dead) and sum(n_inbound) = 0 and not bool_or(piece like 'src%')")
def liveness_dead_files(spark, d):
    """R8"""
    live = _live(spark, d).withColumn("file", F.concat("file", F.lit("#"), F.length("id"), F.right(F.col("id"), F.lit(2))))
    return liveness.dead_files(live, live.where("file like 'src%'").select("file").distinct())


@query(_LIVE + ", wd as (select distinct p_brand as brand, 'nP' || l_partkey as name from lineitem join part on p_partkey = l_suppkey where l_discount > 0.09 and l_quantity >= 48) select id from v where is_exported and n_inbound = 0 and not exists (select 1 from wd where wd.name = v.name and wd.brand <> split_part(v.file, '/', 2))")
def liveness_unused_exports(spark, d):
    """R9"""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_suppkey"), F.col("p_brand").alias("file"))
    words = table(spark, d, "lineitem").where("l_discount > 0.09 and l_quantity >= 48").join(p, "l_suppkey").select("file", F.concat(F.lit("nP"), "l_partkey").alias("name"))
    live = _live(spark, d).withColumn("file", F.split_part("file", F.lit("/"), F.lit(2)))
    return liveness.unused_exports(live, words)


@query(_LIVE + ", g as (select case when file like 'test/%' then 'tests' when file like 'vendor/%' then 'classified' when is_exported then 'kind' when n_inbound > 0 then 'confidence' else 'kept' end as bucket from v) select bucket, count(*) as n from g group by 1")
def liveness_gates(spark, d):
    """F16"""
    gate = liveness.first_gate([("tests", F.col("file").startswith("test/")), ("classified", F.col("file").startswith("vendor/")), ("kind", F.col("is_exported")), ("confidence", F.col("n_inbound") > 0)])
    return _live(spark, d).groupBy(gate.alias("bucket")).agg(F.count("*").alias("n"))


@query(_LIVE + " select id, case when is_exported then 'low' when n_inbound = 0 and dead then 'high' else 'medium' end as confidence from v")
def liveness_confidence(spark, d):
    """R10"""
    none = F.lit(False)
    return _live(spark, d).select("id", liveness.dead_code_confidence(~F.col("is_exported"), (F.col("n_inbound") == 0) & F.col("dead"), F.col("is_exported"), none).alias("confidence"))


_RANK = "['info', 'low', 'medium', 'high', 'critical']"


@query(f"with f as (select o_orderkey, {_RANK}[o_orderkey % 5 + 1] as severity, o_orderpriority as category, o_orderkey % 5 as k, o_orderkey % 3 = 0 as c1, o_orderkey % 4 = 0 as c2, o_orderkey % 10 = 1 as no_path from orders) select o_orderkey from f where (no_path or not c1 or not c2) and k >= 2 and category in ('1-URGENT', '2-HIGH')")
def verdict_audit_filter(spark, d):
    """F20"""
    k = F.col("o_orderkey")
    none = k % 10 == 1
    f = table(spark, d, "orders").select(
        k, F.element_at(F.array(*map(F.lit, liveness.SEVERITY)), (k % 5 + 1).cast("int")).alias("severity"), F.col("o_orderpriority").alias("category"),
        F.when(~none, F.array(F.lit("a"), F.lit("b"))).alias("paths"), F.when(~none, F.array(k % 3 == 0, k % 4 == 0)).alias("classified"),
    )
    return liveness.audit_filter(f, "medium", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("select l_partkey as id, case when bool_or(l_linenumber in (1, 2) and l_discount > 0.08) then 'NOT_DEAD' when bool_or(l_linenumber = 3) then 'POSSIBLE' else 'UNKNOWN' end as verdict from lineitem group by 1")
def verdict_external_use(spark, d):
    """A23"""
    sure = (F.col("l_linenumber") <= 2) & (F.col("l_discount") > 0.08)
    return liveness.external_use(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.when(sure, "high").when(F.col("l_linenumber") == 3, "low").otherwise("none").alias("confidence")))


@query(f"select o_orderkey, {_RANK}[case when o_orderstatus = 'O' then o_orderkey % 5 + 1 else greatest(o_orderkey % 5, 1) end] as severity from orders")
def verdict_lowered_severity(spark, d):
    """R18"""
    s = F.element_at(F.array(*map(F.lit, liveness.SEVERITY)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", liveness.lowered_severity(s, F.col("o_orderstatus") == "O").alias("severity"))


@query("select o_custkey, case when bool_or(o_totalprice > 450000) then 'BLOCKED' when bool_or(o_orderstatus = 'P') then 'UNKNOWN' else 'PASS' end as verdict, case when count(*) filter (o_totalprice > 450000) > 0 then 'FAIL' when bool_and(o_orderstatus <> 'P') then 'PASS' else 'UNKNOWN' end as section from orders group by 1")
def verdict_changes_and_sections(spark, d):
    """R19, R25"""
    big, part = F.col("o_totalprice") > 450000, F.col("o_orderstatus") == "P"
    own = table(spark, d, "orders").groupBy("o_custkey").agg(liveness.change_verdict(big, part).alias("verdict"), F.count_if(big).alias("n"), F.bool_and(~part).alias("complete"))
    return own.select("o_custkey", "verdict", liveness.section_verdict(F.col("n"), F.col("complete")).alias("section"))


_TWINS = "with p as (select l_suppkey as name, l_orderkey as a, l_partkey as b, cast(l_quantity as bigint) * 2 as similarity from lineitem)"


def _twins(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("name"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), (F.col("l_quantity").cast("long") * 2).alias("similarity"))


@query(_TWINS + " select name, max(similarity) as closest, min(similarity) as farthest, case when max(similarity) >= 98 then 'clone' when min(similarity) <= 4 then 'collision' else 'review' end as verdict from p group by 1")
def verdict_twins(spark, d):
    """R22"""
    return liveness.twin_verdicts(_twins(spark, d), 98, 4)


@query(_TWINS + " select distinct on (name) name, a, b, similarity from p where similarity < 60 order by name, similarity, a, b")
def verdict_divergence(spark, d):
    """R26"""
    return liveness.divergence(_twins(spark, d))


@query(_FILES + ", x as (select distinct from_module, to_module, from_file, to_file from m where relation in ('imports', 'calls', 'references') and from_module <> to_module), b as (select from_module, to_module, count(*) as n_pairs from x group by 1, 2 order by n_pairs desc, 1, 2 limit 100) select from_module, to_module, any_value(n_pairs) as n_pairs, string_agg(from_file || '>' || to_file, ',' order by from_file || '>' || to_file) as samples, 'proposed' as state from (select x.*, n_pairs, row_number() over (partition by from_module, to_module order by from_file, to_file) as k from x join b using (from_module, to_module)) where k <= 3 group by 1, 2")
def verdict_component_directions(spark, d):
    """A39"""
    pairs = rollup.with_files(edges(spark, d, ("imports", "calls", "references")), nodes(spark, d)).where("from_module <> to_module")
    return liveness.component_directions(pairs)


@query("select l_partkey as package, count(distinct l_shipmode) filter (strong) as n_strong, case when count(distinct l_shipmode) filter (strong) >= 2 then 'high' else 'medium' end as severity from (select l_partkey, l_linenumber as l_shipmode, l_discount >= 0.1 as strong from lineitem) where l_partkey not in (select l_partkey from lineitem where l_quantity = 50) group by 1 having count(*) filter (strong) > 0")
def verdict_malware_signals(spark, d):
    """A36"""
    li = table(spark, d, "lineitem")
    signals = li.select(F.col("l_partkey").alias("package"), F.col("l_linenumber").alias("key"), (F.col("l_discount") >= 0.1).alias("strong"))
    return liveness.malware_score(signals, li.where("l_quantity = 50").select(F.col("l_partkey").alias("package")).distinct())


@query(G + " select target as id, sum(case relation when 'calls' then 30 when 'references' then 10 else 0 end + case when type_only then 8 else 0 end)::bigint as score from edges group by 1 order by score desc, id limit 40")
def rank_precision_targets(spark, d):
    """R23"""
    return liveness.precision_targets(edges(spark, d).withColumn("inferred", F.col("type_only")))


@query("select l_suppkey as item, count(*) as refs, round(100 * log2(count(*) + 1))::bigint as weight from lineitem group by 1 order by refs desc, item limit 24")
def rank_items(spark, d):
    """A41"""
    return liveness.ranked_items(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item")))


@query(G + f", dg as (select id from (select source as id from edges where {SEM} union select target from edges where {SEM})) select id from nodes where kind not in ('nation', 'region') or id in (select id from dg) or contains(lower(label), 'a')")
def filter_low_signal(spark, d):
    """F8"""
    return liveness.low_signal(nodes(spark, d), rollup.degrees(edges(spark, d)), ["nation", "region"], ["a"])


@query("with u as (select distinct c_nationkey as owner, c_mktsegment as technology from customer where c_custkey % 3 = 0), w as (select owner, unnest(['BUILDING', 'MACHINERY']) as technology from (select distinct owner from u)) select owner, technology, 'missing' as state from (select * from w except select * from u) union all select owner, technology, 'forbidden' from u where technology = 'HOUSEHOLD'")
def rules_technologies(spark, d):
    """R4"""
    used = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("technology"))
    return liveness.technology_rules(used, ["BUILDING", "MACHINERY"], ["HOUSEHOLD"])


@query("select p_partkey, greatest(case p_size % 4 when 0 then 0 when 1 then 2 when 2 then 4 else 5 end, case when p_size > 25 then 3 else 0 end)::int as time_rank from part")
def rules_complexity_rank(spark, d):
    """R12"""
    return table(spark, d, "part").select("p_partkey", liveness.complexity_rank(F.col("p_size") % 4, (F.col("p_size") > 25).cast("int")).alias("time_rank"))


@query("select n_name as component, case when n_nationkey % 3 = 0 then 'introduced' else 'resolved' end as state from nation where n_nationkey % 3 < 2 union all select n_name, 'changed' from nation where n_nationkey % 3 = 2 and (select count(*) from customer where c_nationkey = n_nationkey) > 0")
def diff_cycles(spark, d):
    """Customers of a nation as a component; every third nation is only old, only new, or has lost its last customer."""
    n = table(spark, d, "nation")
    own = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_name").alias("component"), (F.col("n_nationkey") % 3).alias("g"))
    last = own.groupBy("component").agg(F.max("id").alias("last"))
    new = own.join(last, "component").where("g = 0 or (g = 2 and id <> last)")
    return liveness.cycle_delta(own.where("g <> 0").select("id", "component"), new.select("id", "component"))
