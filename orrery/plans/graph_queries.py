"""Graph queries bound to the test tables, and their SQL. The letter-digit in a docstring is the inventory id."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.paths import path_classes, territory
from orrery.operators import components, rollup, traverse
from orrery.plans.star import GRAPH_SQL, edges, nodes

G = GRAPH_SQL
CLS = "case when type_only then 'type' when compile_only then 'compile' else 'runtime' end"
SEM = "relation not in ('contains', 'method') and not barrel_proxy"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(G + f"select 'kind:' || kind as metric, count(*) as value from nodes group by 1 union all select 'relation:' || relation, count(*) from edges group by 1 union all select 'class:' || {CLS}, count(*) from edges group by 1")
def rollup_graph_stats(spark, d):
    """A1"""
    return rollup.graph_stats(nodes(spark, d), edges(spark, d))


_PROV = "case when relation = 'contains' then 'EXTRACTED' when relation = 'calls' and line % 3 = 0 then 'EXACT_LSP' when relation = 'calls' then 'RESOLVED' when relation = 'references' then 'INFERRED' end"


@query(G + f", p as (select coalesce({_PROV}, 'UNKNOWN') as provenance from edges) select k as provenance, count(p.provenance) as n, (select count(*) from p where provenance = 'UNKNOWN') = 0 as complete from unnest(['EXACT_LSP','EXTRACTED','RESOLVED','INFERRED','CONFLICT','UNKNOWN']) t(k) left join p on p.provenance = k group by k")
def rollup_provenance(spark, d):
    """A2"""
    return rollup.provenance(edges(spark, d).withColumn("provenance", F.expr(_PROV)))


@query(G + "select module, count(distinct file) as files, count(*) as members, sum(loc)::bigint as loc from (select f.module, nodes.* from nodes join f using (id)) group by 1")
def rollup_modules(spark, d):
    """A3"""
    return rollup.modules(nodes(spark, d))


@query(G + f", e as (select a.file as from_file, b.file as to_file, {CLS} as edge_class, relation, count(*) as c from edges join f a on a.id = source join f b on b.id = target where relation <> 'contains' and not barrel_proxy and a.file <> b.file group by all) select from_file, to_file, edge_class, sum(c)::bigint as n, first(relation order by c desc, relation) as relation from e group by 1, 2, 3")
def rollup_file_edges(spark, d):
    """A4, J7"""
    return rollup.file_edges(edges(spark, d), nodes(spark, d))


@query(G + f"select a.module as from_module, b.module as to_module, {CLS} as edge_class, count(*) as n from edges join f a on a.id = source join f b on b.id = target where relation <> 'contains' and not barrel_proxy and a.module <> b.module group by 1, 2, 3")
def rollup_module_edges(spark, d):
    """A5, J7"""
    return rollup.module_edges(edges(spark, d), nodes(spark, d))


@query(G + "select source, target, count(*) as n from edges where relation = 'calls' and source <> target group by 1, 2")
def rollup_call_multigraph(spark, d):
    """A6"""
    return rollup.multigraph(edges(spark, d, ("calls",)))


@query(G + f"select count(distinct a.file) as files, count(distinct a.module) as modules, count(*) as edges, count(distinct a.module || '>' || b.module) as module_pairs from edges join f a on a.id = source join f b on b.id = target where {SEM}")
def rollup_totals(spark, d):
    """A7"""
    e = rollup.with_files(rollup.semantic(edges(spark, d)), nodes(spark, d))
    return e.agg(F.countDistinct("from_file").alias("files"), F.countDistinct("from_module").alias("modules"), F.count("*").alias("edges"), F.countDistinct(F.concat_ws(">", "from_module", "to_module")).alias("module_pairs"))


@query(G + ", k as (select array_to_string(string_split(file, '/')[1:2], '/') as territory, kind, count(*) as n, min(file) as ff from nodes group by 1, 2) select territory, sum(n)::bigint as members, first(kind order by n desc, kind) as kind, min(ff) as first_file from k group by 1 order by 2 desc, 1 limit 8")
def rollup_communities(spark, d):
    """A8, K1"""
    return rollup.communities(nodes(spark, d), territory(F.col("file")))


@query(G + f", b as (select source as id, 0 as i, 1 as o from edges where {SEM} union all select target, 1, 0 from edges where {SEM}) select id, sum(i)::bigint as n_in, sum(o)::bigint as n_out, count(*) as degree from b group by 1 order by 4 desc, 1 limit 50")
def hubs_degree_hotspots(spark, d):
    """A9, K1"""
    return rollup.degrees(edges(spark, d)).orderBy(F.desc("degree"), "id").limit(50)


_HUBS = f", b as (select source as id, target as other, not type_only and not compile_only as rt, 1 as o from edges where {SEM} union all select target, source, not type_only and not compile_only, 0 from edges where {SEM}), p as (select id, other, bool_or(rt) as rt, count(*) as n, sum(o) as o from b group by 1, 2), h as (select id, count(*) as neighbours, count(*) filter (where rt) as runtime, count(*) filter (where not rt) as compile_only, sum(n)::bigint as occurrences, sum(o)::bigint as n_out from p group by 1)"


@query(G + _HUBS + " select * from h order by neighbours desc, occurrences desc, id limit 10")
def hubs_god_nodes(spark, d):
    """A10, F7"""
    return rollup.hubs(edges(spark, d))


@query(G + _HUBS + " select id, occurrences, neighbours, occurrences - neighbours as repeats from h where id not in (select id from h order by neighbours desc, occurrences desc, id limit 10) and occurrences >= 20 and occurrences - neighbours >= 10 order by 4 desc, 1 limit 5")
def hubs_repeat_hotspots(spark, d):
    """A11"""
    return rollup.repeat_hotspots(edges(spark, d))


@query(G + "select direction, relation, other, count(*) as sites from (select 'out' as direction, relation, target as other from edges where source = 'S1' union all select 'in', relation, source from edges where target = 'S1') group by 1, 2, 3")
def hubs_neighbours(spark, d):
    """G1, A12"""
    return rollup.neighbours(edges(spark, d), "S1")


@query(G + "select target as other, relation, count(*) as n, array_to_string(list_sort(list_distinct(list(line)))[1:5], ',') as lines, bool_or(type_only or compile_only) as compile_time from edges where source = 'C1' group by 1, 2")
def hubs_context_groups(spark, d):
    """A13"""
    return rollup.context_groups(edges(spark, d), "C1")


_CLASS = {"test": "/(test|tests)/|^tests?/", "docs": "^docs?/", "generated": "^generated/", "vendored": "^vendor/"}


@query(G + "select id, coalesce(case split_part(file, '/', 1) when 'test' then 'test' when 'docs' then 'docs' when 'generated' then 'generated' when 'vendor' then 'vendored' end, '') as classes from nodes")
def filter_path_classes(spark, d):
    """F1, F2"""
    return nodes(spark, d).select("id", F.array_join(path_classes(F.col("file")), ",").alias("classes"))


@query(G + ", k as (select id from nodes where file not like 'test/%') select source, target, relation, count(*) as n from edges where source in (select id from k) and target in (select id from k) group by 1, 2, 3")
def filter_no_tests(spark, d):
    """both ends must be kept; two semi joins"""
    keep = nodes(spark, d).where(~F.array_contains(path_classes(F.col("file")), "test")).select("id")
    e = edges(spark, d).groupBy("source", "target", "relation").agg(F.count("*").alias("n"))
    return e.join(keep.withColumnRenamed("id", "source"), "source", "left_semi").join(keep.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "relation", "n")


@query(G + ", t as (select id from nodes where file like 'test/%') select id from t union select target as id from edges where source in (select id from t)")
def filter_tests_only(spark, d):
    """F4"""
    tests = nodes(spark, d).where(F.array_contains(path_classes(F.col("file")), "test")).select("id")
    return tests.union(edges(spark, d).join(tests.withColumnRenamed("id", "source"), "source", "left_semi").select("target")).distinct()


@query(G + "select id, file from nodes where starts_with(file || '/', 'src/nation3/')")
def filter_scope(spark, d):
    """F5"""
    return nodes(spark, d).where(F.concat("file", F.lit("/")).startswith("src/nation3/")).select("id", "file")


_BFS = ", recursive"


def _bfs_sql(pairs: str, seeds: str, depth: int) -> str:
    head = G.replace("with nodes", "with recursive nodes", 1)
    return head + f", e as materialized ({pairs}), walk(id, depth) as (select id, 0 from ({seeds}) union select e.b, w.depth + 1 from walk w join e on e.a = w.id where w.depth < {depth}) select id, min(depth)::int as depth from walk group by 1"


@query(_bfs_sql("select distinct source as a, target as b from edges where not barrel_proxy", "select id from nodes where id in ('R1', 'C7')", 3))
def traverse_bfs(spark, d):
    """Bounded, multi-seed, forward"""
    return traverse.layered(edges(spark, d).where("not barrel_proxy"), nodes(spark, d).where(F.col("id").isin("R1", "C7")), 3)


@query(_bfs_sql("select distinct target as a, source as b from edges where relation = 'imports'", "select 'P1' as id union select 'P2'", 6))
def traverse_reverse_importers(spark, d):
    """G16, G17, G22"""
    e = edges(spark, d, ("imports",)).select(F.col("target").alias("source"), F.col("source").alias("target"))
    return traverse.layered(e, spark.createDataFrame([("P1",), ("P2",)], "id string"), 6)


@query(G.replace("with nodes", "with recursive nodes", 1) + f", e as materialized (select distinct target as a, source as b, type_only or compile_only as f from edges where {SEM}), walk(id, s, depth) as (select 'P3', false, 0 union select e.b, w.s or e.f, w.depth + 1 from walk w join e on e.a = w.id where w.depth < 3) select id, coalesce(min(depth) filter (where not s), -1)::int as runtime_depth, coalesce(min(depth) filter (where s), -1)::int as compile_depth from walk where id <> 'P3' group by 1")
def traverse_reverse_reach(spark, d):
    """G5"""
    return traverse.reverse_reach(rollup.semantic(edges(spark, d)), spark.createDataFrame([("P3",)], "id string"), 3).fillna(-1)


@query(_bfs_sql("select distinct source as a, target as b from edges where not barrel_proxy union select target, source from edges where not barrel_proxy", "select 'R0' as id", 4).replace("select id, min(depth)::int as depth from walk group by 1", "select min(depth)::int as hops from walk where id = 'P5'"))
def traverse_shortest_path(spark, d):
    """Length of the path from a region to a part"""
    return traverse.shortest_path(edges(spark, d).where("not barrel_proxy"), "R0", "P5", 4).agg(F.max("hop").alias("hops"))


@query(G.replace("with nodes", "with recursive nodes", 1) + ", e as materialized (select distinct source as a, target as b from edges where relation = 'imports'), reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b), m as (select r.a as id, r.b as other from reach r join reach s on s.a = r.b and s.b = r.a where r.a <> r.b) select id, least(id, min(other)) as component from m group by 1")
def components_scc(spark, d):
    """G6"""
    return traverse.strong_components(edges(spark, d, ("imports",)))


@query(G.replace("with nodes", "with recursive nodes", 1) + ", e as materialized (select distinct source as a, target as b from edges where relation = 'imports' union select target, source from edges where relation = 'imports'), reach(a, b) as (select a, a from e union select r.a, e.b from reach r join e on e.a = r.b) select a as id, min(b) as component from reach group by 1")
def components_connected(spark, d):
    """G9, A20"""
    return components.connected_components(edges(spark, d, ("imports",)), "source", "target")


@query(G + "select id, file from nodes where id not in (select source from edges where relation <> 'contains') and id not in (select target from edges where relation <> 'contains') and kind <> 'region'")
def traverse_orphans(spark, d):
    """G19"""
    e = edges(spark, d).where("relation <> 'contains'")
    used = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return nodes(spark, d).where("kind <> 'region'").join(used, "id", "left_anti").select("id", "file")
