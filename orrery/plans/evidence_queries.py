"""Evidence queries bound to the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import clones, evidence, history, paging
from orrery.plans.review_queries import _PT, _SYM, _points, _symbols
from orrery.plans.star import GRAPH_SQL, edges, nodes, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("select c_nationkey as client, c_mktsegment as module, count(*) as n_files, min(c_custkey % 6) as nearest from customer group by 1, 2")
def contracts_affected_modules(spark, d):
    """A21"""
    files = table(spark, d, "customer").select(F.col("c_nationkey").alias("client"), F.col("c_mktsegment").alias("module"), F.col("c_custkey").alias("file"), (F.col("c_custkey") % 6).alias("distance"))
    return evidence.affected_modules(files)


@query(f"with {_SYM}, {_PT}, i as (select distinct on (point) point, id from q join s on q.file = s.file and line between lo and hi order by point, lo desc, hi, id), r as (select coalesce(i.id::varchar, q.file) as source, point % 500 as name from q left join i using (point)) select distinct source, p_partkey::varchar as target from r join part on p_partkey % 500 = name where p_size <= 20 and source <> p_partkey::varchar")
def resolve_schema_references(spark, d):
    """J5"""
    refs = _points(spark, d).withColumn("name", F.col("point") % 500)
    objects = table(spark, d, "part").where("p_size <= 20").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 500).alias("name"))
    return evidence.schema_references(refs, objects, _symbols(spark, d).select("file", "id", "lo", "hi"))


@query("""select substring(sha256('{"evidence":"' || regexp_replace(e, ':\\d+\\b', '', 'g') || '","kind":"' || l_linestatus || '","ruleId":"' || l_returnflag || '"}'), 1, 32) as fingerprint, count(*) as n from (select *, 'P' || l_partkey || '.js:' || l_linenumber || ' > S' || l_suppkey || ':' || l_linenumber as e from lineitem) group by 1""")
def rules_fingerprints(spark, d):
    """R5"""
    e = F.concat(F.lit("P"), "l_partkey", F.lit(".js:"), "l_linenumber", F.lit(" > S"), "l_suppkey", F.lit(":"), "l_linenumber")
    return table(spark, d, "lineitem").groupBy(evidence.fingerprint(F.col("l_returnflag"), F.col("l_linestatus"), e).alias("fingerprint")).agg(F.count("*").alias("n"))


@query("select l_orderkey as \"group\", count(*) as n_members, count(*) >= 2 and (bool_and(l_returnflag = 'R') or bool_and(l_linestatus = 'O')) as suppressed from lineitem group by 1")
def clones_suppressed(spark, d):
    """R21"""
    router = F.col("l_returnflag") == "R"
    file = F.concat(F.lit("src/a"), "l_partkey", F.when(router, ".router.ts").otherwise(".ts"))
    return evidence.suppressed_groups(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), file.alias("file"), F.when(router, " Router() ").otherwise("router").alias("label"), (F.col("l_linestatus") == "O").alias("declarative")))


_TASK = ["customer", "supplier", "s5"]


@query(GRAPH_SQL + """, c as (select id, 100 as base from nodes where id in ('S5', 'C7') union all select id, 45 from nodes where id in ('S5', 'N1', 'N3')),
  h as (select distinct id from c where id[1] in ('S', 'C') union all select target from edges where relation = 'contains' and source in (select id from c where id[1] = 'N')),
  g as (select id, count(*) as degree from (select source as id from edges union all select target from edges) group by 1),
  a as (select * from c union all select h.id, 22 + least(12, coalesce(degree, 0)) from h left join g using (id))
  select id, sum(base + 8 * len(list_intersect(list_distinct(regexp_split_to_array(lower(label || ' ' || id || ' ' || kind), '[^a-z0-9]+')), ['customer', 'supplier', 's5'])))::bigint as score
  from a join nodes using (id) where kind in ('customer', 'supplier', 'part') group by 1 order by score desc, id limit 3""")
def rank_task_symbols(spark, d):
    """R16"""
    n = nodes(spark, d).withColumn("is_symbol", F.col("kind").isin("customer", "supplier", "part"))
    return evidence.task_symbols(_TASK, n, edges(spark, d), n.where("id in ('S5', 'C7')").select("id"), n.where("id in ('S5', 'N1', 'N3')").select("id"))


_SCORES = "r as (select p_partkey as id, p_size as s0, p_size - p_partkey % 2 as s1, p_size - p_partkey % 3 as s2 from part)"


@query(f"with {_SCORES}, a as (select 0 as concept, id, s0 as score from r where s0 > 0 order by score desc, id limit 1), b as (select 1 as concept, id, s1 as score from r where s1 > 0 and id not in (select id from a) order by score desc, id limit 1), c as (select 2 as concept, id, s2 as score from r where s2 > 0 and id not in (select id from a union all select id from b) order by score desc, id limit 1) select concept, id, score::bigint as score from (from a union all from b union all from c)")
def rank_concept_seeds(spark, d):
    """W5"""
    p = table(spark, d, "part")
    scores = p.select(F.col("p_partkey").alias("id"), F.posexplode(F.array(*[F.col("p_size").cast("long") - (F.col("p_partkey") % k) for k in (1, 2, 3)])).alias("concept", "score"))
    return evidence.concept_seeds(scores, 3)


@query("select repo, path, line from (select source as repo, doc_id as path, unnest(string_split(text, chr(10))) as body, generate_subscripts(string_split(text, chr(10)), 1) as line from documents) where contains(lower(body), 'license')")
def search_content(spark, d):
    """F12"""
    return evidence.content_search(table(spark, d, "documents").select(F.col("source").alias("repo"), F.col("doc_id").alias("path"), "text"), "License")


@query("with u as (select * from orders where o_orderpriority = '1-URGENT') select row_number() over (order by o_totalprice desc, o_orderkey) as rank, o_orderkey, count(*) over () as total, case when count(*) over () > 50 then replace(replace(rtrim(base64(encode('{\"v\":1,\"f\":\"' || substr(sha256('orders' || chr(10) || 'urgent'), 1, 24) || '\",\"o\":50}')), '='), '+', '-'), '/', '_') end as next_cursor, cast(least(greatest(round(o_orderkey % 6000 / 40.0), 20), 120) as integer) as nodes from u qualify rank > 25 and rank <= 50")
def paging_by_cursor(spark, d):
    """K2, K3, K4: the page after a cursor, the next cursor, and node budgets"""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    own = paging.fingerprint("orders", "urgent")
    got = paging.page(o, [F.desc("o_totalprice"), F.col("o_orderkey")], own, paging.cursor(own, 25), 25)
    return got.select("rank", "o_orderkey", "total", "next_cursor", paging.node_budget(F.col("o_orderkey") % 6000).alias("nodes"))


@query("with recursive p as (select c_custkey as a, c_custkey + 7 as b, 50 + c_custkey % 50 as similarity from customer where c_custkey % 21 < 14 and c_custkey + 7 in (select c_custkey from customer)), e as (select a, b from p union select b, a from p), r as (select distinct a as id, a as root from e union select e.b, r.root from r join e on e.a = r.id), c as (select id, min(root) as component from r group by 1), f as (select component, c_nationkey as location, arg_min(c_custkey % 90, c_custkey) as tokens from c join customer on c_custkey = id group by 1, 2), l as (select component, max(similarity) as strongest, min(similarity) as weakest from p join c on c.id = p.a group by 1), s as (select component, count(*) as members, cast(sum(tokens) as bigint) as tokens, array_to_string(list_sort(list(location)), ',') as first from f group by 1) select component, members, tokens, strongest, weakest, first from s join l using (component)")
def clones_group_evidence(spark, d):
    """A40, A20"""
    c = table(spark, d, "customer")
    ids = c.select(F.col("c_custkey").alias("b"))
    pairs = c.where("c_custkey % 21 < 14").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 7).alias("b"), (50 + F.col("c_custkey") % 50).alias("similarity")).join(ids, "b", "left_semi")
    fragments = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("location"), (F.col("c_custkey") % 90).alias("tokens"))
    return clones.group_evidence(pairs, fragments).withColumn("first", F.array_join("first", ","))


@query("with m as (select max(ts) - interval 1 day as now from events) select event_type, count(*) as n from events, m where ts <= now and ts >= now - interval 5 day group by 1")
def evidence_fresh(spark, d):
    """T6"""
    e = table(spark, d, "events").select("ts", "event_type")
    now = e.agg((F.max("ts") - F.expr("interval 1 day")).alias("now"))
    return evidence.fresh_evidence(e.crossJoin(F.broadcast(now)), F.col("now"), 5).groupBy("event_type").agg(F.count("*").alias("n"))  # one row


@query("select 'r' || p_size % 4 || '/' || case when p_size % 3 = 0 then 'in/' else '' end || p_partkey as file, p_brand as name, case when p_size % 4 = 3 and p_size % 3 = 0 then 'r3/in' else 'r' || p_size % 4 end as manifest, case when p_brand = case when p_size % 4 = 3 and p_size % 3 = 0 then 'Brand#13' else 'Brand#1' || p_size % 4 end then 'self' when p_brand in ('Brand#2' || p_size % 4, 'Brand#3' || p_size % 4) and not (p_size % 4 = 3 and p_size % 3 = 0) then 'declared' else 'missing' end as state from part where p_size % 4 > 0")
def resolve_owned_dependencies(spark, d):
    """Folders r1 to r3 and r3/in have manifests, r0 has none; r3/in declares nothing"""
    folder = F.concat(F.lit("r"), F.col("p_size") % 4, F.when(F.col("p_size") % 3 == 0, "/in").otherwise(""))
    files = table(spark, d, "part").select(F.concat(folder, F.lit("/"), "p_partkey").alias("file"), F.col("p_brand").alias("name"))
    manifests = spark.createDataFrame([("r1", "Brand#11"), ("r2", "Brand#12"), ("r3", "Brand#13"), ("r3/in", "Brand#13")], "manifest string, package string")
    declared = spark.createDataFrame([(f"r{k}", f"Brand#2{k}", f"Brand#3{k}") for k in (1, 2, 3)], "manifest string, alias string, package string")
    return evidence.owned_dependencies(files, manifests, declared)


@query("with k as (select o_custkey, count(distinct o_orderkey) as n from orders group by 1) select count(*) as commits, cast(sum(case when n > 20 then 1 else 0 end) as bigint) as omitted from k")
def history_omitted_commits(spark, d):
    """What co-change leaves out"""
    return history.omitted_commits(table(spark, d, "orders").select(F.col("o_custkey").alias("commit"), F.col("o_orderkey").alias("file")), 20)


@query("with t as (select l_orderkey as id, sum(case when l_linenumber >= 3 then 1 else 0 end) as c, sum(case when l_linenumber >= 3 and l_quantity > 35 then 1 else 0 end) as m, sum(case when l_linenumber >= 3 and l_returnflag = 'R' then 1 else 0 end) as x from lineitem group by 1) select id, case when c > 0 and m = 0 then case when x > 0 then 'HTTP_METHOD_MISMATCH' else 'NO_STATIC_CLIENT_CALLERS' end when m > 0 and x > 0 then 'CLIENTS_AT_RISK_WITH_METHOD_MISMATCHES' when m > 0 then 'CLIENTS_AT_RISK' else 'NO_ENDPOINTS_MATCHED' end as verdict from t")
def contracts_verdict(spark, d):
    """All five verdicts"""
    late = F.col("l_linenumber") >= 3
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count_if(late).alias("c"), F.count_if(late & (F.col("l_quantity") > 35)).alias("m"), F.count_if(late & (F.col("l_returnflag") == "R")).alias("x"))
    return t.select("id", evidence.contract_verdict(F.col("c"), F.col("m"), F.col("x")).alias("verdict"))
