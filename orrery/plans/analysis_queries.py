"""History, comparison, dependency, rule, text and contract queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.paths import ignored, route, words_of_name
from orrery.operators import clones, compare, history, rollup, rules
from orrery.plans.graph_queries import CLS, SEM
from orrery.plans.star import CHANGES_SQL, GRAPH_SQL, changes, edges, nodes, table

G = GRAPH_SQL
C = f"with {CHANGES_SQL} "
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(C + 'select file, count(distinct "commit") as commits, sum(additions)::bigint as additions, sum(deletions)::bigint as deletions, sum(additions + deletions)::bigint as churn from changes group by 1')
def history_file_churn(spark, d):
    """A14"""
    return history.churn(changes(spark, d))


_PAIRS = C + ', per as (select file, count(*) as own from changes group by 1), p as (select x.file as a, y.file as b, count(*) as n from changes x join changes y on x."commit" = y."commit" and x.file < y.file group by 1, 2 having count(*) >= 2), m as (select a, b, n, round(n / (l.own + r.own - n), 4) as jaccard, round(n * (select count(distinct "commit") from changes) / (l.own * r.own), 4) as lift, round(greatest(n / l.own, n / r.own), 4) as confidence from p join per l on l.file = a join per r on r.file = b)'


@query(_PAIRS + " select * from m")
def history_cochange(spark, d):
    """A15, A16"""
    return history.cochange(changes(spark, d))


@query(C + f", {GRAPH_SQL[5:].rsplit(', f as', 1)[0]}, ch as (select file, sum(additions + deletions) as churn from changes group by 1), dg as (select id, count(*) as degree from (select source as id from edges where {SEM} union all select target from edges where {SEM}) group by 1), j as (select file, churn::bigint as churn, degree from ch join dg on id = file), s as (select file, churn, degree, round(sqrt(round(round(cume_dist() over (order by churn), 4) * round(cume_dist() over (order by degree), 4), 8)), 4) as score from j where churn > 0) select * from s order by score desc, file limit 50")
def history_hotspots(spark, d):
    """W1, W2, K1"""
    return history.hotspots(history.churn(changes(spark, d)).select("file", "churn"), rollup.degrees(edges(spark, d)))


@query(_PAIRS + f", {GRAPH_SQL[5:].rsplit(', f as', 1)[0]}, e as materialized (select distinct source as a, target as b from edges where relation = 'imports' union select target, source from edges where relation = 'imports') select m.* from m where not exists (select 1 from e where e.a = m.a and e.b = m.b) and not exists (select 1 from e x join e y on x.b = y.a where x.a = m.a and y.b = m.b)")
def history_hidden_pairs(spark, d):
    """G10"""
    return history.hidden(history.cochange(changes(spark, d)), edges(spark, d, ("imports",)))


_CUT = "timestamp '1998-04-01'"


@query(G + f", o as (select distinct source, target, relation from edges where ts < {_CUT}), n as (select distinct source, target, relation from edges where ts >= {_CUT}) select *, 'added' as state from (select * from n except select * from o) union all select *, 'removed' from (select * from o except select * from n)")
def diff_edges(spark, d):
    """D2"""
    e = edges(spark, d, ("calls", "references"))
    return compare.changed(e.where(f"ts < {_CUT}"), e.where(f"ts >= {_CUT}"), ["source", "target", "relation"])


@query(G + f", mp as (select a.module as from_module, b.module as to_module, {CLS} as edge_class, ts from edges join f a on a.id = source join f b on b.id = target where {SEM} and a.module <> b.module), o as (select distinct from_module, to_module, edge_class from mp where ts < {_CUT}), n as (select distinct from_module, to_module, edge_class from mp where ts >= {_CUT}) select *, 'added' as state from (select * from n except select * from o) union all select *, 'removed' from (select * from o except select * from n)")
def diff_module_drift(spark, d):
    """D4"""
    e = rollup.with_files(rollup.semantic(edges(spark, d, ("calls", "references"))), nodes(spark, d)).where("from_module <> to_module").withColumn("edge_class", rollup.edge_class())
    return compare.changed(e.where(f"ts < {_CUT}"), e.where(f"ts >= {_CUT}"), ["from_module", "to_module", "edge_class"])


@query(G + f", o as materialized (select target, min(ts) as a, max(ts) as b from edges where {SEM} group by 1) select n.id from nodes n join o on o.target = n.id where a < timestamp '1995-07-01' and b < timestamp '2001-06-01'")
def diff_orphaned(spark, d):
    """D5"""
    e = rollup.semantic(edges(spark, d, ("calls", "references")))
    return compare.orphaned(e.where("ts < timestamp '1995-07-01'"), e.where("ts >= timestamp '2001-06-01'"), nodes(spark, d))


@query("with k as (select p_name, p_brand, p_size, p_partkey, row_number() over (partition by p_brand, p_size order by p_partkey) - 1 as o from part), a as (select p_brand, p_size, o from (select *, row_number() over (partition by p_brand, p_size order by p_partkey) - 1 as o from part where p_partkey % 10 <> 0)), b as (select p_brand, p_size, o from (select *, row_number() over (partition by p_brand, p_size order by p_partkey) - 1 as o from part where p_partkey % 7 <> 0)) select p_brand as label, p_size::bigint as line, o as ordinal, 'added' as state from (select * from b except select * from a) union all select p_brand, p_size::bigint, o, 'removed' from (select * from a except select * from b)")
def diff_nodes(spark, d):
    """D1, W3"""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), F.col("p_size").cast("long").alias("size"), F.lit(0).alias("line"))
    old, new = (compare.stable_keys(p.where(c), ["label", "size"]) for c in ("id % 10 <> 0", "id % 7 <> 0"))
    return compare.changed(old, new, ["label", "size", "ordinal"]).withColumnRenamed("size", "line")


_FIND = "select o_orderkey, substr(sha1(concat_ws('|', 'large-order', o_orderpriority, o_custkey)), 1, 16) as finding from orders where o_totalprice > 300000 and o_orderdate {} " + _CUT


@query(f"with o as (select distinct finding from ({_FIND.format('<')})), n as (select distinct finding from ({_FIND.format('>=')})) select coalesce(o.finding, n.finding) as finding, case when o.finding is null then 'new' when n.finding is null then 'fixed' else 'existing' end as state from o full join n on o.finding = n.finding")
def diff_debt(spark, d):
    """D7, D8, F15"""
    o = table(spark, d, "orders").where("o_totalprice > 300000").withColumn("finding", rules.finding_id(F.lit("large-order"), F.col("o_orderpriority"), F.col("o_custkey")))
    return compare.debt(o.where(f"o_orderdate < {_CUT}"), o.where(f"o_orderdate >= {_CUT}"))


@query("with a as (select doc_id as path, md5(text) as h from documents where doc_id % 11 <> 0), b as (select doc_id as path, md5(case when doc_id % 7 = 0 then upper(text) else text end) as h from documents where doc_id % 13 <> 0) select coalesce(a.path, b.path) as path from a full join b on a.path = b.path where a.h is distinct from b.h")
def diff_changed_paths(spark, d):
    """D10"""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    a = docs.where("path % 11 <> 0").select("path", F.md5("text").alias("hash"))
    b = docs.where("path % 13 <> 0").select("path", F.md5(F.when(F.col("path") % 7 == 0, F.upper("text")).otherwise(F.col("text"))).alias("hash"))
    return compare.changed_paths(a, b)


@query(G + ", c as (select source, target, relation from edges where relation = 'imports'), k as (select id from nodes where kind = 'part' and loc <= 400), s as (select source, target, 'imports2' as relation from c where source like '%3'), m as (select * from c where source not like '%3' union all select * from s) select source, target, relation from m where source in (select id from k) and target in (select id from k)")
def diff_scoped_merge(spark, d):
    """D11"""
    e = edges(spark, d, ("imports",)).select("source", "target", "relation")
    n = nodes(spark, d)
    affected = n.where("kind = 'part' and id like '%3'")
    return compare.scoped_merge(e, e.withColumn("relation", F.lit("imports2")), affected, n.where("kind = 'part' and loc <= 400")).select("source", "target", "relation")


@query("select distinct on (c_nationkey) c_nationkey, c_custkey, c_name from customer order by c_nationkey, c_acctbal desc, c_custkey")
def diff_first_of(spark, d):
    """D12"""
    return compare.first_of(table(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), "c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@query("with u as (select distinct l_partkey from lineitem join orders on l_orderkey = o_orderkey where o_orderdate < timestamp '1995-07-01') select p_partkey, 'unused-dep' as rule, substr(sha1(concat_ws('|', 'unused-dep', p_partkey)), 1, 16) as finding from part where p_partkey not in (select l_partkey from u) and p_partkey % 5 <> 0 union all select l_partkey, 'missing-dep', substr(sha1(concat_ws('|', 'missing-dep', l_partkey)), 1, 16) from u where l_partkey % 5 = 0")
def deps_unused_and_missing(spark, d):
    """J12, finding ids"""
    used = table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_orderdate < timestamp '1995-07-01'"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p_partkey")).distinct()
    declared = table(spark, d, "part").where("p_partkey % 5 <> 0").select("p_partkey")
    out = [a.withColumn("rule", F.lit(r)).withColumn("finding", rules.finding_id(F.lit(r), F.col("p_partkey"))) for r, a in (("unused-dep", declared.join(used, "p_partkey", "left_anti")), ("missing-dep", used.join(declared, "p_partkey", "left_anti")))]
    return out[0].unionByName(out[1])


@query("select p_brand as package, count(distinct l_suppkey) as files, count(*) as imports, min(l_linenumber) as first_line, bool_and(l_returnflag = 'R') as type_only, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') as kinds from lineitem join part on p_partkey = l_partkey group by 1")
def deps_usage_index(spark, d):
    """A18, A37, W9"""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("package")).agg(F.countDistinct("l_suppkey").alias("files"), F.count("*").alias("imports"), F.min("l_linenumber").alias("first_line"), F.bool_and(F.col("l_returnflag") == "R").alias("type_only"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("kinds"))


@query("select p_name as package, count(distinct p_brand) as sections from part group by 1 having count(distinct p_brand) >= 2")
def deps_duplicate_declarations(spark, d):
    """A19"""
    return table(spark, d, "part").groupBy(F.col("p_name").alias("package")).agg(F.countDistinct("p_brand").alias("sections")).where("sections >= 2")


@query("with u as (select l_partkey, bool_or(l_returnflag = 'N') as rt, bool_or(l_returnflag = 'R') as ty, count(*) as n from lineitem where l_shipdate < timestamp '1995-09-01' group by 1) select p_partkey, case when rt then 'DIRECT_RUNTIME' when ty then 'TYPE_ONLY' when n > 0 then 'NON_PRODUCT' else 'NOT_OBSERVED' end as state from part left join u on l_partkey = p_partkey")
def deps_package_reachability(spark, d):
    """A22"""
    u = table(spark, d, "lineitem").where("l_shipdate < timestamp '1995-09-01'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("rt"), F.bool_or(F.col("l_returnflag") == "R").alias("ty"), F.count("*").alias("n"))
    return table(spark, d, "part").select("p_partkey").join(u, "p_partkey", "left").select("p_partkey", F.when(F.col("rt"), "DIRECT_RUNTIME").when(F.col("ty"), "TYPE_ONLY").when(F.col("n") > 0, "NON_PRODUCT").otherwise("NOT_OBSERVED").alias("state"))


@query("with a as (select distinct 'A' || p_brand as id, p_name from part) select distinct a.id, 'npm' as ecosystem, part.p_name as name, p_size || '.' || p_partkey % 10 as version from part join a on a.p_name = part.p_name where (p_size > 5 or p_size = 5 and p_partkey % 10 >= 2) and (p_size < 20 or p_size = 20 and p_partkey % 10 < 3)")
def deps_advisories(spark, d):
    """Numeric order of versions"""
    p = table(spark, d, "part")
    packages = p.select(F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.concat_ws(".", "p_size", F.col("p_partkey") % 10).alias("version"), "p_brand")
    adv = p.select(F.concat(F.lit("A"), "p_brand").alias("id"), F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.lit("5.2").alias("introduced"), F.lit("20.3").alias("fixed"), F.lit(None).cast("string").alias("last")).distinct()
    out = rules.affected(packages.drop("p_brand"), adv)
    return out


@query(G + ", o(prefix) as (values ('src'), ('src/nation3'), ('src/nation3/customer'), ('docs'), ('test/nation1')), j as (select file, prefix, row_number() over (partition by file order by length(prefix) desc) as r from nodes join o on starts_with(file || '/', prefix || '/')) select file, prefix as owner from j where r = 1")
def deps_longest_prefix(spark, d):
    """J13, W7"""
    own = spark.createDataFrame([(x,) for x in ("src", "src/nation3", "src/nation3/customer", "docs", "test/nation1")], "prefix string")
    return rules.longest_prefix(nodes(spark, d).select("file").distinct(), own)


@query("with d as (select source, case when quality = 1 then 1.0 when quality = 0 then 0.0 end as c from documents left join labels using (doc_id)) select source as module, count(*) as files, count(c) as measured, round(avg(c), 4) as coverage from d group by 1")
def coverage_rollup(spark, d):
    """A24"""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("files"), F.count("quality").alias("measured"), F.round(F.avg(F.col("quality").cast("double")), 4).alias("coverage"))


@query("with g as (select c_nationkey, count(*) as degree, avg(case when c_acctbal > 0 then 1.0 else 0.0 end) as cov from customer group by 1) select c_nationkey, degree, round(degree * (1 - cov), 4) as risk from g where cov < 0.95")
def coverage_risk(spark, d):
    """R13"""
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("degree"), F.avg(F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0)).alias("cov"))
    return g.where("cov < 0.95").select("c_nationkey", "degree", F.round(F.col("degree") * (1 - F.col("cov")), 4).alias("risk"))


@query(G + f", p as (select distinct a.file as from_file, b.file as to_file from edges join f a on a.id = source join f b on b.id = target where {SEM}) select 'src/** -> test/**' as rule, from_file, to_file from p where from_file like 'src/%' and to_file like 'test/%' union all select 'docs/** -> vendor/**', from_file, to_file from p where from_file like 'docs/%' and to_file like 'vendor/%'")
def rules_boundary(spark, d):
    """R1, F13"""
    e = rollup.with_files(rollup.semantic(edges(spark, d)), nodes(spark, d))
    return rules.boundary(e.select("from_file", "to_file").distinct(), [("src/**", "test/**"), ("docs/**", "vendor/**")])


@query(G + f", p as (select a.module as from_module, b.module as to_module, count(*) as n from edges join f a on a.id = source join f b on b.id = target where {SEM} group by 1, 2) select * from p where from_module = 'test/nation1' and to_module not in ('test/nation1', 'src/nation2', 'src/nation3')")
def rules_allowed_only(spark, d):
    """R2"""
    e = rollup.with_files(rollup.semantic(edges(spark, d)), nodes(spark, d)).groupBy("from_module", "to_module").agg(F.count("*").alias("n"))
    return rules.allowed_only(e, {"test/nation1": ["src/nation2", "src/nation3"]})


@query(G + "select id, 'loc' as budget, loc::double as value from nodes where loc > 300")
def rules_budgets(spark, d):
    """R3"""
    return rules.over_budget(nodes(spark, d), {"loc": 300})


@query(G + f", p as (select distinct a.file as ff, b.file as tf, a.module as fm, b.module as tm from edges join f a on a.id = source join f b on b.id = target where {SEM}), u as (select fm as module, fm = tm as own from p union all select tm, false from p where fm <> tm), g as (select module, count(*) filter (where own) as internal, count(*) filter (where not own) as boundary from u group by 1) select module, internal, boundary, round(internal / (internal + boundary), 4) as cohesion, round(boundary / (internal + boundary), 4) as boundary_ratio from g")
def rules_fitness(spark, d):
    """A30, A31, R3"""
    return rules.fitness(rollup.semantic(edges(spark, d)), nodes(spark, d))


@query("select p_partkey as id, concat_ws(',', case when p_size >= 40 then 'p_size:HIGH' when p_size >= 25 then 'p_size:WARNING' end, case when p_retailprice >= 1800 then 'p_retailprice:HIGH' when p_retailprice >= 1400 then 'p_retailprice:WARNING' end) as breaches, case when p_size >= 40 or p_retailprice >= 1800 then 'high' else 'medium' end as severity from part where p_size >= 25 or p_retailprice >= 1400")
def rules_threshold_breaches(spark, d):
    """R24, K5"""
    v = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice")
    return rules.breaches(v, {"p_size": (25, 40), "p_retailprice": (1400, 1800)}).select("id", "breaches", "severity")


@query("with s as (select l_suppkey as id, count(*) as calls, max(l_linenumber) as depth, count(distinct l_partkey) as fo, count(distinct l_orderkey) as fi, avg(l_discount) * 10 as cov, avg(l_tax) * 100 as t from lineitem group by 1) select id, round(0.72 * greatest(0, least(100, 12 * floor(t) / 2 + 5 * (depth % 4) + least(18.0, 10 * (id % 20) / 8) + least(12.0, 6 * calls / 12) + least(18.0, 5 * (depth % 3)))) + 0.20 * greatest(0, least(100, 20 * log2(1.0 + fi) + 10 * log2(1.0 + fo))) + 0.08 * 100 * (1 - floor(cov)), 4) as score from s")
def rules_hot_paths(spark, d):
    """R11"""
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("calls"), F.max("l_linenumber").alias("depth"), F.countDistinct("l_partkey").alias("fo"), F.countDistinct("l_orderkey").alias("fi"), (F.avg("l_discount") * 10).alias("cov"), (F.avg("l_tax") * 100).alias("t"))
    return s.select("id", rules.hot_path_score(F.floor("t") / 2, F.col("depth") % 4, (F.col("id") % 20).cast("double"), F.col("calls").cast("double"), (F.col("depth") % 3).cast("double"), F.col("fi"), F.col("fo"), F.floor("cov")).alias("score"))


@query("select o_orderpriority as severity, o_orderstatus as category, count(*) as n from orders group by 1, 2")
def findings_rollup(spark, d):
    """A17"""
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("category")).agg(F.count("*").alias("n"))


_TOK = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
_FP = f"with t as materialized (select doc_id as id, {_TOK} as t from documents), g as materialized (select id, list_transform(range(1, len(t) - 6), lambda i: ('0x' || substr(md5(array_to_string(t[i:i + 7], ' ')), 1, 8))::bigint) as g from t), w as materialized (select distinct id, unnest(list_transform(range(1, len(g) - 1), lambda i: list_min(g[i:i + 3]))) as fp from g where len(g) >= 3)"


@query(_FP + ", r as materialized (select fp, count(*) as n from w group by 1 having count(*) <= 120), k as materialized (select id, fp from w where fp in (select fp from r)), z as (select id, count(*) as n from k group by 1), p as (select x.id as a, y.id as b, count(*) as shared from k x join k y on x.fp = y.fp and x.id < y.id group by 1, 2 having count(*) >= 2) select a, b, shared, floor(shared / (m.n + q.n - shared) * 100)::bigint as similarity from p join z m on m.id = a join z q on q.id = b join t u on u.id = a join t v on v.id = b where (shared >= 8 and shared / (m.n + q.n - shared) >= 0.5) or (least(len(u.t), len(v.t)) < 30 and shared / (m.n + q.n - shared) >= 0.95)")
def clones_pairs(spark, d):
    """W8, D3, J15, F17"""
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return clones.clone_pairs(clones.fingerprints(texts), clones.token_counts(texts))


@query(f"with t as (select doc_id, unnest({_TOK}) as w from documents) select w as name, count(*) as n, count(distinct doc_id) as files from t group by 1")
def text_identifier_frequency(spark, d):
    """A26, A27"""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")
    return table(spark, d, "documents").select("doc_id", F.explode(w).alias("name")).groupBy("name", "doc_id").count().groupBy("name").agg(F.sum("count").alias("n"), F.count("*").alias("files"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) select doc_id, n::int as line_no, substr(line, 1, 300) as line from l where contains(lower(line), 'license') order by doc_id, n limit 200")
def search_text(spark, d):
    """The 200 first hits are the operator's limit"""
    l = table(spark, d, "documents").where(F.lower("text").contains("license")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))  # noqa: E741
    return l.where(F.lower("line").contains("license")).select("doc_id", (F.col("p") + 1).alias("line_no"), F.substring("line", 1, 300).alias("line")).orderBy("doc_id", "line_no").limit(200)


@query("with l as (select unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where doc_id = 1) select n::int as line_no, line from l where n between 1 and 5")
def search_preview(spark, d):
    """S20"""
    l = table(spark, d, "documents").where("doc_id = 1").select(F.posexplode(F.split("text", "\n")).alias("p", "line"))  # noqa: E741
    return l.select((F.col("p") + 1).alias("line_no"), "line").where("line_no between 1 and 5")


@query(G + ", g as (select source as id, count(*) as deg from edges group by 1), c as (select id, label, case when lower(id) = 's1' then 0 when lower(label) = 's1' then 1 when contains(lower(label), 's1') or contains(lower(id), 's1') then 2 end as tier from nodes) select id, tier::int as tier from c left join g using (id) where tier is not null order by tier, coalesce(deg, 0) desc, id limit 5")
def search_resolve_node(spark, d):
    """F9, F10"""
    n = nodes(spark, d)
    low = F.lower
    tier = F.when(low("id") == "s1", 0).when(low("label") == "s1", 1).when(low("label").contains("s1") | low("id").contains("s1"), 2)
    deg = edges(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("deg"))
    c = n.select("id", tier.alias("tier")).where("tier is not null").join(deg, "id", "left")
    return c.orderBy("tier", F.desc(F.coalesce("deg", F.lit(0))), "id").limit(5).select("id", "tier")


_ROUTE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/(\{[^/}]*\}|:[^/]+|\[[^/\]]*\]|[0-9]+)(/|$)', '/:param\2', 'g'), '/+$', '')"


@query(f"select page_id, {_ROUTE} as route from pages")
def contracts_routes(spark, d):
    """F14, route normalisation"""
    return table(spark, d, "pages").select("page_id", route(F.col("url")).alias("route"))


@query(f"with r as (select page_id, {_ROUTE} as route from pages), e as (select distinct route from r where page_id % 2 = 0), c as (select page_id, route from r where page_id % 2 = 1) select case when count(*) = 0 then 'NO_ENDPOINTS_MATCHED' else 'CLIENTS_AT_RISK' end as verdict, count(distinct c.page_id) as clients, count(distinct e.route) as endpoints from c join e using (route)")
def contracts_match(spark, d):
    """Blocked on the exact shape"""
    r = table(spark, d, "pages").select("page_id", route(F.col("url")).alias("route"))
    j = r.where("page_id % 2 = 1").join(r.where("page_id % 2 = 0").select("route").distinct(), "route")
    return j.agg(F.when(F.count("*") == 0, "NO_ENDPOINTS_MATCHED").otherwise("CLIENTS_AT_RISK").alias("verdict"), F.countDistinct("page_id").alias("clients"), F.countDistinct("route").alias("endpoints"))


@query("select p_partkey, array_to_string(list_filter(string_split_regex(lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'))), ' +'), lambda x: x <> ''), '_') as words, p_brand like 'Brand#1%' and not p_brand = 'Brand#11' as ignored from part")
def functions_names_and_globs(spark, d):
    """S2, F13, camel-case words"""
    return table(spark, d, "part").select("p_partkey", F.array_join(words_of_name(F.col("p_name")), "_").alias("words"), ignored(F.col("p_brand"), ["Brand#1*", "!Brand#11"]).alias("ignored"))


@query("select row_number() over (order by o_totalprice desc, o_orderkey) as rank, o_orderkey, count(*) over () as total from (select * from orders where o_orderpriority = '1-URGENT') order by 1 limit 25 offset 25")
def paging_second_page(spark, d):
    """K3, K4: the second page of 25 rows and the total"""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(25).limit(25)
    from pyspark.sql import Window as W

    return page.withColumn("rank", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")) + 25).crossJoin(F.broadcast(o.agg(F.count("*").alias("total")))).select(F.col("rank").cast("long").alias("rank"), "o_orderkey", "total")


@query("with e as (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as nxt, event_id from events) select event_id, coalesce(floor(epoch(nxt)) - floor(epoch(ts)), -1)::bigint as seconds from e")
def windows_lead(spark, d):
    """The next start ends a span"""
    from pyspark.sql import Window as W

    nxt = F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.unix_timestamp(nxt) - F.unix_timestamp("ts"), F.lit(-1)).alias("seconds"))


