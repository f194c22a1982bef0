"""Services, components and seeds over evidence made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import architecture
from orrery.plans import star
from orrery.plans.star import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_REGISTRY = [("postgres", "dep", "pg"), ("postgres", "env-weak", "PG"), ("redis", "dep", "github.com/redis/go-redis"), ("redis", "image", "redis"), ("kafka", "import", "kafkajs"), ("kafka", "env", "KAFKA")]


@query("""with c as (select c_nationkey as repo, c_custkey % 40 as k from customer), s as (select s_nationkey as repo, s_suppkey as f, s_suppkey % 4 as k from supplier),
told as (select distinct repo, service, source, token from c join (values (0, 'postgres', 'manifest', 'pg'), (1, 'redis', 'manifest', 'go'), (2, 'redis', 'image', 'redis'), (3, 'postgres', 'env', 'PG'), (5, 'kafka', 'env', 'KAFKA')) v(k, service, source, token) using (k)),
named as (select repo, 'kafka' as service, count(distinct f) as files from s where k in (0, 2) group by repo),
t as (select repo, service, list(distinct source) as sources, count(*) as signals from told group by repo, service),
b as (select repo, service, list_sort(list_concat(coalesce(sources, []), case when files is null then [] else ['import'] end)) as sources, coalesce(signals, 0) as signals, coalesce(files, 0) as files from t full join named using (repo, service))
select repo, service, array_to_string(sources, ',') as sources, signals, files, case when list_contains(sources, 'manifest') or list_contains(sources, 'image') or (list_contains(sources, 'env') and list_contains(sources, 'import')) then 'high' else 'medium' end as confidence from b""")
def services_backing(spark, d):
    """Four kinds of evidence, confidence by combination"""
    k = F.col("c_custkey") % 40
    kind = F.when(k.isin(2, 6), "image").when(k.isin(3, 4, 5, 7), "env").otherwise("dep")
    value = F.element_at(F.array(*map(F.lit, ["PG", "github.com/redis/go-redis/v9", "'docker.io:5000/bitnami/redis:7@sha256:ab'", "PG_HOST", "PG_COLOR", "kafka_topics", "redis-commander", "PGX_HOST", "pg-mock", "pgx"])), F.least(k, F.lit(9)).cast("int") + 1)
    evidence = table(spark, d, "customer").select(F.col("c_nationkey").alias("repo"), kind.alias("kind"), value.alias("value"))
    s = F.col("s_suppkey")
    text = F.element_at(F.array(*map(F.lit, ['import x from "KafkaJS"', "// kafkajs is nice", "require('kafkajs/lib')", None])), (s % 4 + 1).cast("int"))
    files = table(spark, d, "supplier").select(F.col("s_nationkey").alias("repo"), F.concat(F.lit("f"), s).alias("file"), text.alias("text"))
    return architecture.backing_services(evidence, files, spark.createDataFrame(_REGISTRY, "service string, kind string, token string"))


@query("""with f as (select p_partkey as k, 'b' || p_partkey % 3 as b, 'c' || p_partkey % 5 as c from part),
java as (select k, b, c from f where k % 4 = 0), base as (select b, count(*) as n from java where k % 8 <> 0 group by b), child as (select b, c, count(*) as n from java where k % 8 <> 0 group by b, c),
keys as (
  select 'm/src/main/java/org/acme/' || b || case when n > 20 and k % 16 = 12 then '::root' when n > 20 then '/' || c else '' end as key, 'm/src/main/java/org/acme/' || b || case when n > 20 and k % 16 = 12 then ' (root files)' when n > 20 then '/' || c else '' end as name from java join base using (b) where k % 8 <> 0
  union all select 'pkg' || k % 7 || '/src/' || b, 'pkg' || k % 7 || '/src/' || b from java where k % 8 = 0
  union all select case k % 4 when 1 then 'src/' || b when 2 then 'src-root' else 'tools' end, case k % 4 when 1 then 'src/' || b when 2 then 'src (root files)' else 'tools' end from f where k % 4 <> 0)
select key, name, count(*) as n_files from keys group by key, name""")
def components_inferred(spark, d):
    """A Java tree cut until its parts are small, nested sources, source roots, top folders"""
    k, b, c = F.col("p_partkey"), F.concat(F.lit("b"), F.col("p_partkey") % 3), F.concat(F.lit("c"), F.col("p_partkey") % 5)
    java = F.concat(F.lit("m/src/main/java/org/acme/"), b, F.when(k % 16 != 12, F.concat(F.lit("/"), c)).otherwise(""), F.lit("/K"), k, F.lit(".java"))
    nested = F.concat(F.lit("pkg"), k % 7, F.lit("/src/"), b, F.lit("/x"), k, F.lit(".ts"))
    other = F.when(k % 4 == 1, F.concat(F.lit("src/"), b, F.lit("/y"), k, F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit("src/z"), k, F.lit(".py"))).otherwise(F.concat(F.lit("tools/w"), k, F.lit(".py")))
    files = table(spark, d, "part").select(F.when(k % 8 == 0, nested).when(k % 4 == 0, java).otherwise(other).alias("file"))
    return architecture.components(architecture.territories(files, most=20), top=None)


@query(f"""{star.GRAPH_SQL}, n as (select id, lower(label) as label, lower(file) as file, len(id) % 3 as degree, id not like '%0' as sym from nodes),
w as (select *, list_filter(regexp_split_to_array(lower(regexp_replace(id || ' ' || label || ' ' || file, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9_]+'), lambda x: x <> '') as words,
  list_filter(regexp_split_to_array(file, '[^a-z0-9_]+'), lambda x: x <> '') as segments, len(string_split(file, '/')) as depth from n),
m as (select id, sym, depth, degree, greatest(case when label = 'widget' then 60 when list_contains(segments, 'widget') then 48 when list_contains(words, 'widget') then 36 when contains(lower(id), 'widget') or contains(label, 'widget') then 12 else 0 end) as a,
  greatest(case when label = 'customer' then 60 when list_contains(segments, 'customer') then 48 when list_contains(words, 'customer') then 36 when contains(lower(id), 'customer') or contains(label, 'customer') then 12 else 0 end,
    case when label = 'world' then 42 when list_contains(segments, 'world') then 36 when list_contains(words, 'world') then 25 when contains(lower(id), 'world') or contains(label, 'world') then 7 else 0 end) as b from w),
s as (select id, case when a > 0 then a + more else 0.0 end as a, case when b > 0 then b + more else 0.0 end as b from (select *, cast(case when sym then 0 else 7 end + greatest(0, 4 - depth) as double) + least(2.0::double, degree / 40.0::double) as more from m)),
one as (select id from s where a > 0 order by a desc, id limit 1), two as (select id from s where b > 0 and id not in (select id from one) order by b desc, id limit 1),
rest as (select id, row_number() over (order by greatest(a, b) + (a + b) / 10 desc, id) as r from s where greatest(a, b) > 0 and id not in (select id from one) and id not in (select id from two))
select 0 as position, id from one union all select 1, id from two union all select cast(r + 1 as int), id from rest where r <= 4""")
def rank_seeds(spark, d):
    """Graded matches of two concepts, one seed each in turn, the rest by total"""
    n = star.nodes(spark, d).select("id", "label", "file", (F.length("id") % 3).alias("degree"), (~F.col("id").endswith("0")).alias("is_symbol"))
    return architecture.seeds(architecture.seed_scores(n, [["widget"], ["customer", "world"]]), 2, limit=6)
