"""Lock files and runtime reports made from the test tables, as graphs and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import packages, runtime
from orrery.plans.star import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_LOCK = """{"name": "app", "lockfileVersion": %V, "packages": {
 "": {"dependencies": {"lib%L": "^1", "ghost": "1", "w": "file:packages/w"}, "devDependencies": {"tool": "1", "lib%L": "x"}, "optionalDependencies": {"maybe": "1"}},
 "node_modules/lib%L": {"version": "1.%M.0", "dependencies": {"util": "1"}, "peerDependencies": {"tool": "1", "opt": "1"}, "peerDependenciesMeta": {"opt": {"optional": true}}},
 "node_modules/lib%L/node_modules/util": {"version": "2.0.%M", "dependencies": {"lib%L": "*", "tool": "1"}},
 "node_modules/util": {"version": "1.0.0", "peer": true}, "node_modules/tool/": {"version": "3.0.0", "dev": true, "dependencies": {"util": "1"}},
 "packages/w": {"name": "w", "dependencies": {"util": "1"}}, "node_modules/w": {"link": true, "resolved": "packages/w"},
 "node_modules/bad!": {"version": "1"}, "node_modules/text": "1.0", "../out": {"version": "1"}, "node_modules/nov": {"dependencies": {"util": "1"}}}}"""


def locks(spark, d):
    """A lock file for each supplier."""
    k = F.col("s_suppkey")
    text = F.lit(_LOCK)
    for mark, value in (("%V", F.when(k % 11 == 10, 1).otherwise(2 + k % 2)), ("%L", k % 7), ("%M", k % 5)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return table(spark, d, "supplier").select(k.alias("file"), text.alias("text"))


_N = """n as (select s_suppkey as file, 'lib' || s_suppkey % 7 as lib, '1.' || s_suppkey % 5 || '.0' as v1, '2.0.' || s_suppkey % 5 as v2 from supplier where s_suppkey % 11 <> 10),
i as (select *, 'npm:' || lib || '@' || v1 || ':' || sha256('node_modules/' || lib)[:12] as a, 'npm:util@' || v2 || ':' || sha256('node_modules/' || lib || '/node_modules/util')[:12] as b,
  'npm:util@1.0.0:' || sha256('node_modules/util')[:12] as c, 'npm:tool@3.0.0:' || sha256('node_modules/tool')[:12] as t from n)"""


@query(f"""with {_N}
select file, unnest([a, b, c, t]) as id, unnest([lib, 'util', 'util', 'tool']) as name, unnest([v1, v2, '1.0.0', '3.0.0']) as version, unnest([true, false, true, true]) as direct,
  unnest([false, false, false, true]) as dev, false as optional, unnest([false, false, true, false]) as peer from i""")
def lock_nodes(spark, d):
    """Installed packages"""
    return packages.lock_graph(locks(spark, d))[0]


@query(f"""with {_N}
select file, unnest(['(root)', '(root)', '(root)', a, a, b, b, t]) as source, unnest([a, t, c, b, t, a, t, c]) as target, unnest(['runtime', 'dev', 'runtime', 'runtime', 'peer', 'runtime', 'runtime', 'runtime']) as kind from i""")
def lock_edges(spark, d):
    """Declarations resolved to the nearest install above them"""
    return packages.lock_graph(locks(spark, d))[1]


@query("""select s_suppkey as file, case when s_suppkey % 11 = 10 then 'unsupported' else 'partial' end as state, case when s_suppkey % 11 = 10 then 'lock-v2-or-v3-required' else 'invalid-records,invalid-versions,unresolved-dependencies' end as reasons,
  w * 12 as total, w * 8 as external, w * 1 as local, w * 2 as missing, w * 1 as unresolved from (select s_suppkey, cast(case when s_suppkey % 11 = 10 then 0 else 1 end as bigint) as w from supplier)""")
def lock_summary(spark, d):
    """State, reasons and counts of each lock file"""
    return packages.lock_graph(locks(spark, d))[2]


_REPORT = """{"schema": "%S", "repositoryRevision": "%R", "generatedAt": "%G", "coverage": {"graphql": "COMPLETE", "grpc": "complete", "event": "%E"},
 "observations": [{"transport": "Event", "side": "subscriber", "name": " topic%T ", "observedCount": 5, "line": 7.9, "file": "/etc/x"}, {"transport": "grpc", "side": "nobody", "name": "x"}],
 "otlp": {"resourceSpans": [{"scopeSpans": [{"spans": [
  {"traceId": "t%K", "spanId": "a", "name": "call", "kind": "SPAN_KIND_CLIENT", "attributes": [{"key": "rpc.system", "value": {"stringValue": "grpc"}}, {"key": "rpc.service", "value": {"stringValue": "S%T"}}, {"key": "rpc.method", "value": {"stringValue": "Get"}}, {"key": "code.file.path", "value": {"stringValue": "src/c%T.ts"}}, {"key": "code.line.number", "value": {"intValue": "12"}}]},
  {"traceId": "t%K", "spanId": "b", "parentSpanId": "a", "name": "/S%T/Get", "kind": 2, "attributes": [{"key": "rpc.system", "value": "gRPC"}, {"key": "code.filepath", "value": {"stringValue": "./srv/s.ts"}}]}]},
  {"spans": [{"traceId": "t%K", "spanId": "c", "kind": 4, "attributes": [{"key": "messaging.system", "value": {"stringValue": "kafka"}}, {"key": "messaging.destination", "value": {"stringValue": "topic%T"}}]},
  {"traceId": "t%K", "spanId": "d", "parentSpanId": "b", "kind": "SERVER", "attributes": [{"key": "graphql.operation.type", "value": {"stringValue": "query"}}, {"key": "graphql.field.name", "value": {"stringValue": "user"}}]},
  {"traceId": "t%K", "spanId": "e", "kind": 2, "attributes": [{"key": "http.method", "value": {"stringValue": "GET"}}]}, {"spanId": "f", "kind": 2, "attributes": [{"key": "graphql.field", "value": {"stringValue": "lost"}}]}]}]}]}}"""


def reports(spark, d):
    """id, text: a runtime report for each customer."""
    k = F.col("c_custkey")
    text = F.lit(_REPORT)
    for mark, value in (
        ("%S", F.when(k % 7 == 6, "other.v0").otherwise("transport-runtime.v1")), ("%R", F.concat(F.lit("r"), k % 3)), ("%E", F.when(k % 2 == 1, "COMPLETE").otherwise("SAMPLED")), ("%T", k % 4), ("%K", k),
        ("%G", F.when(k % 11 == 10, "2025-12-01T00:00:00Z").when(k % 13 == 12, "never").otherwise("2026-01-01T00:00:00Z")),
    ):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return table(spark, d, "customer").select(k.alias("id"), text.alias("text"))


def _evidence(spark, d):
    k = F.col("c_custkey")
    revisions = table(spark, d, "customer").select(k.alias("id"), F.when(k % 5 == 4, "r9").otherwise(F.concat(F.lit("r"), k % 3)).alias("revision"))
    return runtime.evidence(reports(spark, d), revisions, "transport-runtime.v1", "2026-01-05T00:00:00Z")


_R = "r as (select c_custkey as id, c_custkey % 4 as t, c_custkey % 7 = 6 as s, c_custkey % 5 = 4 as v, c_custkey % 11 = 10 as old, c_custkey % 13 = 12 and c_custkey % 11 <> 10 as never from customer)"


@query(f"""with {_R}
select id, v.* from r, lateral (values
  ('event', 'subscriber', 'topic' || t, null, null, null, null, 7, 5, 'runtime-report'), ('grpc', 'client', 'Get', null, 'S' || t, null, 'src/c' || t || '.ts', 12, 1, 'otlp-span'), ('grpc', 'server', 'Get', null, 'S' || t, null, 'srv/s.ts', null, 1, 'otlp-span'),
  ('event', 'publisher', 'topic' || t, null, null, null, null, null, 1, 'otlp-span'), ('graphql', 'server', 'user', 'QUERY', null, null, null, null, 1, 'otlp-span')) v(transport, side, name, operation, service, kind, file, line, n, detector)
where not (s or v or old or never)""")
def runtime_observations(spark, d):
    """Observations and OTLP spans of usable reports, normalised"""
    return _evidence(spark, d)[0]


@query(f"""with {_R}, c as (select *, not (s or v or old or never) as fine, id % 2 = 0 as sampled from r)
select id, 'partial' as status, array_to_string(list_filter([case when s then 'schema' end, case when v then 'revision' end, case when old then 'stale' when never then 'date' end, case when sampled then 'event-sampled' end, 'ignored'], lambda x: x is not null), ',') as reasons,
  cast(case when fine then 5 else 0 end as bigint) as observed, cast(case when fine then 2 else 7 end as bigint) as ignored from c""")
def runtime_report_states(spark, d):
    """Schema, revision, date and coverage of each report"""
    return _evidence(spark, d)[1]


@query("select 'grpc' as transport, 'S' || c_custkey % 4 as service, 'Get' as name, 'src/c' || c_custkey % 4 || '.ts' as client_file, 'srv/s.ts' as server_file, count(*) as n from customer group by c_custkey % 4")
def runtime_span_calls(spark, d):
    """Client spans joined with the server spans under them"""
    return runtime.span_calls(runtime.spans(reports(spark, d)))
