"""Routes against calls, and what a change puts at risk, over rows made from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import contracts, impact
from orrery.plans.star import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_ROUTES = ["/api/n@/:param", "/n@/items", "/files/n@/*", "/v1/api/n@/:param", "/:param/n@", "/n@/*/x", "/"]
_CALLS = ["/api/n@/:param", "/api/n@/seven", "/app/n@/items", "/files/n@/a/b", "/files/n@", "/api/n@", "/x/n@", "/n@/items", "/:param/n@/items", "/v2/api/n@/list"]


def _routes(spark, d):
    """Endpoints of nations, calls of customers."""
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    nation = table(spark, d, "nation").select(n.alias("n"), F.posexplode(F.array(*map(F.lit, _ROUTES))).alias("i", "p"))
    endpoints = nation.select(F.concat_ws("-", "n", "i").alias("endpoint"), F.when(F.col("i") == 4, "ANY").when(F.col("n") % 2 == 0, "get").otherwise("POST").alias("method"), F.replace("p", F.lit("@"), F.col("n").cast("string")).alias("path"))
    path = F.replace(F.element_at(F.array(*map(F.lit, _CALLS)), (c % 10 + 1).cast("int")), F.lit("@"), F.col("c_nationkey").cast("string"))
    calls = table(spark, d, "customer").select(c.alias("call"), F.when(c % 3 == 0, "POST").otherwise("GET").alias("method"), path.alias("path"), (c % 7 == 0).alias("dynamic"), (c % 11 == 0).alias("prefix"))
    return endpoints, calls


def _array(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FITS = "{m} and len(list_filter(list_zip({e}[:{k}], {c}), lambda z: z[1] is not null and z[1] <> ':param' and (z[2] is null or z[2] in (':param', '*') or z[1] <> z[2]))) = 0"


def _fits(e: str, c: str) -> str:
    """The rule itself, position by position."""
    catch = f"({e})[-1] = '*'"
    return f"(case when coalesce({catch}, false) then " + _FITS.format(m=f"len({c}) >= len({e}) - 1", e=e, c=c, k=f"len({e}) - 1") + " else " + _FITS.format(m=f"len({c}) = len({e})", e=e, c=c, k=f"len({e})") + " end)"


@query(f"""with e as (select n_nationkey || '-' || i - 1 as endpoint, case when i = 5 then 'ANY' when n_nationkey % 2 = 0 then 'GET' else 'POST' end as method, list_filter(string_split(replace({_array(_ROUTES)}[i], '@', n_nationkey::varchar), '/'), lambda s: s <> '') as e from nation, range(1, 8) r(i)),
c as (select c_custkey as call, case when c_custkey % 3 = 0 then 'POST' else 'GET' end as method, list_filter(string_split(replace({_array(_CALLS)}[c_custkey % 10 + 1], '@', c_nationkey::varchar), '/'), lambda s: s <> '') as c, c_custkey % 7 = 0 as dynamic, c_custkey % 11 = 0 as prefix from customer),
p as (select call, endpoint, e, c, dynamic, prefix, {_fits('e', 'c')} as whole,
  len(e) <> len(c) and least(len(e), len(c)) >= 2 and case when len(e) < len(c) then {_fits('e', 'c[len(c) - len(e) + 1:]')} else {_fits('e[len(e) - len(c) + 1:]', 'c')} end as part
  from e join c on e.method in ('ANY', c.method))
select call, endpoint, case when whole and prefix then 'exact-dynamic' when whole then 'exact' else 'suffix' end as kind,
  cast(case when whole and prefix then 0.78 when whole and len(list_filter(list_zip(e, c), lambda z: z[1] = ':param' and coalesce(z[2] <> ':param', true))) > 0 then 0.96 when whole then 1.0 when dynamic or prefix then 0.55 else 0.72 end as double) as score
from p where whole or part""")
def contracts_route_matches(spark, d):
    """Exact shapes, parameters, catch-alls and trailing parts, with their scores"""
    return contracts.match_routes(*_routes(spark, d))


def _changes(spark, d):
    k = F.col("o_orderkey")
    file = F.concat(F.when(k % 3 == 0, "test/f").otherwise("src/f"), k)
    o = table(spark, d, "orders").select(file.alias("file"), (k % 8).alias("c"))
    files = o.select("file", (F.col("c") == 0).alias("is_deleted"), (F.col("c") == 1).alias("is_renamed"), F.when(F.col("c") == 2, True).alias("is_binary"))
    names = F.array(*map(F.lit, ["removed", "signature-changed", "unknown", "signature-changed", "signature-changed", "body-changed", "added", "metadata-only"]))
    classes = o.select("file", F.element_at(names, (F.col("c") + 1).cast("int")).alias("class"))
    own = o.where("c in (0, 3, 5, 6, 7)").select("file", F.concat("file", F.when(F.col("c").isin(5, 7), "#b").otherwise("#a")).alias("id"), F.element_at(names, (F.col("c") + 1).cast("int")).alias("class"))
    symbols = o.select("file", F.explode(F.array(F.struct(F.concat("file", F.lit("#a")).alias("id"), F.lit(True).alias("exported")), F.struct(F.concat("file", F.lit("#b")).alias("id"), F.lit(False).alias("exported")))).alias("s")).select("file", "s.id", "s.exported")
    return impact.change_seeds(files, own, classes, symbols, F.col("file").startswith("test/"))


_CHANGED = "o as (select case when o_orderkey % 3 = 0 then 'test/f' else 'src/f' end || o_orderkey as file, o_orderkey % 8 as c, o_orderkey % 3 = 0 as test from orders)"


@query(f"with {_CHANGED}, s as (select file, c, unnest(case c when 0 then ['', '#a', '#b'] when 1 then [''] when 2 then ['', '#a', '#b'] when 3 then ['', '#a'] when 4 then [''] when 5 then ['#b'] else [] end) as x from o where not test) select file, file || x as id from s")
def diff_change_seeds(spark, d):
    """The nodes to follow from each changed file"""
    return _changes(spark, d)[1]


@query(f"with {_CHANGED} select case when count(*) filter (where c <= 4 and not test) > 0 then 'HIGH' when count(*) filter (where c = 5 and not test) > 0 then 'MEDIUM' else 'LOW' end as verdict, count(*) as files, count(*) filter (where c <= 4 and not test) as breaking, count(*) filter (where c = 5 and not test) as bodies from o")
def diff_change_verdict(spark, d):
    """The verdict over all changed files, tests apart"""
    return impact.change_verdict(_changes(spark, d)[0])
