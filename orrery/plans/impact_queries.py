"""Cycle, importer, change and resolution queries bound to the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.operators import compare, impact, rules
from orrery.plans.star import table
from orrery.sources import diffs, scan
from orrery.streaming import activity

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# Each brand's parts in a ring, and a way back to the first from every part of size over 25.
_RING = """r as (select p_brand as brand, p_partkey as id, p_size, min(p_partkey) over b as root, coalesce(lead(p_partkey) over (partition by p_brand order by p_partkey), min(p_partkey) over b) as nxt from part window b as (partition by p_brand)),
  e as (select distinct brand, id, nxt as target, root from r where id <> nxt union select brand, id, root, root from r where p_size > 25 and id <> root)"""


def _ring(spark, d):
    w = W.partitionBy("p_brand")
    root = F.min("p_partkey").over(w)
    ring = table(spark, d, "part").select("p_size", F.col("p_partkey").alias("id"), root.alias("component"), F.coalesce(F.lead("p_partkey").over(w.orderBy("p_partkey")), root).alias("next"))
    edges = ring.select(F.col("id").alias("source"), F.col("next").alias("target")).unionByName(ring.where("p_size > 25").select(F.col("id").alias("source"), F.col("component").alias("target")))
    return edges, ring.select("id", "component")


@query(f"""with recursive {_RING}, w(root, spot, path) as (select distinct root, root, [root] from e union all select w.root, e.target, list_append(path, e.target) from w join e on e.root = w.root and e.id = w.spot where len(path) = 1 or w.spot <> w.root),
  c as (select root, path from w where spot = root and len(path) > 1)
  select distinct on (root) root as component, array_to_string(path, '>') as route, len(path) - 1 as steps from c order by root, len(path), path""")
def cycles_representative(spark, d):
    """G7"""
    found = impact.representative_cycles(*_ring(spark, d))
    return found.select("component", F.array_join("cycle", ">").alias("route"), (F.size("cycle") - 1).cast("long").alias("steps"))


_FILES = "f as (select c_nationkey as client, c_acctbal, row_number() over (partition by c_nationkey order by c_custkey) as r from customer)"


def _files(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("client"), "c_acctbal", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("r"))


def _imports(files):
    """Each file imports the one of half its number, and the one before it where that is divisible by ten."""
    one = files.select("client", F.col("r").alias("source"), F.floor(F.col("r") / 2).cast("int").alias("target"))
    return one.unionByName(files.where("r % 10 = 1").select("client", F.col("r").alias("source"), (F.col("r") - 1).alias("target")))


_IMPORTS = f"{_FILES}, e as (select client, r as source, r // 2 as target from f union select client, r, r - 1 from f where r % 10 = 1)"


@query(f"with recursive {_IMPORTS}, w(client, file, distance) as (select client, r, 0 from f where c_acctbal > 9000 union select e.client, e.source, distance + 1 from w join e on e.client = w.client and e.target = w.file where distance < 5) select client, file, min(distance) as distance from w group by 1, 2")
def reach_affected_importers(spark, d):
    """G11"""
    files = _files(spark, d)
    return impact.affected_importers(_imports(files), files.where("c_acctbal > 9000").select("client", F.col("r").alias("file")))


def _scope(spark, d, depth, most=None):
    files = _files(spark, d).where("client = 7")
    return impact.importers(_imports(files), files.where("r in (2, 9)").select(F.col("r").alias("id")), depth, most)


def _scope_sql(depth: int) -> str:
    return f"with recursive {_IMPORTS}, w(id, depth) as (select r, 0 from f where client = 7 and r in (2, 9) union select e.source, depth + 1 from w join e on e.client = 7 and e.target = w.id where depth < {depth}), m as (select id, min(depth) as depth from w group by 1) select * from m"


@query(_scope_sql(1))
def reach_delta_importers(spark, d):
    """G16"""
    return _scope(spark, d, 1)


@query(_scope_sql(4))
def reach_wrapper_scope(spark, d):
    """G17"""
    return _scope(spark, d, 4)


@query(_scope_sql(20) + " where depth > 0 order by depth, id limit 40")
def reach_reverse_impact(spark, d):
    """G22"""
    return _scope(spark, d, 20, 40)


_GIT = "diff --git a/f.js b/f.js\n"
_SYMBOL_ROWS = [("f.js", "f.js#run", "run()", 3, 9, True), ("f.js", "f.js#stop", "stop()", 12, 20, False)]
#: One diff for each remainder of an order's key, with the class of the file and of its symbols.
_DIFFS = [
    (_GIT + "--- a/f.js\n+++ b/f.js\n@@ -5 +5,2 @@ x\n-  a = 1\n+  a = 2\n+  b = 3\n", "body-changed", "run body-changed"),
    (_GIT + "--- a/f.js\n+++ b/f.js\n@@ -3 +3 @@\n-function run(a) {\n+function run(a, b) {\n@@ -14 +14 @@\n-  // old\n+  // new\n", "signature-changed", "run signature-changed,stop metadata-only"),
    (_GIT + "--- a/f.js\n+++ b/f.js\n@@ -1 +1 @@\n-import a from 'a'\n+import b from 'b'\n", "signature-changed", ""),
    (_GIT + "--- a/f.js\n+++ b/f.js\n@@ -30,0 +31 @@\n+later()\n", "unknown", ""),
    (_GIT + "deleted file mode 100644\n--- a/f.js\n+++ /dev/null\n@@ -12,2 +0,0 @@\n-function stop() {\n-}\n", "removed", "stop removed"),
    (_GIT + "new file mode 100644\n--- /dev/null\n+++ b/f.js\n@@ -0,0 +4 @@\n+  go()\n", "added", "run added"),
    (_GIT + "Binary files a/f.js and b/f.js differ\n", "unknown", ""),
]


def _values(which: int) -> str:
    return "case o_orderkey % 7 " + " ".join(f"when {k} then '{x[which]}'" for k, x in enumerate(_DIFFS)) + " end"


@query(f"select 'k' || o_orderkey as file, {_values(1)} as class, {_values(2)} as symbols from orders")
def diff_change_classes(spark, d):
    """A unified diff read, its lines laid on symbols, symbols and files classed"""
    at, k = F.concat(F.lit("k"), "o_orderkey"), F.col("o_orderkey") % 7
    text = F.element_at(F.array(*[F.lit(x[0]) for x in _DIFFS]), (k + 1).cast("int"))
    orders = table(spark, d, "orders")
    files, lines = diffs.unified_diff(orders.select(at.alias("diff"), text.alias("text")))
    symbols = spark.createDataFrame(_SYMBOL_ROWS, "f string, id string, label string, lo int, hi int, exported boolean")
    symbols = orders.select(at.alias("file")).crossJoin(F.broadcast(symbols)).drop("f")  # two fixed rows beside each order
    own = lambda df: df.drop("file").withColumnRenamed("diff", "file")
    by, whole = impact.change_classes(own(files), own(lines), symbols)
    said = by.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.substring_index("id", "#", -1), "class"))), ",").alias("symbols"))
    return whole.join(said, "file", "left").select("file", "class", F.coalesce("symbols", F.lit("")).alias("symbols"))


_KEY = "substring(sha256(string_agg(distinct 'P' || l_partkey, chr(10) order by 'P' || l_partkey)), 1, 20)"


@query(f"""with b as (select {_KEY} as key from lineitem where l_linenumber < 7 group by l_orderkey), g as (select l_orderkey as "group", {_KEY} as key, count(*) as n, bool_or(p_size = 1) as blocked from lineitem join part on p_partkey = l_partkey group by 1) select * from g where key not in (select key from b)""")
def diff_duplicate_ratchet(spark, d):
    """D9"""
    part = F.concat(F.lit("P"), "l_partkey")
    now = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), part.alias("member"), part.alias("file"), "l_linenumber")
    changed = table(spark, d, "part").where("p_size = 1").select(F.concat(F.lit("P"), "p_partkey").alias("file"))
    return compare.group_ratchet(now.where("l_linenumber < 7"), now, changed)


@query("select l_orderkey as file, l_linenumber as caller, l_partkey % 50 as callee, case when l_partkey % 50 = o_custkey % 50 then l_orderkey else o_custkey end as target from lineitem join orders on o_orderkey = l_orderkey where l_partkey % 50 in (o_custkey % 50, o_orderkey % 50)")
def resolve_call_targets(spark, d):
    """J1, J3"""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("file"), "o_custkey")
    calls = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("caller"), (F.col("l_partkey") % 50).alias("callee"))
    symbols = orders.select("file", (F.col("o_custkey") % 50).alias("name"))
    return scan.resolve_calls(calls, symbols, orders.select("file", (F.col("file") % 50).alias("name"), F.col("o_custkey").alias("target_file")))


@query("select o_orderkey as id, case when o_orderkey % 10 = 0 then -1 else o_custkey end as value from orders union all select -o_orderkey, 0 from orders where o_orderkey % 10 = 0")
def streaming_upsert(spark, d):
    """Rows of a batch take the place of those of their key"""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    tenth = rows.where("id % 10 = 0")
    batch = tenth.select("id", F.lit(-1).cast("long").alias("value")).unionByName(tenth.select((-F.col("id")).alias("id"), F.lit(0).cast("long").alias("value")))
    return activity.upsert(batch, rows, ["id"])


_TYPO = "n_name[:c_custkey % length(n_name)] || n_name[c_custkey % length(n_name) + 2:]"


@query(f"with t as (select distinct {_TYPO} as name from customer join nation on n_nationkey = c_nationkey) select name, n_name as popular, damerau_levenshtein(name, n_name)::int as distance from t, nation where length(name) >= 4 and name not in (select n_name from nation) and damerau_levenshtein(name, n_name) <= case when length(n_name) >= 8 then 2 else 1 end")
def rules_near_names(spark, d):
    """Names of nations that lack a letter"""
    nation = table(spark, d, "nation")
    at = (F.col("c_custkey") % F.length("n_name")).cast("int")
    name = F.concat(F.substring("n_name", F.lit(1), at), F.substring("n_name", at + 2, F.lit(100)))
    names = table(spark, d, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(name.alias("name"))
    return rules.near_names(names, nation.select(F.col("n_name").alias("name")))
