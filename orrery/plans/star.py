"""The test tables as a typed property graph: nodes, edges, commits. Each has a Spark plan and equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.functions import paths

#: Market segments and brand digits to top folders, so that path rules tell files apart.
SEGMENT_DIR = {"AUTOMOBILE": "src", "BUILDING": "test", "FURNITURE": "docs", "MACHINERY": "generated", "HOUSEHOLD": "vendor"}
BRAND_DIR = {"1": "src", "2": "test", "3": "docs", "4": "generated", "5": "vendor"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dir(col, mapping: dict[str, str]):
    out = F.lit("src")
    for k, v in mapping.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, file, kind, loc, line."""
    t = lambda n: table(spark, sf_dir, n)
    cust = t("customer").select(F.concat(F.lit("C"), "c_custkey").alias("id"), F.col("c_name").alias("label"), F.concat(_dir(F.col("c_mktsegment"), SEGMENT_DIR), F.lit("/nation"), "c_nationkey", F.lit("/customer/C"), "c_custkey").alias("file"), F.lit("customer").alias("kind"), (F.col("c_custkey") % 500).cast("long").alias("loc"))
    supp = t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("src/nation"), "s_nationkey", F.lit("/supplier/S"), "s_suppkey").alias("file"), F.lit("supplier").alias("kind"), (F.col("s_suppkey") % 500).cast("long").alias("loc"))
    part = t("part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.concat(_dir(F.substring("p_brand", -1, 1), BRAND_DIR), F.lit("/"), "p_brand", F.lit("/part/P"), "p_partkey").alias("file"), F.lit("part").alias("kind"), (F.col("p_size") * 10).cast("long").alias("loc"))
    nat = t("nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.concat(F.lit("src/world/N"), "n_nationkey").alias("file"), F.lit("nation").alias("kind"), F.lit(0).cast("long").alias("loc"))
    reg = t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.col("r_name").alias("label"), F.concat(F.lit("src/world/R"), "r_regionkey").alias("file"), F.lit("region").alias("kind"), F.lit(0).cast("long").alias("loc"))
    return cust.unionByName(supp).unionByName(part).unionByName(nat).unionByName(reg)


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] = ("contains", "calls", "references", "imports")) -> DataFrame:
    """source, target, relation, type_only, compile_only, barrel_proxy, line, ts: a bag, repeats count."""
    t = lambda n: table(spark, sf_dir, n)
    no = F.lit(False)
    parts = []

    def edge(df, s, d, rel, to=no, co=no, bp=no, line=None, at=None):
        line = F.lit(None).cast("int") if line is None else line
        at = F.lit(None).cast("timestamp") if at is None else at
        parts.append(df.select(s.alias("source"), d.alias("target"), F.lit(rel).alias("relation"), to.alias("type_only"), co.alias("compile_only"), bp.alias("barrel_proxy"), line.alias("line"), at.alias("ts")))

    def key(p, c):
        return F.concat(F.lit(p), F.col(c))

    if "contains" in relations:
        edge(t("nation"), key("R", "n_regionkey"), key("N", "n_nationkey"), "contains")
        edge(t("customer"), key("N", "c_nationkey"), key("C", "c_custkey"), "contains")
        edge(t("supplier"), key("N", "s_nationkey"), key("S", "s_suppkey"), "contains")
    if "calls" in relations:
        lo = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        edge(lo, key("C", "o_custkey"), key("S", "l_suppkey"), "calls", F.col("l_returnflag") == "R", (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), no, F.col("l_linenumber"), F.col("o_orderdate"))
    if "references" in relations:
        edge(t("lineitem"), key("S", "l_suppkey"), key("P", "l_partkey"), "references", no, no, F.col("l_discount") == 0, F.col("l_linenumber"), F.col("l_shipdate"))
    if "imports" in relations:
        w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
        nxt = t("lineitem").select("l_partkey", F.lead("l_partkey").over(w).alias("nxt")).where("nxt is not null and nxt <> l_partkey")
        brand = t("part").select("p_partkey", "p_brand")
        same = nxt.join(brand, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").withColumnRenamed("p_brand", "b").join(brand, (F.col("nxt") == F.col("p_partkey")) & (F.col("b") == F.col("p_brand"))).select("l_partkey", "nxt").distinct()  # few are left here
        edge(same, key("P", "l_partkey"), key("P", "nxt"), "imports")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, file, additions, deletions, ts: orders as commits over parts; a commit lists a file once."""
    lo = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lo.select(F.col("l_orderkey").alias("commit"), F.concat(F.lit("P"), "l_partkey").alias("file"), F.col("l_quantity").cast("long").alias("additions"), F.round(F.col("l_tax") * 100).cast("long").alias("deletions"), F.col("o_orderdate").alias("ts"))
    return rows.groupBy("commit", "file").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.min("ts").alias("ts"))


def _case(col: str, mapping: dict[str, str]) -> str:
    return "case " + col + " " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " else 'src' end"


NODES_SQL = f"""nodes as (
  select 'C' || c_custkey as id, c_name as label, {_case('c_mktsegment', SEGMENT_DIR)} || '/nation' || c_nationkey || '/customer/C' || c_custkey as file, 'customer' as kind, c_custkey % 500 as loc from customer
  union all select 'S' || s_suppkey, s_name, 'src/nation' || s_nationkey || '/supplier/S' || s_suppkey, 'supplier', s_suppkey % 500 from supplier
  union all select 'P' || p_partkey, p_name, {_case("right(p_brand, 1)", BRAND_DIR)} || '/' || p_brand || '/part/P' || p_partkey, 'part', p_size * 10 from part
  union all select 'N' || n_nationkey, n_name, 'src/world/N' || n_nationkey, 'nation', 0 from nation
  union all select 'R' || r_regionkey, r_name, 'src/world/R' || r_regionkey, 'region', 0 from region)"""

EDGES_SQL = """edges as (
  select 'R' || n_regionkey as source, 'N' || n_nationkey as target, 'contains' as relation, false as type_only, false as compile_only, false as barrel_proxy, cast(null as int) as line, cast(null as timestamp) as ts from nation
  union all select 'N' || c_nationkey, 'C' || c_custkey, 'contains', false, false, false, null, null from customer
  union all select 'N' || s_nationkey, 'S' || s_suppkey, 'contains', false, false, false, null, null from supplier
  union all select 'C' || o_custkey, 'S' || l_suppkey, 'calls', l_returnflag = 'R', l_linestatus = 'O' and l_returnflag = 'A', false, l_linenumber, o_orderdate from lineitem join orders on l_orderkey = o_orderkey
  union all select 'S' || l_suppkey, 'P' || l_partkey, 'references', false, false, l_discount = 0, l_linenumber, l_shipdate from lineitem
  union all select distinct 'P' || a, 'P' || b, 'imports', false, false, false, cast(null as int), cast(null as timestamp) from (
      select l_partkey as a, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as b from lineitem) x
    join part p on p.p_partkey = a join part q on q.p_partkey = b and q.p_brand = p.p_brand where a <> b)"""

CHANGES_SQL = """changes as (
  select l_orderkey as "commit", 'P' || l_partkey as file, sum(cast(trunc(l_quantity) as bigint)) as additions, sum(cast(round(l_tax * 100) as bigint)) as deletions, min(o_orderdate) as ts
  from lineitem join orders on l_orderkey = o_orderkey group by all)"""

GRAPH_SQL = f"with {NODES_SQL}, {EDGES_SQL}, f as (select id, file, {paths.MODULE_SQL} as module from nodes) "
