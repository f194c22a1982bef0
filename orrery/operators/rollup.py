"""Aggregations over graphs: statistics, module roll-ups, hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.paths import module_of

STRUCTURAL = ("contains", "method")
PROVENANCE = ("EXACT_LSP", "EXTRACTED", "RESOLVED", "INFERRED", "CONFLICT", "UNKNOWN")


def semantic(edges: DataFrame) -> DataFrame:
    return edges.where(~F.col("relation").isin(*STRUCTURAL) & ~F.col("barrel_proxy"))


def edge_class() -> Column:
    return F.when(F.col("type_only"), "type").when(F.col("compile_only"), "compile").otherwise("runtime")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """metric, value (A1): nodes by kind, edges by relation and class."""
    a = nodes.groupBy(F.concat(F.lit("kind:"), "kind").alias("metric")).count()
    b = edges.groupBy(F.concat(F.lit("relation:"), "relation").alias("metric")).count()
    c = edges.groupBy(F.concat(F.lit("class:"), edge_class()).alias("metric")).count()
    return a.union(b).union(c).withColumnRenamed("count", "value")


def provenance(edges: DataFrame) -> DataFrame:
    """provenance, n, complete (A2): zero-filled."""
    kinds = edges.sparkSession.createDataFrame([(k,) for k in PROVENANCE], "provenance string")
    found = edges.groupBy(F.coalesce("provenance", F.lit("UNKNOWN")).alias("provenance")).agg(F.count("*").alias("n"))
    out = kinds.join(F.broadcast(found), "provenance", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # six rows
    return out.crossJoin(F.broadcast(edges.agg((F.count(F.when(F.coalesce("provenance", F.lit("UNKNOWN")) == "UNKNOWN", 1)) == 0).alias("complete"))))


def modules(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(module_of(F.col("file")).alias("module")).agg(F.countDistinct("file").alias("files"), F.count("*").alias("members"), F.sum("loc").alias("loc"))


def with_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with file and module of both ends: two equi-joins."""
    n = nodes.select("id", "file", module_of(F.col("file")).alias("module"))
    src = n.select(F.col("id").alias("source"), F.col("file").alias("from_file"), F.col("module").alias("from_module"))
    dst = n.select(F.col("id").alias("target"), F.col("file").alias("to_file"), F.col("module").alias("to_module"))
    return edges.join(src, "source").join(dst, "target")


def counted(edges: DataFrame) -> DataFrame:
    """source, target, relation, edge_class, n of edges that are no containment and pass no names on: repeats are counted before anything joins them."""
    e = edges.where((F.col("relation") != "contains") & ~F.col("barrel_proxy"))
    return e.groupBy("source", "target", "relation", edge_class().alias("edge_class")).agg(F.count("*").alias("n"))


def file_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_file, to_file, edge_class, n, dominant relation, ties by name (A4).

    Edges are shuffled by source, counted there, and then by target. A target's counts are a file's, if no file has several
    nodes (asked first, of the nodes alone); otherwise they are summed in one more shuffle for each of the two groupings.
    """
    n, cls = nodes.select("id", "file"), ["from_file", "to_file", "edge_class"]
    e = edges.where((F.col("relation") != "contains") & ~F.col("barrel_proxy")).select("source", "target", "relation", edge_class().alias("edge_class"))
    e = e.join(n.select(F.col("id").alias("source"), F.col("file").alias("from_file")), "source").groupBy("source", "target", "relation", "edge_class", "from_file").agg(F.count("*").alias("n"))
    e = e.drop("source").join(n.select(F.col("id").alias("target"), F.col("file").alias("to_file")), "target").where("from_file <> to_file")
    several = n.groupBy("file").agg((F.min("id") < F.max("id")).alias("several")).where("several").limit(1).count()
    keys = cls if several else ["target", *cls]
    by = e.groupBy(*keys, "relation").agg(F.sum("n").alias("count"))
    return by.groupBy(*keys).agg(F.sum("count").alias("n"), F.min(F.struct((-F.col("count")).alias("c"), "relation")).alias("top")).select(*cls, "n", F.col("top.relation").alias("relation"))


def module_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = with_files(counted(edges), nodes).where("from_module <> to_module")
    return e.groupBy("from_module", "to_module", "edge_class").agg(F.sum("n").alias("n"))


def multigraph(edges: DataFrame, relation: str = "calls") -> DataFrame:
    return edges.where((F.col("relation") == relation) & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_in, n_out, degree over semantic edges (A9): one aggregation of both directions."""
    e = semantic(edges)
    both = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("target", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("degree"))


def hubs(edges: DataFrame, top: int = 10) -> DataFrame:
    """god nodes (A10): distinct neighbours overall, at run time, and only at compile time.

    A pre-aggregation to (node, neighbour) bounds what the distinct counts shuffle.
    """
    e = semantic(edges).select("source", "target", (~F.col("type_only") & ~F.col("compile_only")).alias("rt"))
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other"), "rt", F.lit(1).alias("o")).unionAll(e.select("target", "source", "rt", F.lit(0)))
    pairs = both.groupBy("id", "other").agg(F.max("rt").alias("rt"), F.count("*").alias("n"), F.sum("o").alias("o"))
    out = pairs.groupBy("id").agg(F.count("*").alias("neighbours"), F.count(F.when(F.col("rt"), 1)).alias("runtime"), F.count(F.when(~F.col("rt"), 1)).alias("compile_only"), F.sum("n").alias("occurrences"), F.sum("o").alias("n_out"))
    return out.orderBy(F.desc("neighbours"), F.desc("occurrences"), "id").limit(top)


def repeat_hotspots(edges: DataFrame, top: int = 10, least: int = 20, repeats: int = 10, most: int = 5) -> DataFrame:
    """Nodes outside the hubs whose occurrences much exceed their neighbours."""
    e = semantic(edges)
    both = e.select(F.col("source").alias("id"), F.col("target").alias("other")).unionAll(e.select("target", "source"))
    agg = both.groupBy("id", "other").count().groupBy("id").agg(F.sum("count").alias("occurrences"), F.count("*").alias("neighbours"))
    agg = agg.withColumn("repeats", F.col("occurrences") - F.col("neighbours")).join(F.broadcast(hubs(edges, top).select("id")), "id", "left_anti")
    return agg.where((F.col("occurrences") >= least) & (F.col("repeats") >= repeats)).orderBy(F.desc("repeats"), "id").limit(most)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """direction, relation, other, sites of one node."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "relation", F.col("target").alias("other"))
    inn = edges.where(F.col("target") == node).select(F.lit("in"), "relation", "source")
    return out.union(inn).groupBy("direction", "relation", "other").agg(F.count("*").alias("sites"))


def context_groups(edges: DataFrame, node: str, lines: int = 5) -> DataFrame:
    """other, relation, n, first lines, any compile-time."""
    e = edges.where(F.col("source") == node)
    return e.groupBy(F.col("target").alias("other"), "relation").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("line")), 1, lines), ",").alias("lines"), F.max(F.col("type_only") | F.col("compile_only")).alias("compile_time"))


def communities(nodes: DataFrame, territory: Column, top: int = 8) -> DataFrame:
    """territory, members, most common kind, first four files."""
    by = nodes.groupBy(territory.alias("territory"), "kind").agg(F.count("*").alias("n"), F.min("file").alias("first_file"))
    out = by.groupBy("territory").agg(F.sum("n").alias("members"), F.min(F.struct((-F.col("n")).alias("n"), "kind"))["kind"].alias("kind"), F.min("first_file").alias("first_file"))
    return out.orderBy(F.desc("members"), "territory").limit(top)
