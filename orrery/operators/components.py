"""Connected components (the reference's union-find) by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.store import Scratch


def _rank(c: str) -> Column:
    """One order of ids for all rounds, random, so that chains of falling ranks are short."""
    return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))


def connected_components(links: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of `links`; component is the least id of its component.

    Each round, a node goes to its neighbour of least rank, if that is below its own, and on to where
    that one goes; nodes that meet are one node of the next round, and only edges between
    different ones go on. So the graph shrinks by a constant factor a round, a star of any size is done in two, and the
    rounds cost together little more than the first. The rounds' maps are joined from the last to the first at the
    end. Steps are partial aggregations and equi-joins; only whether edges are left reaches the driver.
    Null ends and self links are ignored; an empty input gives an empty result.
    Raises when max_rounds do not suffice, rather than return unfinished labels.
    """
    scratch = Scratch(links.sparkSession, "components")
    pairs = links.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null and x <> y")

    def oriented(ends: DataFrame) -> DataFrame:
        """Distinct edges (a, b), a of lower rank."""
        low = _rank("x") < _rank("y")
        return ends.select(F.when(low, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(low, F.col("y")).otherwise(F.col("x")).alias("b")).distinct()

    edges = scratch.write(oriented(pairs), "edges-0")
    nodes = scratch.write(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "nodes")
    maps = []
    while edges.limit(1).count():
        k = len(maps)
        if k == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        near = edges.groupBy(F.col("b").alias("id")).agg(F.min(_rank("a"))["id"].alias("up"))
        top = near.select(F.col("id").alias("up"), F.col("up").alias("top"))
        maps.append(scratch.write(near.join(top, "up", "left").select("id", F.coalesce("top", "up").alias("to")), f"map-{k}"))
        # The higher end of an edge always moves; the lower one only if it has a lower neighbour.
        high, low = (maps[-1].select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ba")
        ends = edges.join(high, "b").join(low, "a", "left").select(F.coalesce("to_a", "a").alias("x"), F.col("to_b").alias("y"))
        edges = scratch.write(oriented(ends.where("x <> y")), f"edges-{k + 1}")
        scratch.drop(f"edges-{k}")
    if not maps:
        return nodes.select("id", F.col("id").alias("component"))
    final = maps[-1]
    for k, step in reversed(list(enumerate(maps[:-1]))):
        later = final.select(F.col("id").alias("to"), F.col("to").alias("last"))
        moved = step.join(later, "to", "left").select("id", F.coalesce("last", "to").alias("to"))
        # Where others went to a node that moved itself, its name is in both; both lead to the same root.
        final = scratch.write(moved.unionByName(final.join(step, "id", "left_anti")), f"final-{k}")
    roots = nodes.join(final, "id", "left").select("id", F.coalesce("to", "id").alias("root"))
    least = roots.groupBy("root").agg(F.min("id").alias("component"))
    return scratch.write(roots.join(least, "root").select("id", "component"), "labels")
