"""Bounded graph traversal by layered joins.

A frontier joins the edges on their source once a layer; what was visited is anti-joined away. The
visited set is written once a layer, so plans stay small and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.store import Scratch


def layered(edges: DataFrame, seeds: DataFrame, depth: int, whole: bool = False) -> DataFrame:
    """id, depth: least number of steps from a seed, at most `depth`; edges: source, target.

    whole: all that the seeds reach is wanted; raises where that is further than `depth`.
    """
    scratch = Scratch(edges.sparkSession, "layers")
    pairs = scratch.write(edges.select("source", "target").where("source <> target").distinct(), "pairs")
    front = scratch.write(seeds.select("id").distinct().withColumn("depth", F.lit(0)), "layer-0")
    seen = front
    for d in range(1, depth + 1):
        reached = front.select(F.col("id").alias("source")).join(pairs, "source").select(F.col("target").alias("id")).distinct()
        front = scratch.write(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), f"layer-{d}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    else:
        if whole:
            raise RuntimeError(f"the walk goes on past {depth} layers")
    return seen


def reverse_reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """id, runtime_depth, compile_depth (G5): the compile-time flag sticks along a path.

    A node's state is (id, flag), so both least depths come out of one walk.
    """
    flag = (F.col("type_only") | F.col("compile_only")).alias("flag")
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"), flag).distinct()
    scratch = Scratch(edges.sparkSession, "reach")
    back = scratch.write(back, "edges")
    front = scratch.write(seeds.select("id", F.lit(False).alias("sticky"), F.lit(0).alias("depth")), "layer-0")
    seen = front
    for d in range(1, depth + 1):
        step = front.select(F.col("id").alias("at"), "sticky").join(back, "at").select(F.col("to").alias("id"), (F.col("sticky") | F.col("flag")).alias("sticky")).distinct()
        front = scratch.write(step.join(seen, ["id", "sticky"], "left_anti").withColumn("depth", F.lit(d)), f"layer-{d}")
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    out = seen.where("depth > 0").join(seeds.select("id"), "id", "left_anti")
    return out.groupBy("id").agg(F.min(F.when(~F.col("sticky"), F.col("depth"))).alias("runtime_depth"), F.min(F.when(F.col("sticky"), F.col("depth"))).alias("compile_depth"))


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 8) -> DataFrame:
    """hop, id of one undirected shortest path, ties by least id (G4); empty if there is none."""
    spark = edges.sparkSession
    e = edges.select("source", "target").where("source <> target")
    both = Scratch(spark, "path").write(e.unionAll(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct(), "both")  # read again at each hop back
    forth = layered(both, spark.createDataFrame([(start,)], "id string"), hops)
    found = forth.where(F.col("id") == end).first()
    if not found:
        return spark.createDataFrame([], "hop int, id string")
    steps, at = [(found["depth"], end)], end
    for d in range(found["depth"] - 1, -1, -1):  # at most `hops` one-row lookups
        prev = both.where(F.col("target") == at).join(forth.where(F.col("depth") == d), F.col("source") == F.col("id")).agg(F.min("id")).first()[0]
        steps.append((d, prev))
        at = prev
    return spark.createDataFrame(steps, "hop int, id string")


def strong_components(edges: DataFrame, max_rounds: int = 200, driver_edges: int = 200_000) -> DataFrame:
    """id, component (least member) of the strongly connected components of two or more nodes.

    Nodes without both an in- and an out-edge are trimmed in rounds; what is left, if it is no more
    than driver_edges, is solved on the driver; beyond that by forward-backward colouring of all components in step.
    Raises when the rounds do not suffice, rather than return unfinished components.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "scc")
    e = scratch.write(edges.select("source", "target").where("source <> target").distinct(), "edges-0")
    n = e.count()
    for k in range(1, max_rounds):
        alive = e.select(F.col("source").alias("id")).distinct().join(e.select(F.col("target").alias("id")).distinct(), "id", "left_semi")
        e2 = e.join(alive.withColumnRenamed("id", "source"), "source", "left_semi").join(alive.withColumnRenamed("id", "target"), "target", "left_semi")
        e = scratch.write(e2, f"edges-{k}")
        m = e.count()
        if m == n:
            break
        n = m
    if n <= driver_edges:
        rows = [(r[0], r[1]) for r in e.limit(driver_edges + 1).collect()]  # bounded by the count above
        return spark.createDataFrame([(i, c) for i, c in _tarjan(rows)], "id string, component string")
    done = None
    for k in range(max_rounds):
        # Colour: the least id that reaches a node. The part of a colour that also reaches its root is a component.
        ids = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
        colour = _spread(e, ids.withColumn("c", F.col("id")), scratch, f"f{k}", 50 * max_rounds)
        same = e.join(colour.select(F.col("id").alias("source"), F.col("c").alias("cs")), "source").join(colour.select(F.col("id").alias("target"), F.col("c").alias("ct")), "target").where("cs = ct").select("source", "target", F.col("cs").alias("c"))
        roots = colour.where("id = c").select("id")
        back = layered(same.select(F.col("target").alias("source"), F.col("source").alias("target")), roots, 50 * max_rounds, whole=True)
        part = scratch.write(back.join(colour, "id").select("id", F.col("c").alias("component")), f"part-{k}")
        done = part if done is None else done.unionByName(part)
        gone = part.select("id")
        e = scratch.write(e.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti"), f"rest-{k}")
        if not e.limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    sizes = done.groupBy("component").count().where("count > 1")
    return done.join(sizes, "component").select("id", "component")


def _spread(e: DataFrame, labels: DataFrame, scratch: Scratch, name: str, rounds: int) -> DataFrame:
    labels = scratch.write(labels, f"{name}-0")
    for k in range(1, rounds):
        got = e.join(labels.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("c").alias("c2"))
        new = scratch.write(labels.join(got, "id", "left").select("id", F.least("c", F.coalesce("c2", "c")).alias("c"), (F.coalesce("c2", "c") < F.col("c")).alias("moved")), f"{name}-{k}")
        labels = new.select("id", "c")
        if not new.where("moved").limit(1).count():
            return labels
    raise RuntimeError("colours did not settle")


def _tarjan(pairs: list[tuple]) -> list[tuple]:
    out_of: dict = {}
    for a, b in pairs:
        out_of.setdefault(a, []).append(b)
        out_of.setdefault(b, [])
    # Kosaraju: finish order forwards, then sweeps over the reversed edges.
    order, state = [], {}
    for root in sorted(out_of):
        stack = [(root, iter(out_of[root]))] if root not in state else []
        state.setdefault(root, 1)
        while stack:
            node, it = stack[-1]
            nxt = next((x for x in it if x not in state), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                state[nxt] = 1
                stack.append((nxt, iter(out_of[nxt])))
    into: dict = {}
    for a, b in pairs:
        into.setdefault(b, []).append(a)
    found: dict = {}
    for root in reversed(order):
        todo, members = [root] if root not in found else [], []
        while todo:
            x = todo.pop()
            if x in found:
                continue
            found[x] = root
            members.append(x)
            todo += [y for y in into.get(x, []) if y not in found]
        if len(members) > 1:
            least = min(members)
            for x in members:
                found[x] = (least,)
    return [(i, c[0]) for i, c in found.items() if isinstance(c, tuple)]
