"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 7).

Documents fall into blocks of their source by a hash of their id, about `block_words` words each.
The mix takes whole passes over a source and, for the rest of its target, a permuted run of blocks
whose last block is cut at the document where the target is reached. The exact block quotas of the
sources are split over the output shards by a binary tree: each node's quotas are dealt to its two
halves by a multivariate-hypergeometric draw, so every shard gets a random share and the totals stay exact.
Shards then take disjoint runs of each source's permuted blocks, and shuffle their documents locally.

All randomness is a hash of (seed, source, block, document) or a generator seeded by (seed, node):
reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.store import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)


def targets(sizes: list[int], weights: list[float], total: float, limit: float) -> list[float]:
    """Shares of total by weight; none above limit x its size; the excess goes round by weight."""
    out = [0.0] * len(sizes)
    free = [i for i in range(len(sizes)) if sizes[i] > 0]
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def split_quotas(quotas: list[int], shards: int, seed) -> np.ndarray:
    """Block quotas of each shard (shards x sources); every column adds up to its source's quota.

    Works down a binary tree of shard ranges: the left half gets its part of the blocks, drawn
    without replacement from all sources' blocks together.
    """
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(0, shards, np.array(quotas, np.int64))]
    while todo:
        low, high, have = todo.pop()
        if high - low == 1 or not have.sum():
            out[low] = have
            continue
        mid = (low + high) // 2
        take = int(round(have.sum() * (mid - low) / (high - low)))
        rng = np.random.Generator(np.random.PCG64([*np.atleast_1d(seed), low, high]))
        left = rng.multivariate_hypergeometric(have, take, method="marginals")
        todo += [(low, mid, left), (mid, high, have - left)]
    return out


def row_key() -> Column:
    """A hash of doc_id, source, text and lang that tells null from absent."""
    return F.xxhash64("doc_id", *(x for c in ("source", "text", "lang") for x in (F.col(c).isNull(), F.col(c))))


def mix(documents: DataFrame, share: float = 1.5, limit: float = 2.0, block_words: int = 50_000, shard_words: int = 250_000, seed: int = 7, max_sources: int = 100_000, max_edges: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(documents' plan, draws).

    plan: key, doc_id, source, size, source_size, target, copies for every document; draws: key,
    doc_id, pass, shard, position for every copy taken. Null text has size 0; null source is a
    source of its own, last in order. Rows that repeat are separate documents. Only sums by source
    (max_sources at most, checked) and the upper part of the shard tree (max_edges numbers) are on the driver; where there are
    more shards, the lower parts of the tree grow in tasks, one for each branch.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    own = documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), row_key().alias("key"))
    table = scratch.write(own, "sizes")
    rows = table.groupBy("source").agg(F.sum("size").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; group them first")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["n"]) for r in rows]
    goal = targets(sizes, [WEIGHTS[i % 3] for i in range(len(rows))], share * sum(sizes), limit)
    plan = []
    for i, (r, n, t) in enumerate(zip(rows, sizes, goal, strict=True)):
        whole = int(min(t // n, limit)) if n else 0
        plan.append((i, r["source"], n, float(t), whole, float(t - whole * n), max(1, -(-n // block_words))))
    small = F.broadcast(spark.createDataFrame(plan, "sid int, source string, source_size long, target double, whole long, rest double, blocks long"))  # max_sources rows
    joined = table.withColumnRenamed("source", "s").join(small, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    joined = joined.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")))
    # The blocks' permuted order, by hash: sums over 4,096 stretches of it first, so no task sees all blocks of a source.
    blocks = joined.groupBy("sid", "block").agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
    blocks = scratch.write(blocks.withColumn("turn", F.xxhash64(F.lit(seed + 1), "sid", "block")).withColumn("stretch", F.shiftright("turn", 52)), "blocks")
    before = W.partitionBy("sid").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    long = blocks.groupBy("sid", "stretch").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    long = long.select("sid", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m0"))
    inner = W.partitionBy("sid", "stretch").orderBy("turn", "block")
    blocks = blocks.join(long, ["sid", "stretch"]).withColumn("before", F.col("n0") + F.coalesce(F.sum("n").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("rank", F.col("m0") + F.row_number().over(inner) - 1)
    state = F.when(F.col("before") >= F.col("rest"), "none").when(F.col("before") + F.col("n") <= F.col("rest"), "all").otherwise("cut")
    cut = scratch.write(blocks.select("sid", "block", "before", "rank", state.alias("state")), "order")
    placed = joined.join(cut, ["sid", "block"])
    # The one cut block of each source, ordered by hash: documents up to the target, to the nearer side.
    inside = W.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed + 2), "key"), "doc_id", "key").rowsBetween(W.unboundedPreceding, 0)
    edge = placed.where("state = 'cut'").withColumn("upto", F.col("before") + F.sum("size").over(inside))
    edge = edge.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("upto")
    others = placed.where("state <> 'cut'").withColumn("extra", (F.col("state") == "all").cast("long"))
    full = others.unionByName(edge).withColumn("copies", F.col("whole") + F.col("extra"))
    done = scratch.write(full.select("key", "doc_id", "source", "size", "source_size", "target", "copies", "sid", "block", "rank", "blocks", "whole"), "plan")

    # Quotas in blocks: whole passes over all blocks and the started run; a shard takes runs of them.
    started = {r["sid"]: r["m"] for r in cut.where("state <> 'none'").groupBy("sid").agg(F.count("*").alias("m")).collect()}  # a row for each source
    quotas = [p[4] * p[6] + int(started.get(p[0], 0)) for p in plan]
    shards = max(1, -(-int(share * sum(sizes)) // shard_words))
    branches = max(1, min(shards, max_edges // max(1, len(plan))))
    twigs = -(-shards // branches)
    tree = split_quotas(quotas, branches, seed)
    upto = np.cumsum(tree, 0)
    edges = F.broadcast(spark.createDataFrame([(i, [int(x) for x in upto[:, i]]) for i in range(len(plan))], "sid int, upto array<long>"))  # max_edges numbers
    copies = done.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    # Each pass has its own permutation of the blocks, by rotation of the rank.
    turn = F.pmod(F.col("rank") + F.when(F.col("pass") < F.col("whole"), F.pmod(F.xxhash64(F.lit(seed + 3), "sid", "pass"), F.col("blocks"))).otherwise(0), F.col("blocks"))
    passed = F.size(F.filter("upto", lambda x: x <= F.col("slot")))
    draws = copies.withColumn("slot", F.col("pass") * F.col("blocks") + turn).join(edges, "sid").withColumn("shard", passed)
    if twigs > 1:
        lower = spark.createDataFrame([(b, [int(x) for x in tree[b]], [int(x) for x in upto[b] - tree[b]]) for b in range(branches)], "branch int, quotas array<long>, first array<long>")

        def grow(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    ends = np.cumsum(split_quotas(r["quotas"], twigs, [seed, r["branch"]]), 0) + np.array(r["first"])
                    n = len(r["quotas"])
                    yield pa.record_batch([pa.array([r["branch"]] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(ends.T.tolist(), pa.list_(pa.int64()))], names=["shard", "sid", "upto"])

        lower = lower.repartition("branch").mapInArrow(grow, "shard int, sid int, upto array<long>")
        draws = draws.drop("upto").join(lower, ["shard", "sid"]).withColumn("shard", F.col("shard") * twigs + passed)
    draws = draws.select("key", "doc_id", "pass", "shard", F.xxhash64(F.lit(seed + 4), "shard", "key", "pass").alias("position"))
    return done, draws


def taken(plan: DataFrame, draws: DataFrame, most: int = 2) -> DataFrame:
    """The plan with what the shards draw of each document: `taken`, words; `shards`, the shard of each copy by pass, joined by commas; `at`, the copies' positions in them.

    Rows equal in id, source, text and lang are drawn alike: each pass counts once. most: the passes of a document, the mix's limit; more raise. They are columns of plain numbers while
    they are gathered, so no list is held for a document.
    """
    own = [(f"{c}_{p}", F.min(F.when(F.col("pass") == p, F.col(c)))) for c in ("shard", "position") for p in range(most)]
    drawn = draws.groupBy("key").agg(F.max("pass").alias("last"), *[f.alias(n) for n, f in own])
    drawn = drawn.select("key", *[F.when(F.col("last") < most, F.col(n)).otherwise(F.raise_error(F.lit("a document has more passes than `most`"))).alias(n) for n, _ in own])
    got = plan.join(drawn, "key", "left")
    number = sum((F.col(f"shard_{p}").isNotNull().cast("long") for p in range(most)), F.lit(0).cast("long"))
    each = lambda c: F.concat_ws(",", *[F.col(f"{c}_{p}").cast("string") for p in range(most)])
    return got.withColumns({"taken": F.col("size") * number, "shards": each("shard"), "at": each("position")}).drop(*[n for n, _ in own])


def mixed_shards(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: (shard, position, doc_id, text) rows, each shard sorted by its own shuffle.

    Documents are told apart by a hash of doc_id, source, text and lang; rows equal in all four
    are taken equally often.
    """
    plan, draws = mix(documents, **options)
    keyed = documents.select(row_key().alias("key"), F.col("doc_id").alias("id"), "text").dropDuplicates(["key", "id"])
    met = draws.join(keyed, (draws["key"] == keyed["key"]) & draws["doc_id"].eqNullSafe(keyed["id"]))
    return met.select("shard", "position", "doc_id", "text").repartition("shard").sortWithinPartitions("shard", "position")
