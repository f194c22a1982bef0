"""Snapshot comparison and ratchets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state (added, removed): the symmetric difference of two sets."""
    a = new.select(*keys).distinct().join(old.select(*keys).distinct(), keys, "left_anti").withColumn("state", F.lit("added"))
    b = old.select(*keys).distinct().join(new.select(*keys).distinct(), keys, "left_anti").withColumn("state", F.lit("removed"))
    return a.unionByName(b)


def stable_keys(nodes: DataFrame, signature: list[str]) -> DataFrame:
    """Ordinal of a node among those of equal signature, by line then id (W3): shifts of lines do not matter."""
    return nodes.withColumn("ordinal", F.row_number().over(W.partitionBy(*signature).orderBy("line", "id")) - 1)


def orphaned(old: DataFrame, new: DataFrame, alive: DataFrame) -> DataFrame:
    """Targets with an inbound edge before and none now, that still exist."""
    was = old.select(F.col("target").alias("id")).distinct().join(alive.select("id"), "id", "left_semi")
    return was.join(new.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def debt(old: DataFrame, new: DataFrame) -> DataFrame:
    """finding, state: new, existing or fixed, by finding id."""
    j = old.select("finding").distinct().withColumn("o", F.lit(1)).join(new.select("finding").distinct().withColumn("n", F.lit(1)), "finding", "full")
    return j.select("finding", F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "fixed").otherwise("existing").alias("state"))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """path of every file whose hash differs or that one side lacks."""
    return old.select("path", F.col("hash").alias("h1")).join(new.select("path", F.col("hash").alias("h2")), "path", "full").where(~F.col("h1").eqNullSafe(F.col("h2"))).select("path")


def scoped_merge(base: DataFrame, scoped: DataFrame, affected: DataFrame, alive: DataFrame) -> DataFrame:
    """Edges of a base without those of affected sources, with the new ones; none may dangle."""
    kept = base.join(affected.select(F.col("id").alias("source")), "source", "left_anti")
    out = kept.unionByName(scoped.join(affected.select(F.col("id").alias("source")), "source", "left_semi"))
    return out.join(alive.select(F.col("id").alias("source")), "source", "left_semi").join(alive.select(F.col("id").alias("target")), "target", "left_semi")


def group_key(members: DataFrame, group: str, member: str) -> DataFrame:
    """A group's key: a digest of its sorted members."""
    return members.groupBy(group).agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(member)), "\n"), 256), 1, 20).alias("key"), F.count("*").alias("n"))


def group_ratchet(base: DataFrame, now: DataFrame, changed: DataFrame) -> DataFrame:
    """group, key, n of the groups whose key no base group has; blocked where a member's file is among the changed.

    base, now: group, member, file; changed: file.
    """
    new = group_key(now, "group", "member").join(group_key(base, "group", "member").select("key").distinct(), "key", "left_anti")
    touched = now.join(changed.select("file").distinct(), "file", "left_semi").select("group").distinct().withColumn("hit", F.lit(True))
    return new.join(touched, "group", "left").select("group", "key", "n", F.coalesce("hit", F.lit(False)).alias("blocked"))


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row of each key."""
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")
