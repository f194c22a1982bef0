"""Change history: churn, co-change, hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def churn(changes: DataFrame) -> DataFrame:
    return changes.groupBy("file").agg(F.countDistinct("commit").alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.sum(F.col("additions") + F.col("deletions")).alias("churn"))


#: The most files of a commit that counts for co-change, by default and at all.
COMMIT_FILES, COMMIT_FILES_MOST = 80, 200


def omitted_commits(changes: DataFrame, max_files: int = COMMIT_FILES) -> DataFrame:
    """commits, omitted: how many commits there are, and how many `cochange` leaves out for their size."""
    size = changes.groupBy("commit").agg(F.countDistinct("file").alias("k"))
    return size.agg(F.count("*").alias("commits"), F.coalesce(F.sum((F.col("k") > min(max_files, COMMIT_FILES_MOST)).cast("long")), F.lit(0)).alias("omitted"))


def cochange(changes: DataFrame, least: int = 2, max_files: int = COMMIT_FILES) -> DataFrame:
    """a, b, n, jaccard, lift, confidence of file pairs that change together.

    A commit of more than max_files files (COMMIT_FILES_MOST at most) is left out whole: mass renames say nothing of coupling,
    and the limit bounds what a commit can emit. `omitted_commits` gives their number.
    """
    max_files = min(max_files, COMMIT_FILES_MOST)
    size = W.partitionBy("commit")
    kept = changes.select("commit", "file").distinct().withColumn("k", F.count("*").over(size)).where(F.col("k") <= max_files).drop("k")
    per = kept.groupBy("file").agg(F.count("*").alias("own"))
    total = kept.agg(F.countDistinct("commit").alias("total"))
    pairs = kept.withColumnRenamed("file", "a").join(kept.withColumnRenamed("file", "b"), "commit").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    j = pairs.join(per.select(F.col("file").alias("a"), F.col("own").alias("l")), "a").join(per.select(F.col("file").alias("b"), F.col("own").alias("r")), "b").crossJoin(F.broadcast(total))  # one row
    n, left, right = F.col("n"), F.col("l"), F.col("r")
    return j.select("a", "b", "n", F.round(n / (left + right - n), 4).alias("jaccard"), F.round(n * F.col("total") / (left * right), 4).alias("lift"), F.round(F.greatest(n / left, n / right), 4).alias("confidence"))


def percentile(value: Column) -> Column:
    """Fraction of positive values that are not greater; 0 for the rest."""
    return F.when(value > 0, F.round(F.cume_dist().over(W.partitionBy(value > 0).orderBy(value)), 4)).otherwise(F.lit(0.0))


def ranked(values: DataFrame, column: str, name: str) -> DataFrame:
    """Adds a percentile. Few distinct values are ranked, not all rows, so no task sorts the table."""
    counts = values.where(F.col(column) > 0).groupBy(column).agg(F.count("*").alias("__n"))
    upto = counts.select(column, F.round(F.sum("__n").over(W.orderBy(column)) / F.sum("__n").over(W.partitionBy()), 4).alias(name))
    return values.join(upto, column, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def hotspots(churned: DataFrame, degree: DataFrame, top: int = 50) -> DataFrame:
    """file, score: geometric mean of the percentiles of churn and connectivity."""
    both = churned.join(degree.select(F.col("id").alias("file"), "degree"), "file").where("degree > 0")
    both = ranked(ranked(both, "churn", "p_churn"), "degree", "p_degree")
    out = both.select("file", "churn", "degree", F.round(F.sqrt(F.round(F.col("p_churn") * F.col("p_degree"), 8)), 4).alias("score"))
    return out.orderBy(F.desc("score"), "file").limit(top)


def hidden(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that change together with no path of one or two undirected edges between them."""
    e = edges.select("source", "target").where("source <> target")
    both = e.unionAll(e.select(F.col("target"), F.col("source"))).toDF("a", "b").distinct()
    near = pairs.select("a", "b").join(both, ["a", "b"], "left_semi")
    one = pairs.select("a", "b").join(both.withColumnRenamed("b", "m"), "a").join(both.select(F.col("a").alias("m"), "b"), ["m", "b"], "left_semi").select("a", "b")
    return pairs.join(near.union(one).distinct(), ["a", "b"], "left_anti")
