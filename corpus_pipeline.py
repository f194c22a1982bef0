"""A training corpus from raw documents: five stages, each an operator of orrery.llm.

Every stage is written as Parquet and read again as the next one's documents. All but the last
return the columns of their input, with n_chars brought up to date where the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.decontam import decontaminate
from orrery.llm.lines import dedup_lines
from orrery.llm.minhash import near_duplicates
from orrery.llm.mixing import mixed_shards
from orrery.llm.toxicity import toxicity
from orrery.store import Scratch

#: No SQL: the stages learn a classifier, use MinHash and draw at random; tests/llm holds them to brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go."""
    done = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)
    return done.where("predicted = 0").select("own.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near-equal lines the first stays; no document goes."""
    done = dedup_lines(docs, counted=False)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The documents with a hash of id and text, (hash, text) alone, and the hash's name, which no column of theirs has."""
    name = "row"
    while name in docs.columns:
        name = "_" + name
    keyed = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    return keyed, keyed.select(F.col(name).alias("key"), "doc_id", "text"), name


def _matches(docs: DataFrame, name: str, found: DataFrame) -> Column:
    """Same id and same hash: texts of one id are told apart by 64 bits, all others by their id."""
    return docs["doc_id"].eqNullSafe(found["found_id"]) & (docs[name] == found["found"])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, its first by id; of rows equal in id and text one."""
    docs, slim, name = _keyed(docs)
    kept = near_duplicates(slim).where("is_kept").select(F.col("doc_id").alias("found_id"), F.col("row").alias("found")).distinct()
    return docs.join(kept, _matches(docs, name, kept), "left_semi").dropDuplicates(["doc_id", name]).drop(name)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go."""
    docs, slim, name = _keyed(docs)
    found = decontaminate(slim.select(F.struct("doc_id", "key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id.doc_id").alias("found_id"), F.col("doc_id.key").alias("found")).distinct()
    return docs.join(bad, _matches(docs, name, bad), "left_anti").drop(name)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """shard, position, doc_id, text: the sources mixed to their targets, shuffled by shard."""
    return mixed_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
