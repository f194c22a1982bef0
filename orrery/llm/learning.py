"""What the two weakly supervised classifiers share: folds, the bounded sample, the scoring pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import linear
from orrery.llm.text import Chunk, chunks, give_back, list_array
from orrery.llm.weaklabel import LabelModel


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample(documents: DataFrame, labels: DataFrame, label: str, held_out: Column, labelled: int, unlabelled: int) -> DataFrame:
    """(doc_id, label or -1, text) of at most labelled + unlabelled training rows, by a hash of the id.

    Repeated rows of a label: the largest value holds. Null ids and null labels teach nothing.
    """
    taught = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().join(taught, "doc_id", "left").where(~held_out)
    ids = ids.withColumn("order", F.xxhash64("doc_id"))
    chosen = ids.where("label is not null").orderBy("order", "doc_id").limit(labelled).unionByName(ids.where("label is null").orderBy("order", "doc_id").limit(unlabelled))
    # At most labelled + unlabelled rows of three numbers: a bounded broadcast.
    return documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"))), "doc_id")


Features = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]
Votes = Callable[[Chunk, list], np.ndarray]


def train(rows: DataFrame, features: Features, votes: Votes, mined: int = 0, l1: float = 0.5) -> tuple[np.ndarray, float, LabelModel]:
    """Weights, bias and label model from a bounded sample of (doc_id, label, text)."""

    def extract(batches):
        for batch in batches:
            texts, labels, ids = batch.column("text"), batch.column("label"), batch.column("doc_id")
            for i, j, c in chunks(texts):
                own = linear.distinct_by_text(*features(c), c.n)
                v = votes(c, texts.slice(i, j - i).to_pylist()).astype(np.int8)
                yield pa.record_batch([ids.slice(i, j - i), labels.slice(i, j - i), list_array(v.ravel().astype(np.int32), np.full(c.n, v.shape[1]), pa.int32()), list_array(np.concatenate(own) if own else [], np.array([len(x) for x in own]), pa.int32())], names=["doc_id", "label", "votes", "features"])

    got = rows.mapInArrow(extract, "doc_id long, label int, votes array<int>, features array<int>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    label = got.column("label").to_numpy()[order]
    # Views of what Spark sent: the features, most of the sample, are not copied to be put in order.
    own = [np.asarray(x.values, np.int32) for x in got.column("features")]
    own = [own[i] for i in order]
    n = len(label)
    width = len(got.column("votes")[0]) if n else 0
    v = np.array(got.column("votes").combine_chunks().flatten(), np.int64).reshape(n, width)[order] if n else np.zeros((0, 0), np.int64)
    if mined and n:
        v = with_silence(np.concatenate([v, _mined(own, label, mined)], 1))
    model = LabelModel()
    soft = model.fit(v, label)
    weights, bias = linear.fit(own, soft, l1=l1)
    del got, own, v
    give_back()
    return weights, bias, model


def with_silence(votes: np.ndarray) -> np.ndarray:
    """One more voter, for voters that only ever speak for class 1: it votes 0 where all are silent."""
    return np.concatenate([votes, np.where((votes == 2).all(1), 0, 2)[:, None]], 1)


def _mined(own: list[np.ndarray], label: np.ndarray, most: int) -> np.ndarray:
    """Voters read off the labelled training rows: the features that most surely mark class 1."""
    known = np.flatnonzero(label >= 0)
    pos, seen = np.zeros(linear.DIM), np.zeros(linear.DIM)
    for i in known:
        seen[own[i]] += 1
        pos[own[i]] += label[i] == 1
    share = (pos + 0.5) / (seen + 1)
    gain = np.where((pos >= 3) & (share > 0.75), pos * share, 0)
    chosen = np.argsort(-gain, kind="stable")[:most]
    chosen = chosen[gain[chosen] > 0]
    where = {int(f): k for k, f in enumerate(chosen)}
    out = np.full((len(own), len(chosen)), 2, np.int64)  # silent where the feature is absent
    for i, f in enumerate(own):
        for x in f[np.isin(f, chosen)]:
            out[i, where[int(x)]] = 1
    return out


def scored(documents: DataFrame, features: Features, weights: np.ndarray, bias: float, held_out: Column, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; whole texts; null counts as empty.

    carry: give the whole row too, as a struct `own`, so that a filter on the score needs no join.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((weights, bias))  # DIM floats, whatever the corpus
    names = ["doc_id", "held_out", *["own"] * carry]
    extra = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("own")] * carry
    rows = documents.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").alias("body"), *extra)

    def run(batches):
        w, b = shared.value
        for batch in batches:
            for i, j, c in chunks(batch.column("body")):
                s = linear.score(*features(c), c.n, w, b)
                yield pa.record_batch([*(batch.column(x).slice(i, j - i) for x in names), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = rows.drop("body").schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(run, schema)
