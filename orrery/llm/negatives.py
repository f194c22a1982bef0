"""Hard negatives by a vector-approximation file (operator 11).

Every pack of vectors keeps, beside the vectors, an approximation: each dimension is cut into cells at the pack's own
quantiles, and a component is one byte, its cell. For a block of anchors, a table gives the least and largest product of each (dimension, cell, anchor);
summing its rows by the cells of a vector gives a lower and an upper bound of the score. Exact scores are computed only
for vectors whose bounds allow them to enter: the first positives (upper bound not under the best lower bounds or scores
so far), then the windows of the positives (bounds that meet a window, upper bound not under the best scores found in it).
No bound cuts a true result, so the outcome is that of a full comparison.

Anchors meet packs in a grid of cells (group of packs, group of anchors). Both sides of a grid cell have a bounded expected size, whatever the labels, and each
gives a few rows an anchor; the grid grows with both sides, and packs are shuffled once for each anchor group.

Odd rows: rows with a null label, a null vector or any null or non-finite component take no part, nor do rows without
vec_id, as they could not be named. Of repeated rows each counts: equal ids rank beside one another, but rows of the anchor's
own id are not other rows; a repeated anchor gives its rows again. Vectors are compared with those of their own length. Ties go by vec_id. Columns other
than the three named are not read, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.vectors import finite, packs_of
from orrery.store import Scratch

CELLS = 64
BLOCK = 64
GROUP_BYTES = 24 << 20
GROUP_ANCHORS = 2048
NONE = np.iinfo(np.int64).min


def quantise(x: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each component (a byte), and the least and largest value in each (dimension, cell)."""
    n, d = x.shape
    code = np.zeros((n, d), np.uint8)
    low, high = np.zeros((d, cells), np.int32), np.zeros((d, cells), np.int32)
    for j in range(d):
        v = np.sort(x[:, j])
        edge = np.unique(v[np.arange(cells) * n // cells])
        code[:, j] = np.searchsorted(edge, x[:, j], "right") - 1
        low[j, : len(edge)] = edge
        high[j, : len(edge)] = v[np.concatenate((np.searchsorted(v, edge[1:]), [n])) - 1]
    return code, low, high


def bounds(code: np.ndarray, low: np.ndarray, high: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of vectors (rows) against anchors (columns), by table lookup."""
    n, d = code.shape
    a = anchors.T.astype(np.int64)[:, None, :]
    one, other = low.astype(np.int64)[:, :, None] * a, high.astype(np.int64)[:, :, None] * a
    least, most = np.minimum(one, other), np.maximum(one, other)
    small = d == 0 or d * max(-int(least.min()), int(most.max()), 1) < 2**31
    kind = np.int32 if small else np.int64
    least, most = least.astype(kind), most.astype(kind)
    below, above = np.zeros((n, len(anchors)), kind), np.zeros((n, len(anchors)), kind)
    for j in range(d):
        below += least[j][code[:, j]]
        above += most[j][code[:, j]]
    return below, above


def exact(x: np.ndarray, row: np.ndarray, anchors: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Scores of pairs, in pieces of bounded size."""
    out = np.zeros(len(row), np.int64)
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for i in range(0, len(row), step):
        out[i : i + step] = np.einsum("ij,ij->i", x[row[i : i + step]].astype(np.int64), anchors[column[i : i + step]].astype(np.int64))
    return out


class Best:
    """The first k of each slot by score, highest first, then vec_id, over everything offered so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, NONE)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.least[slot[full]] = score[full]


_PACK = "dim int, vec_id array<long>, label array<long>, x binary, code binary, low binary, high binary"


def approximated(vectors: DataFrame, scale: int, cells: int) -> DataFrame:
    """One row a pack of (vec_id, label, vector): sorted by label, with its approximation."""

    def run(batches):
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for rows, dim, x in packs_of(batch, scale, 5):
                order = np.argsort(labels[rows], kind="stable")
                rows, x = rows[order], x[order]
                code, low, high = quantise(x, cells)
                ends = pa.array([0, len(rows)], pa.int32())
                yield pa.record_batch(
                    [pa.array([dim], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(ids[rows])), pa.ListArray.from_arrays(ends, pa.array(labels[rows])), *(pa.array([v.tobytes()], pa.binary()) for v in (x, code, low, high))],
                    names=["dim", "vec_id", "label", "x", "code", "low", "high"],
                )

    return vectors.mapInArrow(run, _PACK)


def _anchors(packs: DataFrame, every: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for p in batch.select(["dim", "vec_id", "label", "x"]).to_pylist():
                ids, labels = np.array(p["vec_id"]), np.array(p["label"])
                at = np.flatnonzero(ids % every == 0)
                x = np.frombuffer(p["x"], np.int32).reshape(len(ids), p["dim"])
                yield pa.record_batch([pa.array(ids[at]), pa.array(labels[at]), pa.array([p["dim"]] * len(at), pa.int32()), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["anchor_id", "label", "dim", "x"])

    rows = packs.mapInArrow(run, "anchor_id long, label long, dim int, x binary")
    return rows.select(F.monotonically_increasing_id().alias("anchor"), "*")


def _grid(packs: DataFrame, anchors: DataFrame, g: int, h: int, run, schema: str) -> DataFrame:
    """run(packs, anchors) in every cell of the grid."""
    left = packs.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    right = anchors.withColumn("h", F.pmod(F.xxhash64("anchor"), F.lit(h)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(run, schema)


def _cells(packs: pa.Table, anchors: pa.Table):
    """(pack, its ids, labels, x, code, low, high; rows of `anchors`, their vectors) of every pack and block of anchors of its length."""
    dims = anchors.column("dim").to_numpy()
    labels = anchors.column("label").to_numpy()
    vectors = anchors.column("x").to_pylist()
    for p in packs.to_pylist():
        dim, n = p["dim"], len(p["vec_id"])
        x, code = np.frombuffer(p["x"], np.int32).reshape(n, dim), np.frombuffer(p["code"], np.uint8).reshape(n, dim)
        cells = len(p["low"]) // (4 * dim) if dim else 1
        low, high = (np.frombuffer(p[c], np.int32).reshape(dim, cells) for c in ("low", "high"))
        own = np.flatnonzero(dims == dim)
        own = own[np.argsort(labels[own], kind="stable")]
        for i in range(0, len(own), BLOCK):
            at = own[i : i + BLOCK]
            yield np.array(p["vec_id"]), np.array(p["label"]), x, code, low, high, at, np.frombuffer(b"".join(vectors[k] for k in at), np.int32).reshape(len(at), dim)


def _positives(k: int):
    def run(packs: pa.Table, anchors: pa.Table) -> pa.Table:
        names, labels, keys = (anchors.column(c).to_numpy() for c in ("anchor_id", "label", "anchor"))
        best = Best(len(keys), k)
        for ids, of, x, code, low, high, at, vectors in _cells(packs, anchors):
            for label in np.unique(labels[at]):
                a, b = np.searchsorted(of, label), np.searchsorted(of, label, "right")
                mine = np.flatnonzero(labels[at] == label)
                if a == b:
                    continue
                below, above = bounds(code[a:b], low, high, vectors[mine])
                other = ids[a:b, None] != names[at[mine]][None]
                least = best.least[at[mine]]
                if b - a >= k:
                    sure = np.where(other, below, np.iinfo(below.dtype).min)
                    least = np.maximum(least, np.partition(sure, b - a - k, axis=0)[b - a - k])
                row, col = np.nonzero(other & (above >= least[None]))
                best.offer(at[mine][col], exact(x[a:b], row, vectors[mine], col), ids[a:b][row])
        return pa.table({"anchor": keys[best.slot], "positive_score": best.score, "positive_id": best.id})

    return run


def _negatives(k: int, slots: int):
    def run(packs: pa.Table, anchors: pa.Table) -> pa.Table:
        names, labels, keys = (anchors.column(c).to_numpy() for c in ("anchor_id", "label", "anchor"))
        found = anchors.column("positives").to_pylist()
        count = np.array([len(f) for f in found], np.int64)
        ids_of, score_of = np.zeros((len(keys), slots), np.int64), np.zeros((len(keys), slots), np.int64)
        for i, f in enumerate(found):
            ids_of[i, : len(f)], score_of[i, : len(f)] = [p["positive_id"] for p in f], [p["positive_score"] for p in f]
        from_, to = -((-50 * score_of) // 100), (95 * score_of) // 100
        open_ = (np.arange(slots)[None] < count[:, None]) & (from_ <= to)
        best = Best(len(keys) * slots, k)
        for ids, of, x, code, low, high, at, vectors in _cells(packs, anchors):
            below, above = bounds(code, low, high, vectors)
            other = of[:, None] != labels[at][None]
            may = np.zeros(other.shape, bool)
            for j in range(slots):
                least = np.maximum(from_[at, j], best.least[at * slots + j])
                may |= (above >= least[None]) & (below <= to[at, j][None]) & open_[at, j][None]
            row, col = np.nonzero(may & other)
            score = exact(x, row, vectors, col)
            for j in range(slots):
                inside = (score >= from_[at[col], j]) & (score <= to[at[col], j]) & open_[at[col], j]
                best.offer(at[col[inside]] * slots + j, score[inside], ids[row[inside]])
        a, j = best.slot // slots, best.slot % slots
        return pa.table({"anchor": keys[a], "anchor_id": names[a], "slot": j.astype(np.int32), "positive_id": ids_of[a, j], "positive_score": score_of[a, j], "negative_score": best.score, "negative_id": best.id})

    return run


def hard_negatives(vectors: DataFrame, label: Column | None = None, scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3, cells: int = CELLS, group_bytes: int = GROUP_BYTES, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over (vec_id, embedding, label).

    label: the label to use, `label` itself if not given. Anchors are rows whose vec_id is divisible by `every`.
    """
    if not 1 <= cells <= 256:
        raise ValueError("cells must be 1 to 256: a cell is one byte")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.col("embedding").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector")))
    packs = scratch.write(approximated(rows, scale, cells), "packs")
    anchors = scratch.write(_anchors(packs, every), "anchors")
    weight = packs.agg(F.sum(F.size("vec_id").cast("long") * (16 + 5 * F.col("dim")) + 8 * cells * F.col("dim"))).first()[0] or 0
    g, h = 1 + weight // group_bytes, 1 + anchors.count() // group_anchors
    # A pack is at most a sixth of a group; hashing numbers that count up in each task deals them evenly.
    packs = packs.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(g)).cast("int"))
    packs = scratch.write(packs, "dealt")

    def first(df: DataFrame, of: list[str], score: str, name: str, k: int) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(score), name))).where(F.col("rank") <= k)

    found = _grid(packs, anchors, g, h, _positives(positives), "anchor long, positive_score long, positive_id long")
    found = first(found, ["anchor"], "positive_score", "positive_id", positives)
    found = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives"))
    known = scratch.write(anchors.join(found, "anchor"), "known")
    schema = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, negative_score long, negative_id long"
    done = first(_grid(packs, known, g, h, _negatives(negatives, positives), schema), ["anchor", "slot"], "negative_score", "negative_id", negatives)
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
