"""Vector code compression by filtering Lloyd (operator 13).

Each vector is cut into equal consecutive parts; each part position has a codebook of its own. Every pack of vectors
holds one kd-tree for each part position, built once, written, and used again in every round. A node caches the bounding box, the sum and
(by its bounds) the count of its parts. In a round the candidates of a node are filtered: the entry nearest to the box's
middle stays, and another entry goes if it is no better anywhere in the box. A node that is left with one entry is
assigned as a whole, from its cached sum and count; at a leaf the few parts are compared with the entries still left.
All arithmetic is on 64-bit integers, ties go to the lower index, so the assignment is that of a full comparison.

A round sends sums and counts of entries x components through the driver, whatever the number of rows.

Nulls and odd rows: a null vector, or one with a null or non-finite component, is dropped. A null vec_id is kept and sorts last. All
rows of a vec_id that occurs repeatedly count, equal ids in order of their vectors. Parts of a length that is no multiple of the number of parts differ by one.
Vectors of another length than that of the smallest kept vec_id stay as rows with null code and error and take no part. Fewer rows than entries give
fewer entries. Columns other than the three named are not read, so their names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.vectors import finite, packs_of
from orrery.store import Scratch

LEAF = 8


def depth(n: int) -> int:
    """Levels below the root, so that a leaf has more than half of LEAF parts and at most LEAF."""
    d = 0
    while n > LEAF << d:
        d += 1
    return d


def bounds(n: int, level: int) -> np.ndarray:
    """Borders of the 2^level nodes of a level in the order of the tree."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


class Tree:
    """A kd-tree over the rows of x: node k of a level covers order[bounds[k]:bounds[k + 1]]."""

    def __init__(self, x: np.ndarray, order: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], total: list[np.ndarray]):
        self.x, self.order, self.low, self.high, self.total = x, order, low, high, total

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        n, d = x.shape
        order, low, high, total = np.arange(n), [], [], []
        for level in range(depth(n) + 1):
            cut = bounds(n, level)
            own = x[order]
            low.append(np.minimum.reduceat(own, cut[:-1], axis=0))
            high.append(np.maximum.reduceat(own, cut[:-1], axis=0))
            total.append(np.add.reduceat(own.astype(np.int64), cut[:-1], axis=0))
            if level < depth(n):
                wide = np.argmax(high[-1].astype(np.int64) - low[-1], axis=1) if d else np.zeros(len(cut) - 1, np.int64)
                node = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
                key = own[np.arange(n), wide[node]] if d else np.zeros(n, np.int32)
                order = order[np.lexsort((key, node))]
        return cls(x, order, low, high, total)

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum and count of the parts of each entry, and the entry of each row of x."""
        n, d = self.x.shape
        k = len(entries)
        z = entries.astype(np.int64)
        sums, counts = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        code = np.zeros(n, np.int64)  # in the order of the tree
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, k), bool)
        last = depth(n)
        for level in range(last + 1):
            if not len(nodes):
                break
            cut = bounds(n, level)
            low, high = self.low[level][nodes].astype(np.int64), self.high[level][nodes].astype(np.int64)
            to_middle = np.where(open_, ((2 * z[None] - (low + high)[:, None]) ** 2).sum(2), np.iinfo(np.int64).max)
            best = to_middle.argmin(1)
            lead = z[best][:, None]
            corner = np.where(z[None] > lead, high[:, None], low[:, None])  # where the entry does best against the leader
            behind = ((z[None] - lead) * (z[None] + lead - 2 * corner)).sum(2)
            index = np.arange(k)[None]
            open_ = open_ & ((behind < 0) | ((behind == 0) & (index < best[:, None])) | (index == best[:, None]))
            done = open_.sum(1) == 1
            whole, entry = nodes[done], best[done]
            np.add.at(sums, entry, self.total[level][whole])
            size = cut[whole + 1] - cut[whole]
            np.add.at(counts, entry, size)
            code[_ranges(cut[whole], size)] = np.repeat(entry, size)
            nodes, open_ = nodes[~done], open_[~done]
            if level < last:
                nodes, open_ = (2 * nodes[:, None] + np.arange(2)).ravel(), np.repeat(open_, 2, axis=0)
            elif len(nodes):
                size = cut[nodes + 1] - cut[nodes]
                at = _ranges(cut[nodes], size)
                own = self.x[self.order[at]].astype(np.int64)
                far = ((own[:, None] - z[None]) ** 2).sum(2)
                entry = np.where(np.repeat(open_, size, axis=0), far, np.iinfo(np.int64).max).argmin(1)
                np.add.at(sums, entry, own)
                np.add.at(counts, entry, 1)
                code[at] = entry
        out = np.zeros(n, np.int64)
        out[self.order] = code
        return sums, counts, out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same from start[1], and so on."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def cuts(dim: int, parts: int) -> list[tuple[int, int]]:
    return [(dim * i // parts, dim * (i + 1) // parts) for i in range(parts)]


_TREE = pa.list_(pa.struct([(c, pa.binary()) for c in ("place", "low", "high", "total")]))
_TREES = "vec_id array<long>, label array<int>, dim int, x binary, trees array<struct<place:binary,low:binary,high:binary,total:binary>>"


def _build(kept: DataFrame, scale: int, parts: int) -> DataFrame:
    """One row a pack: ids, labels, components, and the parts' trees."""

    def run(batches):
        for batch in batches:
            for rows, dim, x in packs_of(batch, scale, 24):
                row = []
                for a, b in cuts(dim, parts):
                    t = Tree.build(x[:, a:b])
                    row.append({"place": t.order.astype(np.int32).tobytes(), "low": np.concatenate(t.low).tobytes(), "high": np.concatenate(t.high).tobytes(), "total": np.concatenate(t.total).tobytes()})
                take = pa.array(rows)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), batch.column(c).take(take)) for c in ("vec_id", "label")]
                yield pa.record_batch([*lists, pa.array([dim], pa.int32()), pa.array([x.tobytes()]), pa.array([row], _TREE)], names=["vec_id", "label", "dim", "x", "trees"])

    return kept.mapInArrow(run, _TREES)


def _read(x: bytes, trees: list, n: int, dim: int) -> list[Tree]:
    whole, out = np.frombuffer(x, np.int32).reshape(n, dim), []
    nodes = (2 << depth(n)) - 1
    borders = np.cumsum([1 << level for level in range(depth(n))])
    for (a, b), t in zip(cuts(dim, len(trees)), trees):
        low, high = (np.split(np.frombuffer(t[c], np.int32).reshape(nodes, b - a), borders) for c in ("low", "high"))
        total = np.split(np.frombuffer(t["total"], np.int64).reshape(nodes, b - a), borders)
        out.append(Tree(whole[:, a:b], np.frombuffer(t["place"], np.int32), low, high, total))
    return out


def _packs(batches, dim):
    for batch in batches:
        for row in batch.to_pylist():
            n = len(row["vec_id"])
            yield row, (_read(row["x"], row["trees"], n, dim) if row["dim"] == dim else None)


def _sums(trees: DataFrame, books: list[np.ndarray], dim: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums and counts of all entries: added up in each task, then over the tasks by (entry, component)."""
    k = len(books[0])

    def run(batches):
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(k, np.int64) for _ in books]
        for _, own in _packs(batches, dim):
            for i, t in enumerate(own or ()):
                s, c, _ = t.assign(books[i])
                sums[i] += s
                counts[i] += c
        slot = np.repeat(np.arange(len(books) * k), [b.shape[1] + 1 for b in books for _ in range(k)])
        value = np.concatenate([np.concatenate((counts[i][:, None], sums[i]), 1).ravel() for i in range(len(books))])
        place = np.concatenate([np.tile(np.arange(b.shape[1] + 1), k) for b in books])
        yield pa.record_batch([pa.array(slot.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(value)], names=["slot", "place", "value"])

    got = trees.mapInArrow(run, "slot int, place int, value long").groupBy("slot", "place").agg(F.sum("value").alias("value")).collect()
    sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(k, np.int64) for _ in books]
    for slot, place, value in got:
        if place:
            sums[slot // k][slot % k, place - 1] = value
        else:
            counts[slot // k][slot % k] = value
    return sums, counts


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, spread: int = 64) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of every kept row of (vec_id, embedding, label), and the codebooks.

    code: the entry's index in each part, two hex digits each; entries is at most 256. A hot label is split over `spread` keys where its sum is joined back.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "codes")
    vector = F.col("embedding")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").cast("int").alias("label")).where(finite(F.col("vector")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(1).collect()
    dim = len(first[0][0]) if first else 0
    seeds = kept.where(F.size("vector") == dim).orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    start = np.floor(np.array([s[0] for s in seeds], np.float64).reshape(len(seeds), dim) * scale).astype(np.int64)
    books = [start[:, a:b].copy() for a, b in cuts(dim, parts)]
    schema = "vec_id long, label int, code string, error long"
    if not seeds:
        empty = spark.createDataFrame([], schema)
        return empty.withColumn("label_error", F.lit(None).cast("long")), books
    trees = scratch.write(_build(kept, scale, parts), "trees")
    for _ in range(rounds):
        sums, counts = _sums(trees, books, dim)
        books = [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], b) for s, c, b in zip(sums, counts, books)]

    def run(batches):
        for row, own in _packs(batches, dim):
            n = len(row["vec_id"])
            code, error = [None] * n, np.zeros(n, np.int64)
            if own is not None:
                every = np.stack([t.assign(b)[2] for t, b in zip(own, books)], 1)
                for i, (t, b) in enumerate(zip(own, books)):
                    error += ((t.x.astype(np.int64) - b[every[:, i]]) ** 2).sum(1)
                code = [bytes(c).hex() for c in every.astype(np.uint8)]
            yield pa.record_batch(
                [pa.array(row["vec_id"], pa.int64()), pa.array(row["label"], pa.int32()), pa.array(code, pa.string()), pa.array(error if own is not None else [None] * n, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    coded = scratch.write(trees.mapInArrow(run, schema), "coded")
    # The sums are written first, so Spark knows their size when it chooses the join; a hot label is spread over several keys.
    by_label = scratch.write(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    coded = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(spread)).cast("int"))
    by_label = by_label.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    joined = coded.join(by_label, coded["label"].eqNullSafe(by_label["of"]) & (coded["salt"] == by_label["part"]))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex SHA-256 of all components, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
