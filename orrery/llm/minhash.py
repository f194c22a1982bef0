"""Near-duplicates of documents by DartMinHash, banding and exact verification (operator 1).

Signature: darts are thrown at each element (a shingle of five words). An element of weight w owns
the region [0, w) x [0, inf) of weights and ranks; each unit cell of the weight axis has its own
Poisson stream of darts, read off hashes of (element, cell, throw). A dart beyond the weight
misses. The earliest dart of each of the k coordinates is kept. Ranks are only thrown up to about
(ln k + 3) k / W for total weight W, and further where a coordinate is still empty, so a document
costs its elements plus k log k darts. Equal coordinates have the probability of the weighted Jaccard similarity.

Candidates: 32 bands of 4 coordinates miss a pair of similarity 0.8 with probability 5e-8. In every
band bucket the members are compared with the bucket's least member only, a linear number of pairs;
exact Jaccard decides, and components form. Buckets that still hold several components are compared
with further centers in the same way; where several are left then, all members meet one another in blocks of bounded
size, by exact Jaccard again. So a link between different texts is lost only if the bands miss it.

Words: `[0-9a-z]` and everything past ASCII, A-Z folded. Weight: 1 for each distinct shingle, or its
count. Texts equal byte for byte (128-bit digest) are one member. Null and wordless texts are
grouped by equal text only; a null text equals no other. Repeated rows are equal texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import FOLDED, Chunk, Hashes, U, chunks, keep_memory, list_array, mix, spans, windows
from orrery.operators.components import connected_components
from orrery.store import Scratch

K, ROWS = 128, 4
#: Further centers that a bucket of several components is compared with before its members meet one another.
STARS = 3


def dart_signatures(element: np.ndarray, owner: np.ndarray, n: int, k: int = K, weight: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """Rank of the earliest dart of each coordinate (n x k); inf where a set is empty.

    element: 64-bit hashes; owner: the set of each, below n; weight: positive, 1 by default.
    """
    sig = np.full(n * k, np.inf)
    frac = np.ones(len(element))
    if weight is not None:
        cells = np.ceil(weight).astype(np.int64)
        first = np.cumsum(cells) - cells
        cell = np.arange(cells.sum()) - np.repeat(first, cells)
        frac = np.minimum(1.0, np.repeat(weight, cells) - cell)
        element, owner = mix(np.repeat(element, cells) + cell.astype(U) * U(0xC2B2AE3D27D4EB4F)), np.repeat(owner, cells)
    total = np.bincount(owner, weights=frac, minlength=n)
    limit = k * (np.log(k) + 3) / np.maximum(total, 1e-9)
    stream = mix(element ^ mix(np.array([seed], U)))
    alive = np.arange(len(element))
    rank, throw, todo = np.zeros(len(element)), np.zeros(len(element), U), np.ones(n, bool)
    while len(alive):
        # Throw until a dart lies beyond its set's limit; that dart is thrown again if the limit moves.
        going = alive
        while len(going):
            h = mix(stream[going] + (throw[going] + U(1)) * U(0x9E3779B97F4A7C15))
            step = -np.log1p(-((h >> U(11)).astype(np.float64) * 2.0**-53))
            new = rank[going] + step
            near = new <= limit[owner[going]]
            going, h, new = going[near], h[near], new[near]
            rank[going] = new
            throw[going] += U(1)
            h2 = mix(h)
            hit = (h2 & U(0xFFFFFF)).astype(np.float64) * 2.0**-24 < frac[going]
            np.minimum.at(sig, owner[going[hit]] * k + ((h2[hit] >> U(32)) % U(k)).astype(np.int64), new[hit])
        todo = np.isinf(sig.reshape(n, k)).any(1) & (total > 0)
        limit[todo] *= 2
        alive = alive[todo[owner[alive]]]
    return sig.reshape(n, k)


def shingles(c: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every shingle of `width` folded words."""
    codes = c.codes(FOLDED)
    s, e = spans(codes)
    text = c.text_of(s)
    h, at = windows(Hashes(codes).of(s, e), text, width)
    return h, text[at]


_SKETCH = "doc_id long, row long, digest binary, bands array<long>"


def sketch(documents: DataFrame, width: int = 5, counted: bool = False) -> DataFrame:
    """Content digest and band keys of every row, in one pass."""

    def run(batches):
        keep_memory()
        for batch in batches:
            for i, j, c in chunks(batch.column("text")):
                h, text = shingles(c, width)
                weight = None
                if counted and len(h):
                    order = np.lexsort((h, text))
                    h, text = h[order], text[order]
                    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
                    at = np.flatnonzero(new)
                    weight = np.diff(np.append(at, len(h))).astype(float)
                    h, text = h[at], text[at]
                sig = dart_signatures(h, text, c.n, weight=weight)
                bits = mix(sig.view(U))
                some = np.isfinite(sig[:, 0])
                band = np.zeros((c.n, K // ROWS), U)
                for r in range(ROWS):
                    band = mix(band * U(31) + bits[:, r::ROWS])
                band = mix(band + np.arange(K // ROWS, dtype=U))
                bands = list_array(band[some].ravel().view(np.int64), np.where(some, K // ROWS, 0), pa.int64())
                yield pa.record_batch([
                    batch.column("doc_id").slice(i, j - i), batch.column("row").slice(i, j - i), batch.column("digest").slice(i, j - i), bands,
                ], names=["doc_id", "row", "digest", "bands"])

    digest = F.when(F.col("text").isNotNull(), F.unhex(F.md5(F.col("text").cast("binary"))))
    return documents.select("doc_id", "row", "text", digest.alias("digest")).mapInArrow(run, _SKETCH)


def shingle_sets(documents: DataFrame, width: int) -> DataFrame:
    """(member, shingles): sorted distinct shingle hashes of each row's text."""

    def run(batches):
        keep_memory()
        for batch in batches:
            for i, j, c in chunks(batch.column("text")):
                h, text = shingles(c, width)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                yield pa.record_batch([batch.column("member").slice(i, j - i), list_array(h[new].view(np.int64), np.bincount(text[new], minlength=c.n), pa.int64())], names=["member", "shingles"])

    return documents.select("member", "text").mapInArrow(run, "member long, shingles array<long>")


def _jaccard(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; sizes too far apart are left before the sets meet."""
    own = sets.select(F.col("member").alias("a"), F.col("shingles").alias("sa"))
    other = sets.select(F.col("member").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(own, "a").join(other, "b")
    both = both.where(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")))
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def open_rows(rows: DataFrame, comps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(key, member, component) of the buckets (key, member) that hold more than one component."""
    named = rows.join(comps.withColumnRenamed("id", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return scratch.write(named.join(keys, "key").select("key", "member", "component"), name)


def _star(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of each bucket's center, drawn by a hash, and the members outside the center's component."""
    drawn = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("member", F.lit(seed)).alias("h"), F.col("member").alias("m"), F.col("component").alias("c"))).alias("center"))
    apart = rows.join(drawn, "key").where("component <> center.c")
    return apart.select(F.least("member", "center.m").alias("a"), F.greatest("member", "center.m").alias("b")).distinct()


def spanning_forest(member: np.ndarray, component: np.ndarray, row: np.ndarray, shingle: np.ndarray, threshold: float, new: Callable | None = None) -> pa.Table:
    """Links (a, b) that join the components of some members where sets reach the threshold; (row, shingle): the distinct elements of each member's set, by row.

    Each member is compared with the later ones; once all later ones are joined to it, nothing is left to do.
    new(i, later): which of some later rows have not been compared with row i elsewhere.
    """
    _, label, n = np.unique(component, return_inverse=True, return_counts=True)
    # Least components first: the members of the greatest, mostly at the end, need not meet one another.
    order = np.lexsort((label, n[label]))
    label, member = label[order], member[order]
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    row = turn[row]
    by = np.argsort(row, kind="stable")
    _, ids = np.unique(shingle, return_inverse=True)
    row, ids = row[by], ids[by]
    size = np.bincount(row, minlength=len(member))
    begin = np.cumsum(size) - size
    held = np.zeros(len(ids) + 1, bool)
    a, b = [], []
    for i in range(len(member) - 1):
        later = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (np.minimum(size[i + 1 :], size[i]) >= threshold * np.maximum(size[i + 1 :], size[i])))
        if new is not None and len(later):
            later = later[new(order[i], order[later])]
        if not len(later):
            if (label[i:] == label[i]).all():
                break
            continue
        held[ids[begin[i] : begin[i] + size[i]]] = True
        n = size[later]
        at = np.repeat(begin[later] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(np.repeat(np.arange(len(later)), n)[held[ids[at]]], minlength=len(later))
        held[ids[begin[i] : begin[i] + size[i]]] = False
        for j in later[common >= threshold * (size[i] + n - common)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(member[i])
                b.append(member[j])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _across(rows: DataFrame, sets: DataFrame, threshold: float, block: int, most: int = 1 << 19) -> DataFrame:
    """Links (a, b) of members of one bucket (key, member, component) that join its components, by exact Jaccard of their sets.

    A bucket of more than `block` members or `most` shingles is dealt into parts, and each pair of parts is one group, so no
    group grows with the bucket. A group compares each member with the later ones that are not joined to it yet and
    gives a spanning forest: fewer links than members.
    """
    rows = rows.join(sets.select("member", F.size("shingles").alias("size")), "member")
    sized = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    parts = rows.join(sized, "key").withColumn("parts", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / most)).cast("int"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    # Two members of one part meet in its groups with the other parts.
    dealt = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or part <> other")
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "member", "component").join(sets, "member")

    def forest(table: pa.Table) -> pa.Table:
        size = pc.list_value_length(table.column("shingles")).to_numpy().astype(np.int64)
        return spanning_forest(table.column("member").to_numpy(), table.column("component").to_numpy(), np.repeat(np.arange(len(size)), size), pc.list_flatten(table.column("shingles")).to_numpy(), threshold)

    return dealt.groupBy("key", "p", "q").applyInArrow(forest, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, threshold: float = 0.8, width: int = 5, counted: bool = False, block: int = 2048) -> DataFrame:
    """doc_id, class_id, is_kept for every row: class_id is the least doc_id of its component.

    is_kept: the one row of each class that stays, the first by (doc_id, row hash). Links join texts of Jaccard
    similarity `threshold` or more over distinct shingles; classes are their connected components.
    """
    if threshold < 0.5:
        raise ValueError("the bands are laid out for thresholds of 0.5 or more")
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    # A row's number: unique but for rows equal in id and text, which are one member anyway.
    rows = documents.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    sketched = scratch.write(sketch(rows, width, counted), "sketch")
    first = sketched.where("digest is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    members = scratch.write(sketched.select("digest", "row", F.struct("doc_id", "row").alias("own")).join(first, "digest").select("digest", "row", F.col("first.row").alias("member"), (F.col("own") == F.col("first")).alias("is_first")), "members")
    unique = members.where("is_first and row = member").select("row", F.col("member")).dropDuplicates(["member"])
    lead = scratch.write(sketched.where("size(bands) > 0").select("row", "bands").join(unique, "row").select("member", "bands").dropDuplicates(["member"]), "lead")
    banded = lead.select("member", F.explode("bands").alias("key"))
    least = banded.groupBy("key").agg(F.min("member").alias("center"), F.max("member").alias("far")).where("center <> far").select("key", "center")
    buckets = scratch.write(banded.join(least, "key"), "buckets")
    pairs = scratch.write(buckets.where("member <> center").select(F.col("center").alias("a"), F.col("member").alias("b")).distinct(), "pairs-1")
    involved = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct()
    texts = rows.join(unique.join(involved, "member", "left_semi").withColumnRenamed("member", "m"), "row").select(F.col("m").alias("member"), "text").dropDuplicates(["member"])
    sets = scratch.write(shingle_sets(texts, width), "sets")
    links = scratch.write(_jaccard(pairs, sets, threshold), "links-1")
    comps = scratch.write(connected_components(links), "components-1")
    # Buckets whose members are not yet one component: other centers first, each a linear number of pairs that joins
    # most of what belongs together; then all members meet all others.
    rest, tried = open_rows(buckets.select("key", "member"), comps, scratch, "open-0"), pairs
    for k in range(1, STARS + 1):
        if not rest.limit(1).count():
            break
        star = scratch.write(_star(rest, k).join(tried, ["a", "b"], "left_anti"), f"star-{k}")
        tried = tried.unionByName(star)
        links = links.unionByName(scratch.write(_jaccard(star, sets, threshold), f"star-links-{k}"))
        comps = scratch.write(connected_components(links), f"star-components-{k}")
        rest = open_rows(rest.select("key", "member"), comps, scratch, f"open-{k}")
    if rest.limit(1).count():
        links = scratch.write(links.unionByName(_across(rest, sets, threshold, block)), "links-2")
        comps = scratch.write(connected_components(links), "components-2")
    labelled = members.join(comps.withColumnRenamed("id", "member"), "member", "left").select("row", F.coalesce("component", "member").alias("component")).dropDuplicates(["row"])
    own = sketched.select("doc_id", "row").join(labelled, "row", "left").withColumn("component", F.coalesce("component", "row"))
    own = scratch.write(own.withColumn("place", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "row")), "labelled")
    # The first row of a class stays; of rows equal in id and text, one.
    firsts = own.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.min("place").alias("first"))
    out = own.join(firsts, "component").withColumn("at_first", F.col("place") == F.col("first"))
    return out.select("doc_id", "row", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("at_first").alias("is_kept"))
