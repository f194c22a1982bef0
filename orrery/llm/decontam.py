"""Benchmark decontamination by a distributed positional inverted index (operator 5).

`build_index` tokenises whole texts and writes, for each shard of documents, the postings of every
term: positions in the shard's token stream, sorted, difference-coded. `search` takes phrases in
bounded blocks; in each shard it starts from the rarest term of a phrase and intersects the other
terms' lists after subtracting their offsets in the phrase, rarest first, until nothing is left.
Matches never leave their shard, so neither step shuffles text or postings. With slop above 0 a term may stand
that many places from where the phrase has it (proximity).

Terms are 64-bit hashes of folded words. Nulls have no words. Repeated rows are separate documents.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import FOLDED, Hashes, U, chunks, keep_memory, list_array, spans, windows
from orrery.store import Scratch

_INDEX = "shard string, docs array<struct<doc_id:{},n_words:int>>, terms array<long>, counts array<int>, postings binary"


def build_index(documents: DataFrame) -> DataFrame:
    """One row for each shard (about 2 MB of text): documents in order, terms, and their postings. doc_id may be of any type."""

    def run(batches):
        keep_memory()
        for batch in batches:
            for i, j, c in chunks(batch.column("text")):
                codes = c.codes(FOLDED)
                s, e = spans(codes)
                word = Hashes(codes).of(s, e).view(np.int64)
                n = np.bincount(c.text_of(s), minlength=c.n)
                order = np.argsort(word, kind="stable")
                terms, first, counts = np.unique(word[order], return_index=True, return_counts=True)
                delta = np.diff(order, prepend=0)
                delta[first] = order[first]
                ids = batch.column("doc_id").slice(i, j - i)
                docs = pa.StructArray.from_arrays([ids, pa.array(n, pa.int32())], ["doc_id", "n_words"])
                docs = pa.ListArray.from_arrays(pa.array([0, c.n], pa.int32()), docs)
                name = uuid.uuid4().hex  # one for each shard, also where texts and ids are equal; the written index keeps it
                yield pa.record_batch([pa.array([name]), docs, list_array(terms, np.array([len(terms)]), pa.int64()), list_array(counts, np.array([len(counts)]), pa.int32()), pa.array([delta.astype(np.int32).tobytes()], pa.binary())], names=["shard", "docs", "terms", "counts", "postings"])

    return documents.select("doc_id", "text").mapInArrow(run, _INDEX.format(documents.schema["doc_id"].dataType.simpleString()))


class Shard:
    def __init__(self, terms: np.ndarray, counts: np.ndarray, postings: bytes, vocabulary: tuple | None = None):
        self.terms, self.counts, self.vocabulary = terms, counts.astype(np.int64), vocabulary
        self.end = np.cumsum(self.counts)
        self.delta = np.frombuffer(postings, np.int32)
        self.known: dict[int, np.ndarray] = {}

    def places(self, k: int) -> np.ndarray:
        if k not in self.known:
            self.known[k] = np.cumsum(self.delta[self.end[k] - self.counts[k] : self.end[k]], dtype=np.int64)
        return self.known[k]

    def find(self, phrases: np.ndarray, sizes: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place of its first word) of every match in the token stream."""
        inside = np.arange(phrases.shape[1]) < sizes[:, None]
        # Each term is looked up once, however many windows have it.
        terms, which = self.vocabulary if self.vocabulary is not None else np.unique(phrases, return_inverse=True)
        slot = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        there = self.terms[slot] == terms if len(self.terms) else np.zeros(len(terms), bool)
        which = which.reshape(phrases.shape)
        live = np.flatnonzero((there[which] | ~inside).all(1) & (sizes > 0))
        at = np.zeros(phrases.shape, np.int64)
        at[live] = slot[which[live]]
        freq = np.where(inside, self.counts[at], np.iinfo(np.int64).max) if len(self.terms) else inside
        out_p, out_at = [], []
        for p in live:
            order = np.argsort(freq[p], kind="stable")[: sizes[p]]
            found = self.places(at[p, order[0]]) - order[0]
            for k in order[1:]:
                lists = self.places(at[p, k]) - k
                i = np.searchsorted(lists, found - slop)
                ok = i < len(lists)
                ok[ok] = lists[i[ok]] <= found[ok] + slop
                found = found[ok]
                if not len(found):
                    break
            found = found[found >= 0]
            if len(found):
                out_p.append(np.full(len(found), p))
                out_at.append(found)
        if not out_p:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_p), np.concatenate(out_at)


def phrase_windows(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of texts: hashes (windows x width), sizes, and (window, text) pairs; equal windows by a 64-bit hash."""
    value, item, grids, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros((0, width), np.int64)], [np.zeros(0, np.int64)]
    for i, _, c in chunks(pa.array(texts, pa.string())):
        codes = c.codes(FOLDED)
        s, e = spans(codes)
        word, text = Hashes(codes).of(s, e), c.text_of(s)
        h, at = windows(word, text, width)
        size = np.minimum(np.bincount(text, minlength=c.n)[text[at]], width) if len(at) else at
        spot = at[:, None] + np.arange(width)
        inside = np.arange(width) < size[:, None]
        grids.append(np.where(inside, word.view(np.int64)[np.minimum(spot, max(0, len(word) - 1))], 0) if len(at) else np.zeros((0, width), np.int64))
        value.append(h)
        item.append(i + text[at])
        sizes.append(size)
    _, first, which = np.unique(np.concatenate(value), return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(item)], 1), axis=0)
    return np.concatenate(grids)[first], np.concatenate(sizes)[first].astype(np.int64), pairs.reshape(-1, 2)


_HITS = "shard string, place int, doc_id {}, n_words int, runs array<struct<start:int,end:int>>, items array<string>"


def search(index: DataFrame, items: list[tuple], width: int, slop: int = 0) -> DataFrame:
    """For every document of the index: runs of hit words and ids of items with a window in it.

    items: one block of (id as string or null, text), bounded by the caller, sent to every task.
    """
    grid, sizes, pairs = phrase_windows([t for _, t in items], width)
    names = np.array([None if i is None else str(i) for i, _ in items], object)
    shared = index.sparkSession.sparkContext.broadcast((grid, sizes, pairs, names))

    def run(batches):
        grid, sizes, pairs, names = shared.value
        start_of = np.searchsorted(pairs[:, 0], np.arange(len(sizes) + 1)) if len(pairs) else np.zeros(len(sizes) + 1, np.int64)
        vocabulary = np.unique(grid, return_inverse=True)
        for batch in batches:
            for r in range(batch.num_rows):
                docs = batch.column("docs")[r].values
                ids, n = docs.field("doc_id"), docs.field("n_words").to_numpy().astype(np.int64)
                shard = Shard(batch.column("terms")[r].values.to_numpy(), batch.column("counts")[r].values.to_numpy(), batch.column("postings")[r].as_py(), vocabulary)
                p, at = shard.find(grid, sizes, slop)
                end = np.cumsum(n)
                begin = end - n
                doc = np.searchsorted(end, at, "right")
                inside = at + sizes[p] <= end[np.minimum(doc, len(end) - 1)] if len(p) else np.zeros(0, bool)
                p, at, doc = p[inside], at[inside], doc[inside]
                cover = np.zeros(int(end[-1]) + 1 if len(end) else 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + sizes[p], -1)
                hit = np.cumsum(cover[:-1]) > 0
                found_runs, found_items = [[] for _ in n], [[] for _ in n]
                for d in np.unique(doc):
                    own = np.flatnonzero(np.diff(np.concatenate(([0], hit[begin[d] : end[d]].view(np.int8), [0]))))
                    found_runs[d] = [{"start": int(a), "end": int(b)} for a, b in own.reshape(-1, 2)]
                    w = np.unique(p[doc == d])
                    found_items[d] = sorted({names[x] for k in w for x in pairs[start_of[k] : start_of[k + 1], 1]} - {None})
                yield pa.record_batch([
                    pa.array([batch.column("shard")[r].as_py()] * len(n), pa.string()), pa.array(np.arange(len(n)), pa.int32()), ids, pa.array(n, pa.int32()),
                    pa.array(found_runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(found_items, pa.list_(pa.string())),
                ], names=["shard", "place", "doc_id", "n_words", "runs", "items"])

    return index.mapInArrow(run, _HITS.format(index.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()))


def _covered(runs: Column) -> Column:
    """Words in the union of sorted, maybe overlapping runs."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    done = F.aggregate(F.array_sort(runs), zero, lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], r["end"]).alias("upto")))
    return done["n"]


def item_blocks(benchmark: DataFrame, block_chars: int):
    """Lists of (item_id as string, text) of about block_chars characters each, one at a time."""
    sizes = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").withColumn("n", F.length("text").cast("long"))
    total = sizes.agg(F.sum("n"), F.count("*")).first()
    blocks = max(1, -(-int(total[0] or 0) // block_chars))
    for b in range(blocks):
        part = sizes if blocks == 1 else sizes.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()]


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, slop: int = 0, block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document.

    contaminated: n_hit > 0 and share * n_hit >= n_words. The benchmark is searched in blocks of
    about block_chars characters (a fixed memory bound); with several blocks the runs of a document
    are merged by one small shuffle. Items of a null id are searched, but have no name and are left out of the items.
    """
    scratch = Scratch(documents.sparkSession, "decontam")
    index = scratch.write(build_index(documents), "index")
    parts = [search(index, block, width, slop) for block in item_blocks(benchmark, block_chars)]
    out = parts[0]
    if len(parts) > 1:
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        out = union.groupBy("shard", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hit = out.withColumn("n_hit", _covered(F.col("runs")).cast("long"))
    return hit.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
