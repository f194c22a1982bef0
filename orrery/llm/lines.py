"""Fuzzy line dedup by MinHash (operator 10).

Lines with a word are compared over all documents. Signature: character shingles of `Q` bytes,
hashed once each into one of 48 bins, the least hash of a bin being its coordinate (one-permutation MinHash;
an empty bin borrows its right neighbour's value, mixed with the distance). Bands of 4 coordinates, 12
of them, miss a pair of similarity 0.8 with probability 2e-3, of 0.9 with 2e-5. Every member of a
band bucket is paired with the bucket's least line; exact Jaccard over shingle sets verifies each pair. Verified
pairs join into components by a distributed union-find. Where a bucket still holds several components, its members
meet one another in blocks of bounded size, by exact Jaccard again, so no link inside a bucket is lost. The first line
of each component, by (doc_id, line number), stays.

Equal lines (128 bits of hash) are one member from the start. A line of fewer than `Q` bytes has one shingle: itself. Null texts
have no lines; lines without a word are never removed. Repeated rows are documents of their own;
the lesser row hash comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.minhash import open_rows, spanning_forest
from orrery.llm.text import SPACED, Chunk, U, chunks, keep_memory, list_array, mix
from orrery.operators.components import connected_components
from orrery.store import Scratch

BLOCK = 1 << 20
#: Lines of a bucket that all others of it are compared with at first.
STARS = 3
Q, BINS, ROWS = 8, 48, 4
BANDS = BINS // ROWS
#: Band keys are shuffled in so many passes, each over its bands alone: one pass's shuffle files are on disk at a time.
PASSES = 2
#: Ranges of keys that a shuffle partition gets; a task sorts one after the other.
RANGES = 4
_TOP = np.iinfo(np.uint64).max
_WORD = SPACED != 0
_SPACES = bytes(np.flatnonzero(~_WORD).tolist())


def _strip(line: bytes) -> bytes:
    """The line from its first to its last word."""
    return line.strip(_SPACES)


class Lines:
    """The lines of a chunk that have a word: bytes [s, e) of `data`, their text, and their number in it."""

    def __init__(self, c: Chunk):
        self.data = np.concatenate([c.data, np.zeros(Q, np.uint8)])
        size = len(c.data)
        end = np.flatnonzero((c.data == 10) | ~c.inside)  # every text ends in a mark, so every line has an end
        begin = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        # Most lines begin with a word; the others are looked at whole.
        has = _WORD[c.data[begin]] & c.inside[begin]
        for k in np.flatnonzero(~has & (begin < end)).tolist():
            has[k] = bool(_strip(c.data[begin[k] : end[k]].tobytes()))
        text = c.text_of(begin)
        number = np.arange(len(begin)) - np.searchsorted(begin, c.start)[text]
        self.s, self.e, self.text, self.number, self.size = begin[has], end[has], text[has], number[has], size

    def digests(self) -> np.ndarray:
        """128 bits of hash of each line, as two columns."""
        raw = self.data.tobytes()
        out = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(self.s.tolist(), self.e.tolist(), strict=True)])
        return np.frombuffer(out, np.int64).reshape(-1, 2)

    def shingles(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index into which) of the byte shingles of some lines; a short line is one shingle, filled up with zeros.

        Bytes that begin no such shingle have the index len(which).
        """
        # Eight bytes from each byte on, as a number.
        h = np.ndarray(len(self.data) - Q + 1, "<u8", self.data, 0, (1,)).astype(U)
        s, e = self.s[which], self.e[which]
        n = np.maximum(e - s - Q + 1, 1)
        bound = np.zeros(2 * len(s) + 2, np.int64)
        bound[1:-1:2], bound[2:-1:2], bound[-1] = s, s + n, len(h)
        slot = np.full(2 * len(s) + 1, len(s), np.int32)
        slot[1::2] = np.arange(len(s))
        line = np.repeat(slot, np.diff(bound))
        short = np.flatnonzero(e - s < Q)
        if len(short):
            size = (e - s)[short].astype(U)
            kept = U(8) * (U(Q) - size)
            # The line's bytes are the low ones; its length tells it from lines with zero bytes.
            h[s[short]] = ((h[s[short]] << kept) >> kept) ^ (size << U(60))
        h *= U(0x9E3779B97F4A7C15)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        return h, line


def signatures(hashes: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash (n x BINS): the least hash of each of BINS ranges; an empty one takes its right neighbour's, mixed with the distance."""
    sig = np.full((n + 1) * BINS, _TOP, U)
    at = (hashes >> U(40)).astype(np.int32)
    at *= np.int32(BINS)
    at >>= np.int32(24)
    at += line * np.int32(BINS)
    np.minimum.at(sig, at, hashes)
    sig = sig.reshape(-1, BINS)[:n]
    thin = np.flatnonzero((sig == _TOP).any(1))
    if len(thin):
        part = sig[thin]
        where = np.where(part == _TOP, 2 * BINS, np.arange(BINS))
        where = np.concatenate([where, where + BINS], 1)
        full = np.minimum.accumulate(where[:, ::-1], 1)[:, ::-1][:, :BINS]  # the next full bin, going round
        away = (full - np.arange(BINS)).astype(U)
        part = np.take_along_axis(part, full % BINS, 1)
        sig[thin] = np.where(away > 0, mix(part + away * U(0x9E3779B97F4A7C15)), part)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.zeros((len(sig), BANDS), U)
    for r in range(ROWS):
        key = mix(key * U(31) + sig[:, r::ROWS])
    return mix(key + np.arange(BANDS, dtype=U)).view(np.int64)


_KEYS = [f"keys{p}" for p in range(PASSES)]
_LINES = "d long, row long, line int, h1 long, h2 long, body binary, " + ", ".join(f"{k} binary" for k in _KEYS)

#: The table of lines is the largest one and read few times: it is compressed lightly, and its texts and keys, hardly two of them equal in a file, have no dictionaries.
_PLAIN = {"parquet.compression.codec.zstd.level": "1", **{f"parquet.enable.dictionary#{c}": "false" for c in ("body", *_KEYS)}}


def _packed(values: np.ndarray, counts: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """A binary column of 64-bit values, `counts` of them in each row: Spark moves it as one value, not as a list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(8 * counts, out=offsets[1:])
    mask = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(counts), [mask, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.Array) -> np.ndarray:
    """The 64-bit values of a packed column, or of a list column."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        return column.flatten().to_numpy()
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.int64, (int(offsets[-1]) - int(offsets[0])) // 8, int(offsets[0])) if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.int64)


def line_table(rows: DataFrame) -> DataFrame:
    """Every line with a word: its place and hashes, and where a task meets it first its bytes and band keys, those of each pass packed in a column."""

    def run(batches):
        keep_memory()
        met: set = set()
        for batch in batches:
            for i, j, c in chunks(batch.column("text"), BLOCK):
                own = Lines(c)
                ids = own.digests()
                fresh = []
                for k, x in enumerate(ids[:, 0].tolist()):
                    if x not in met:
                        met.add(x)
                        fresh.append(k)
                if len(met) > 500_000:
                    met.clear()
                fresh = np.array(fresh, np.int64)
                keys = band_keys(signatures(*own.shingles(fresh), len(fresh)))
                has = np.zeros(len(ids), np.int64)
                has[fresh] = 1
                raw = own.data.tobytes()
                bodies = [raw[a:b] if f else None for a, b, f in zip(own.s.tolist(), own.e.tolist(), has.tolist(), strict=True)]
                take = pa.array(own.text)
                places = [batch.column(x).slice(i, j - i).take(take) for x in ("d", "row")]
                packed = [_packed(keys[:, p::PASSES].ravel(), has * keys[:, p::PASSES].shape[1], has > 0) for p in range(PASSES)]
                yield pa.record_batch([*places, pa.array(own.number, pa.int32()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(bodies, pa.binary()), *packed], names=["d", "row", "line", "h1", "h2", "body", *_KEYS])

    return rows.select("d", "row", "text").mapInArrow(run, _LINES)


def _frequent(batches):
    """(key, n) of the keys that are over one in 20,000 of a million or more key rows, by counting these; of fewer rows, all keys."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        on = n > size // 20_000
        return pa.record_batch([pa.array(key[on]), pa.array(n[on])], names=["key", "n"])

    for batch in batches:
        for column in batch.columns:
            held.append(_flat(column))
            size += len(held[-1])
        if size >= 1 << 20:
            yield counted()
            held, size = [], 0
    if size:
        yield counted()


def hot_keys(fresh: DataFrame, most: int) -> DataFrame:
    """(key, salts) of the buckets of more than `most` rows, by a mergeable count of all rows that leaves out less than one in 20,000 of them for a key; 1,000 keys at most.

    Only the dealing of rows to tasks hangs on it: a key left out is dealt to one task, which streams it.
    """
    counts = fresh.select(*_KEYS).mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") > most).orderBy(F.desc("n"), "key").limit(1000).select("key", F.ceil(F.col("n") / most).cast("int").alias("salts"))


def _parts(key: np.ndarray, h: np.ndarray, hot: dict) -> tuple[np.ndarray, np.ndarray]:
    """(rows of hot buckets, the key of the part of its bucket that each of them is dealt to); hot: the number of parts of each hot key."""
    if not hot:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = np.array(sorted(hot), np.int64)
    salts = np.array([hot[k] for k in known.tolist()], U)
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    on = np.flatnonzero(known[at] == key)
    return on, mix(key[on].view(U) ^ mix(mix(h[on].view(U)) % salts[at[on]] + U(1))).view(np.int64)


def _deal(hot: dict, ranges: int, most: int = 1 << 20):
    """Streams (h1, keys) to blocks (range, keys, h1s), packed: each task's rows by the range of their key, those of hot buckets by the key of their part."""

    def block(keys: list, lines: list) -> pa.RecordBatch:
        key, h = np.concatenate(keys), np.concatenate(lines)
        on, part = _parts(key, h, hot)
        key[on] = part
        at = (((key.view(U) >> U(32)) * U(ranges)) >> U(32)).astype(np.int32)
        order = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=ranges)
        some = np.flatnonzero(n)
        return pa.record_batch([pa.array(some, pa.int32()), _packed(key[order], n[some]), _packed(h[order], n[some])], names=["range", "keys", "lines"])

    def run(batches):
        keys, lines, size = [], [], 0
        for batch in batches:
            keys.append(_flat(batch.column(1)))
            lines.append(np.repeat(batch.column("h1").to_numpy(), len(keys[-1]) // max(1, batch.num_rows)))
            size += len(keys[-1])
            if size >= most:
                yield block(keys, lines)
                keys, lines, size = [], [], 0
        if size:
            yield block(keys, lines)

    return run


def _of_hot(hot: dict):
    """Streams (h1, keys of each pass) to the rows (key, part, h1) of hot buckets."""

    def run(batches):
        for batch in batches:
            for column in batch.columns[1:]:
                key = _flat(column)
                h = np.repeat(batch.column("h1").to_numpy(), len(key) // max(1, batch.num_rows))
                on, part = _parts(key, h, hot)
                yield pa.record_batch([pa.array(key[on]), pa.array(part), pa.array(h[on])], names=["key", "part", "h1"])

    return run


def _sorted(batches):
    """Blocks (range, keys, lines) sorted by range to rows (key, h1) sorted by both within whole ranges."""
    held: list = []

    def rows(blocks: list) -> pa.RecordBatch:
        key, h = (np.concatenate([_flat(b.column(x)) for b in blocks]) for x in ("keys", "lines"))
        order = np.argsort(key)
        key, h = key[order], h[order]
        same = key[1:] == key[:-1]
        # Few keys come twice: only theirs are put in order of the lines.
        on = np.flatnonzero(np.append(same, False) | np.append(False, same))
        h[on] = h[on[np.lexsort((h[on], key[on]))]]
        return pa.record_batch([pa.array(key), pa.array(h)], names=["key", "h1"])

    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column("range").to_numpy()
        if held and held[0].column("range")[0].as_py() != at[0]:
            yield rows(held)
            held = []
        first = int(np.searchsorted(at, at[-1]))
        if first:
            yield rows([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield rows(held)


def _meet(batches):
    """Rows (key, h1) sorted by both: those of keys of two lines or more, with their rank in the key and its centers.

    Centers are the first STARS lines of a key; a line has those that come before it. Only these are held.
    """
    group, count, last, centers, held = None, 0, None, [], None
    for batch in batches:
        key, h = (batch.column(x).to_numpy() for x in ("key", "h1"))
        if held is not None:
            key, h = np.append(held[0], key), np.append(held[1], h)
        n = len(h)
        if not n:
            continue
        goes_on = count > 0 and key[0] == group
        # Lines alone with their key go at once; the last key may go on.
        change = np.ones(n + 1, bool)
        change[1:-1] = key[1:] != key[:-1]
        change[0], change[-1] = not goes_on, False
        on = np.flatnonzero(~(change[:-1] & change[1:]))
        key, h = key[on], h[on]
        # A line that several tasks met first comes several times.
        same = np.zeros(len(h), bool)
        same[1:] = (key[1:] == key[:-1]) & (h[1:] == h[:-1])
        same[:1] = goes_on and h[:1] == last
        key, h = key[~same], h[~same]
        n = len(h)
        if not n:
            continue
        goes_on = goes_on and key[0] == group
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        g = np.cumsum(new) - 1
        before = np.zeros(len(first), np.int64)
        before[0] = count if goes_on else 0
        rank = np.arange(n) - first[g] + before[g]
        total = np.diff(np.append(first, n)) + before
        known = np.zeros((n, STARS), np.int64)
        for k in range(STARS):
            known[:, k] = h[np.clip(first[g] + k - before[g], 0, n - 1)]
            if goes_on and k < len(centers):
                known[g == 0, k] = centers[k]
        on = total[g] > 1
        size = np.minimum(rank[on], STARS)
        yield pa.record_batch([pa.array(key[on]), pa.array(h[on]), pa.array(rank[on]), list_array(known[on][np.arange(STARS) < size[:, None]], size, pa.int64())], names=["key", "h1", "rank", "centers"])
        if total[-1] == 1:  # it may be alone: it waits for the next batch
            held, count, group = (key[-1:], h[-1:]), 0, None
        else:
            own = h[first[-1] :][:STARS].tolist()
            centers = (centers + own)[:STARS] if goes_on and len(first) == 1 else own
            held, count, group, last = None, int(total[-1]), key[-1], h[-1]


def _grams(column: pa.Array, row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the shingles of a binary column of single lines, repeats included."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    own = Lines.__new__(Lines)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if len(column) and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    own.data, own.s, own.e = np.concatenate([raw, np.zeros(Q, np.uint8)]), offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    h, line = own.shingles(np.arange(len(column)))
    on = line < len(column)
    return line[on].astype(np.int64), h[on]


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash), sorted."""
    span = np.searchsorted(row, np.arange(n + 1)).tolist()
    for a, b in zip(span, span[1:], strict=False):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _with_size(batches):
    """Adds n, the number of distinct shingles."""
    keep_memory()
    for batch in batches:
        row, _ = _distinct(*_grams(batch.column("body")), batch.num_rows)
        yield pa.record_batch([*batch.columns, pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int32))], names=[*batch.schema.names, "n"])


def _runs(body: pa.Array, most: int = BLOCK):
    """(first, after the last) of runs of rows of `most` bytes, or of one row."""
    end = np.cumsum(pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(end):
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def _similar(threshold: float):
    """Streams (a, salt, b, n, body) sorted so that each center (b is null) comes before its members: links (a, b) at the threshold."""

    def run(batches):
        keep_memory()
        own = np.zeros(0, U)  # the set of the center that goes on
        for batch in batches:
            for i, j in _runs(batch.column("body")):
                part = batch.slice(i, j - i)
                b, size = part.column("b"), part.column("n").to_numpy()
                center = np.asarray(b.is_null())
                row, h = _distinct(*_grams(part.column("body")), len(size))
                # All sets at once: those of the centers, the one that goes on first, and for each member the number of its center.
                of = np.cumsum(center)
                at_center = center[row]
                head, mine = np.append(np.zeros(len(own), np.int64), of[row[at_center]]), np.append(own, h[at_center])
                begin = np.searchsorted(head, np.arange(of[-1] + 2))
                row, h = row[~at_center], h[~at_center]
                # Elements are found by the center's number and their upper bits, which keep their order, then compared whole.
                bits = U(int(of[-1] + 1).bit_length())
                key = lambda n, x: (n.astype(U) << (U(64) - bits)) | (x >> bits)  # noqa: B023, E731
                at = np.searchsorted(key(head, mine), key(of[row], h))
                mine = np.append(mine, np.zeros(2, U))
                edge = begin[of[row] + 1]
                hit = ((mine[at] == h) & (at < edge)) | ((mine[at + 1] == h) & (at + 1 < edge))
                common = np.bincount(row[hit], minlength=len(size))
                ok = ~center & (common >= threshold * (np.diff(begin)[of] + size - common))
                own = mine[begin[-2] : begin[-1]]
                yield pa.record_batch([part.column("a"), b], names=["a", "b"]).filter(pa.array(ok))

    return run


def _verified(pairs: DataFrame, bodies: DataFrame, threshold: float, parts: int, most: int = 4096) -> DataFrame:
    """The pairs (a, b) of line hashes whose exact shingle sets reach the threshold.

    Members whose set's size allows it come to their center, whose text is shipped once for `most` of them.
    """
    sized = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("salts"))
    sized = sized.join(bodies.select(F.col("h1").alias("a"), F.col("n").alias("na")), "a")
    members = pairs.join(sized, "a").join(bodies.select(F.col("h1").alias("b"), "n", "body"), "b").where(F.least("n", "na") >= threshold * F.greatest("n", "na"))
    members = members.select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "n", "body")
    heads = sized.join(bodies.select(F.col("h1").alias("a"), "body"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("na").alias("n"), "body")
    rows = members.unionByName(heads).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_similar(threshold), "a long, b long")


def _few_pairs(component: np.ndarray, size: np.ndarray, met: np.ndarray, threshold: float, most: int = 256) -> np.ndarray | None:
    """The pairs of a group (pairs x 2) that are of two components, near enough in size and in no earlier band; None if the group or their number is large."""
    n = len(component)
    if n > most:
        return None
    a, b = np.triu_indices(n, 1)
    on = (component[a] != component[b]) & (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]))
    a, b = a[on], b[on]
    on = ~(met[a] == met[b]).any(1)
    return np.stack([a[on], b[on]], 1) if on.sum() <= 8 * n else None


def _forest_of_pairs(pairs: np.ndarray, member: np.ndarray, component: np.ndarray, sets: list, threshold: float) -> pa.Table:
    """Links (a, b) of those of some pairs that reach the threshold, a spanning forest; sets: the sorted distinct elements of each member."""
    label, a, b = component.copy(), [], []
    for i, j in pairs.tolist():
        if label[i] == label[j]:
            continue
        both = np.concatenate((sets[i], sets[j]))
        both.sort(kind="stable")  # two sorted runs are merged
        common = np.count_nonzero(both[1:] == both[:-1])
        if common >= threshold * (len(both) - common):
            label[label == label[j]] = label[i]
            a.append(member[i])
            b.append(member[j])
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _forests(threshold: float):
    """Streams (key, p, q, member, component, body) sorted by key, p and q: links of each group's spanning forest.

    A pair is compared in the first band that it shares, so once in all.
    """

    def grouped(rows: pa.Table, edges: list):
        """The links of whole groups that begin at `edges`; shingles and band keys of all of them are made at once."""
        row, h = _distinct(*_grams(rows.column("body")), rows.num_rows)
        keys = band_keys(signatures(h, row.astype(np.int32), rows.num_rows))
        span = np.searchsorted(row, np.arange(rows.num_rows + 1))
        size = np.diff(span)
        key, member, component = (rows.column(x).to_numpy() for x in ("key", "member", "component"))
        same = keys == key[:, None]
        for i, j in zip(edges, [*edges[1:], rows.num_rows], strict=True):
            band = int(np.flatnonzero(same[i])[0])
            met = keys[i:j, :band]
            pairs = _few_pairs(component[i:j], size[i:j], met, threshold)
            if pairs is not None:
                if len(pairs):
                    yield _forest_of_pairs(pairs, member[i:j], component[i:j], [h[span[k] : span[k + 1]] for k in range(i, j)], threshold)
                continue
            at = slice(span[i], span[j])
            yield spanning_forest(member[i:j], component[i:j], row[at] - i, h[at], threshold, lambda k, later: ~(met[later] == met[k]).any(1))  # noqa: B023

    def run(batches):
        keep_memory()
        held: list = []

        def whole(table: pa.Table, edges: list, most: int = 2 * BLOCK):
            """The groups of a table, in runs of `most` bytes or of one group; the last edge is the end of the last group."""
            end = np.cumsum(pc.binary_length(table.column("body")).to_numpy().astype(np.int64))
            at, i = [0, *(int(end[x - 1]) for x in edges[1:])], 0
            while i < len(edges) - 1:
                j = i + 1
                while j < len(edges) - 1 and at[j + 1] - at[i] <= most:
                    j += 1
                links = [x for x in grouped(table.slice(edges[i], edges[j] - edges[i]), [x - edges[i] for x in edges[i:j]]) if x.num_rows]
                if links:
                    yield from pa.concat_tables(links).combine_chunks().to_batches()
                i = j

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            group = np.stack([table.column(x).to_numpy().astype(np.int64) for x in ("key", "p", "q")])
            edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1).tolist()]
            yield from whole(table, edges)
            held = table.slice(edges[-1]).to_batches()  # the last group may go on
        if held and sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held)
            yield from whole(table, [0, table.num_rows])

    return run


def _across(rows: DataFrame, threshold: float, parts: int, block: int, most: int = 1 << 20) -> DataFrame:
    """Links (a, b) of lines of one bucket (key, member, component, body) that join its components, by exact Jaccard.

    A bucket of more than `block` members or `most` bytes is dealt into parts, and each pair of parts is one group, so no
    group grows with the bucket. A group compares each member with the later ones that are not joined to it yet and
    gives a spanning forest: fewer links than members.
    """
    sized = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))
    cut = rows.join(sized, "key").withColumn("parts", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / most)).cast("int"))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    # Two members of one part meet in its groups with the other parts.
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("parts = 1 or part <> other")
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "member", "component", "body")
    return dealt.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(_forests(threshold), "a long, b long").distinct()


def removed_lines(documents: DataFrame, threshold: float = 0.8, block: int = 2048, hot: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(rows, drops): documents with (d, row), a row's id (the greatest long where null) and hash, and for each with removals the sorted line numbers."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "lines")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.withColumn("d", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = scratch.write(line_table(rows), "lines", **_PLAIN)
    # Where the bytes are not asked for, the keys say what is new, and the bytes are not read.
    fresh, keyed = lines.where("body is not null"), lines.where(f"{_KEYS[0]} is not null")
    # A hot bucket is dealt into parts, with keys of their own.
    few = {r.key: r.salts for r in hot_keys(keyed, hot).where("salts > 1").collect()}  # 1,000 at most
    for p, keys in enumerate(_KEYS):
        own = keyed.select("h1", keys).mapInArrow(_deal(few, RANGES * parts), "range int, keys binary, lines binary")
        own = own.repartitionById(parts, F.col("range")).sortWithinPartitions("range")
        own = own.mapInArrow(lambda batches: _meet(_sorted(batches)), "key long, h1 long, rank long, centers array<long>")
        own = scratch.write(own, f"buckets-{p}")
        buckets = buckets.unionByName(own) if p else own
    pairs = buckets.where("rank > 0").select("h1", F.explode("centers").alias("c")).select(F.least("c", "h1").alias("a"), F.greatest("c", "h1").alias("b"))
    # Lines that no center of their bucket is.
    others = buckets.where(F.col("rank") >= STARS).select("key", F.col("h1").alias("member"))
    if few:  # the least lines of a hot bucket's parts meet, and its parts are one bucket again
        own = keyed.select("h1", *_KEYS).mapInArrow(_of_hot(few), "key long, part long, h1 long")
        tops = own.groupBy("key", "part").agg(F.min("h1").alias("h1"))
        split = tops.groupBy("key").agg(F.min("h1").alias("a"))
        pairs = pairs.unionByName(tops.join(split, "key").where("h1 <> a").select("a", F.col("h1").alias("b")))
        others = others.join(tops.select(F.col("part").alias("key")).distinct(), "key", "left_anti").unionByName(own.select("key", F.col("h1").alias("member")).distinct())
    pairs = scratch.write(pairs.distinct(), "pairs")
    involved = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
    # Lines are named by 64 bits while they are compared: of those that share a name the least by its other 64 bits stands for it, and only it takes a component.
    bodies = fresh.select("h1", "h2", "body").join(involved, "h1", "left_semi").groupBy("h1").agg(F.min(F.struct("h2", "body")).alias("b")).select("h1", "b.h2", "b.body")
    bodies = scratch.write(bodies.mapInArrow(_with_size, "h1 long, h2 long, body binary, n int"), "bodies")
    links = scratch.write(_verified(pairs, bodies, threshold, parts), "links")
    comps = connected_components(links)
    # Where those of a bucket are of several components, they all meet one another, in blocks.
    rest = open_rows(others, comps, scratch, "open")
    if rest.limit(1).count():
        more = _across(rest.join(bodies.select(F.col("h1").alias("member"), "body"), "member"), threshold, parts, block)
        links = links.unionByName(scratch.write(more, "links-2"))
        comps = connected_components(links)
    comps = scratch.write(comps.join(bodies.select(F.col("h1").alias("id"), "h2"), "id").select(F.col("id").alias("h1"), "h2", "component"), "components")
    for table in (*(f"buckets-{p}" for p in range(PASSES)), "pairs", "bodies", "open"):
        scratch.drop(table)
    # Equal lines are told apart by both hashes, fuzzy ones by component; only lines with a partner go on.
    exact = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).join(comps, ["h1", "h2"], "left").where("n > 1 or component is not null")
    named = exact.select("h1", "h2", F.coalesce("component", "h1").alias("g1"), F.when(F.col("component").isNull(), F.col("h2")).alias("g2"))
    met = scratch.write(lines.select("d", "row", "line", "h1", "h2").join(named.hint("shuffle_hash"), ["h1", "h2"]).select("g1", F.coalesce("g2", F.lit(0)).alias("g2"), "d", "row", "line"), "met")
    # The first of each group stays.
    place = F.struct("d", "row", "line")
    keep = met.groupBy("g1", "g2").agg(F.min(place).alias("keep"))
    gone = met.join(keep.hint("shuffle_hash"), ["g1", "g2"]).where(place > F.col("keep"))
    drops = scratch.write(gone.groupBy("d", "row").agg(F.sort_array(F.collect_set("line")).alias("drop")), "drops")
    scratch.drop("lines")
    scratch.drop("met")
    return rows, drops


def dedup_lines(documents: DataFrame, threshold: float = 0.8, counted: bool = True) -> DataFrame:
    """The documents' columns, text without its removed lines, and where counted, n_lines and n_removed (lines with a word).

    Removed lines go with their newline. Every row stays, also where nothing of its text is left.
    """
    slim = documents.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("own"))
    rows, drops = removed_lines(slim, threshold)
    # The removals are small beside the texts: they are hashed, so that texts need no sort.
    joined = rows.join(drops.hint("shuffle_hash"), ["d", "row"], "left")
    done = joined.select("own", F.size("drop").alias("n"), _cut(counted)(F.col("text").cast("binary"), "drop").alias("cut"))
    counts = [F.col("cut.n_lines"), F.coalesce("n", F.lit(0)).cast("long").alias("n_removed")]
    return done.select(*[F.col("cut.text").cast("string").alias(c) if c == "text" else F.col(f"own.`{c}`") for c in documents.columns], *counts * counted)


def _cut(counted: bool):
    """(text without the lines whose numbers are given, lines with a word in the whole text, where counted) of UTF-8 bytes."""

    def of(text: pa.Array, drop: pa.Array) -> pa.Array:
        kept, n = [], []
        for t, gone in zip(text.to_pylist(), drop.to_pylist(), strict=True):
            parts = (t or b"").split(b"\n") if counted or gone else []
            n.append(sum(map(bool, map(_strip, parts))))
            if gone:
                for i in reversed(gone):
                    del parts[i]
                t = b"\n".join(parts)
            kept.append(t)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(n, pa.int64())], ["text", "n_lines"])

    return F.arrow_udf(of, "text binary, n_lines long")
