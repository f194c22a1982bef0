"""Removal of long repeated substrings with run-length indexes (operator 8).

A byte goes if a `LENGTH`-byte string covering it also starts earlier in the corpus.

1. Texts equal to an earlier one go whole, by digest.
2. Every LENGTH-byte window has an anchor: its least-hashed K-byte string. Equal windows have equal
   anchors, so all copies of a window meet in the group of one anchor hash. An anchor's segment is
   what its windows can reach: LENGTH - K bytes to either side, cut at the text's ends. Anchors whose hash occurs once are done with.
3. Of equal segments of a group the first stays and the others are removed whole. Equal segments of one Arrow batch
   are told apart before the shuffle, so a passage of every document is one row a batch in its group.
4. Groups of several different segments get them as bytes, one for each. The first segment of each group is its base. The bases of many
   groups (about half a MB) become one index: their suffixes are sorted, the Burrows-Wheeler transform is run-compressed, and suffix positions are
   sampled at the run ends. The other segments stream their matching statistics over it, and a window whose longest match
   reaches LENGTH is marked if the earliest place of that string in the index, known from the order of the suffixes, is earlier; so are a base's own windows.
5. Windows that no base has, new text beside a repeated passage, are compared exactly among the other segments of their group, by their hashes.

Every mark has an earlier equal string, and the earliest of equal windows is never marked. A base comes first in its group, so a window that
it has goes by the index alone; step 5 sees no window of a base.
Only (hash, place) pairs and differing segments are shuffled. The segments of a hot group are dealt to several tasks, each with the base;
the windows left there meet in one more shuffle. Memory: one batch of rows, one pack of segments.

Null text: empty. Rows equal in id and text get equal results. Texts under LENGTH bytes stay whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import PLAIN, Chunk, Hashes, U, chunks, keep_memory, mix
from orrery.store import Scratch

LENGTH, K = 100, 24
PACK = 1 << 19


class RunLengthIndex:
    """A run-compressed BWT of many strings, with suffix samples at run ends and thresholds.

    strings: list of byte strings. Suffixes end at their string's end; equal ones are ordered by position.
    """

    def __init__(self, strings: list[bytes]):
        lens = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(lens + 1) - lens - 1
        text = np.zeros(int((lens + 1).sum()), np.uint16)
        inside = np.ones(len(text), bool)
        inside[self.start + lens] = False
        text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
        self.text, n = text, len(text)
        self.left = np.repeat(self.start + lens, lens + 1) - np.arange(n)  # symbols before the end mark
        self.depths, self.ranks = [4], []
        pack = np.zeros(n, U)
        for k in range(4):
            sym = np.zeros(n, U)
            sym[: n - k] = text[k:]
            sym[self.left < k] = 0
            pack = (pack << U(9)) | sym
        rank, open_ = self._ranked(pack, np.arange(n), 4, None)
        self.ranks.append(rank)
        while len(open_):
            d = self.depths[-1]
            second = rank[np.minimum(open_ + d, n - 1)].astype(U)
            rank, open_ = self._ranked((rank[open_].astype(U) << U(n.bit_length())) | second, open_, 2 * d, rank)
            self.depths.append(2 * d)
            self.ranks.append(rank)
        self.order = np.empty(n, np.int64)  # suffix positions in order
        self.order[rank] = np.arange(n)
        bwt = np.where(self.order > 0, text[self.order - 1], 0)
        self.run_start = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1]))) if n else np.zeros(0, np.int64)
        self.run_symbol = bwt[self.run_start]
        self.run_end = np.append(self.run_start[1:], n) - 1 if n else self.run_start
        self.sample_first, self.sample_last = self.order[self.run_start], self.order[self.run_end]

    def _ranked(self, key: np.ndarray, at: np.ndarray, depth: int, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of all suffixes by `depth` symbols, the least place of their group; and the suffixes that share theirs.

        key: what orders the suffixes `at`, whose groups are the only ones left open; a suffix that ends within depth stands alone, by position.
        """
        bits = int(len(self.text)).bit_length()
        if int(key.max(initial=0)).bit_length() + bits <= 64:  # the place goes along in the number
            key = np.sort((key << U(bits)) | at.astype(U))
            at, key = (key & U((1 << bits) - 1)).astype(np.int64), key >> U(bits)
        else:
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (self.left[at[1:]] < depth)
        # Places of a group: for the first sort from 0, later from the rank that its members had in common.
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        if rank is None:
            own, out = first, np.empty(len(at), np.int32)
        else:
            out = rank.copy()
            old = rank[at]
            edge = np.ones(len(at), bool)
            edge[1:] = old[1:] != old[:-1]
            base = np.flatnonzero(edge)
            own = old[first] + first - np.repeat(base, np.diff(np.append(base, len(at))))[first]
        out[at] = np.repeat(own, size)
        return out, at[np.repeat(size > 1, size)]

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b, from the ranks."""
        out = np.zeros(len(a), np.int64)
        n = len(self.text)
        for d, rank in zip(reversed(self.depths), reversed(self.ranks), strict=True):
            i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((rank[i] == rank[j]) & (i != j), d, 0)
        for _ in range(3):
            i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (self.text[i] == self.text[j]) & (self.text[i] != 0)
        return out

    def _prepare(self) -> None:
        """LF by runs, and the threshold of each run: above it a mismatch goes to the run before."""
        n = len(self.text)
        size = self.run_end - self.run_start + 1
        by = np.argsort(self.run_symbol, kind="stable")
        self.to = np.empty(len(by), np.int64)  # row that the first row of a run maps to
        self.to[by] = np.cumsum(size[by]) - size[by]
        self.by, self.by_symbol, self.by_start = by, self.run_symbol[by], self.run_start[by]
        self.symbol_from = np.searchsorted(self.by_symbol, np.arange(259))
        lcp = self.lcp = np.zeros(n, np.int64)
        lcp[1:] = self.shared(self.order[1:], self.order[:-1])
        self.threshold = np.zeros(len(by), np.int64)  # in the order of `by`, against the run before of the same symbol
        same = np.flatnonzero(self.by_symbol[1:] == self.by_symbol[:-1]) + 1
        if len(same):
            low, high = self.run_end[by[same - 1]] + 1, self.run_start[by[same]] + 1
            key = np.append(lcp * (n + 1) + np.arange(n), np.iinfo(np.int64).max)
            self.threshold[same] = np.minimum.reduceat(key, np.stack([low, high], 1).ravel())[::2] % (n + 1)

    def earliest(self, place: np.ndarray, length: int) -> np.ndarray:
        """For each position the least `place` (one for each position) at which its next `length` symbols start: equal ones stand together in suffix order."""
        if not hasattr(self, "to"):
            self._prepare()
        out = place.copy()
        if len(self.order):
            run = np.flatnonzero(np.concatenate(([True], self.lcp[1:] < length)))
            out[self.order] = np.repeat(np.minimum.reduceat(place[self.order], run), np.diff(np.append(run, len(place))))
        return out

    def pointers(self, patterns: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """For each place of each pattern (rows of bytes + 1, filled up with 0) a text position where its longest match begins, or -1.

        All patterns go one symbol to the left at a time. On a mismatch the row moves to the nearest end of a
        run of the symbol, up or down by the threshold, where the suffix sample is known.
        """
        if not hasattr(self, "to"):
            self._prepare()
        m, width = patterns.shape
        by_length = np.argsort(-lens, kind="stable")
        grid, longest = np.ascontiguousarray(patterns[by_length].T.astype(np.int64)), lens[by_length]
        pointer = np.full((width, m), -1, np.int32)
        row, place = np.zeros(m, np.int64), np.full(m, int(self.order[0]) if len(self.order) else 0)
        n, last = len(self.text), max(0, len(self.by) - 1)
        key = self.by_symbol.astype(np.int64) * (n + 1) + self.by_start
        # For each pattern only its own length counts: the first `active` ones are at work.
        for t in range(width - 1, -1, -1):
            active = int(np.searchsorted(-longest, -t, "left"))
            sym, r, at = grid[t, :active], row[:active], place[:active]
            lo, hi = self.symbol_from[sym], self.symbol_from[sym + 1]
            k = np.searchsorted(key, sym * (n + 1) + r, "right") - 1  # last run of the symbol that begins at or before the row
            before = k >= lo
            run_up, next_ = self.by[np.maximum(k, 0)], np.minimum(k + 1, last)
            inside = before & (self.run_end[run_up] >= r)
            after = k + 1 < hi
            down = ~inside & after & (~before | (r >= self.threshold[next_]))
            up = ~inside & before & ~down
            run = np.where(down, self.by[next_], run_up)
            at = np.where(inside, at, np.where(down, self.sample_first[run], self.sample_last[run]))
            r = np.where(inside, r, np.where(down, self.run_start[run], self.run_end[run]))
            none = ~(inside | up | down)
            row[:active] = np.where(none, 0, self.to[run] + (r - self.run_start[run]))
            place[:active] = np.where(none, self.order[0], at - 1)
            pointer[t, :active] = np.where(none, -1, at - 1)
        out = np.empty((m, width), np.int32)
        out[by_length] = pointer.T
        return out

    def matching_statistics(self, strings: list[bytes]) -> list[np.ndarray]:
        """For each place of each string the length of the longest match that starts there."""
        grid, lens = _grid(strings)
        out, text = [], self.text.tolist()
        for p, s in zip(self.pointers(grid, lens), strings, strict=True):
            ms, k = np.zeros(len(s), np.int64), 0
            for t in range(len(s)):
                k = max(0, k - 1) if p[t] >= 0 else 0
                while p[t] >= 0 and t + k < len(s) and p[t] + k < len(text) and text[p[t] + k] == s[t + k] + 1:
                    k += 1
                ms[t] = k
            out.append(ms)
        return out


def _grid(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of bytes + 1, filled up with 0, and their lengths."""
    lens = np.array([len(s) for s in strings], np.int64)
    grid = np.zeros((len(strings), int(lens.max(initial=0))), np.uint16)
    grid[np.arange(grid.shape[1]) < lens[:, None]] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    return grid, lens


def _anchors(h: np.ndarray, c: Chunk) -> np.ndarray:
    """Places of the leftmost least K-byte string of every LENGTH-byte window of the texts of a chunk; h: hash of the string at each place.

    Order is by the upper bits of the hash, then by place, both in one number.
    """
    bits = U(int(len(h)).bit_length())
    least = (h >> bits << bits) | np.arange(len(h), dtype=U)
    width, span = 1, LENGTH - K + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    long = np.flatnonzero(c.size >= LENGTH)
    edge = np.zeros(len(least) + 1, np.int8)
    edge[c.start[long]] = 1
    edge[c.start[long] + c.size[long] - LENGTH + 1] = -1
    at = (least[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)] & U((1 << int(bits)) - 1)).astype(np.int64)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


_ANCHOR = "h long, seg long, doc long, row long, at long"


def _packed(pos: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An anchor's place and reach in one number, in order of place."""
    return (pos << 16) | (left << 8) | right


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """Anchors of all texts. Of equal segments of one batch the first stands for all; the later ones are known to go: their `at` is inverted and their group random."""

    def run(batches):
        keep_memory()
        for batch in batches:
            doc, row = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            found = []
            for i, _, c in chunks(batch.column("text")):
                code = c.codes(PLAIN)
                if len(code) < LENGTH:
                    continue
                whole = Hashes(code)
                at = np.arange(len(code) - K + 1)
                h = whole.of(at, at + K)
                p = _anchors(h, c)
                t = c.text_of(p)
                s, e = c.start[t], c.start[t] + c.size[t]
                low, high = np.maximum(s, p - (LENGTH - K)), np.minimum(e, p + LENGTH)
                seg = mix(whole.of(low, high) + (p - low).astype(U))
                found.append((h[p].view(np.int64), seg.view(np.int64), doc[i + t], row[i + t], _packed(p - s, p - low, high - p)))
            if not found:
                continue
            h, seg, d, r, at = (np.concatenate(x) for x in zip(*found, strict=True))
            one = (mix(h.view(U)) ^ seg.view(U)).view(np.int64)
            order = np.argsort(one, kind="stable")
            same = np.concatenate(([False], one[order][1:] == one[order][:-1]))
            sub = order[same | np.append(same[1:], False)]  # anchors whose segment comes again in the batch
            sub = sub[np.lexsort((at[sub], r[sub], d[sub], one[sub]))]
            again = np.concatenate(([False], one[sub][1:] == one[sub][:-1]))[: len(sub)]
            head = sub[np.maximum.accumulate(np.where(again, 0, np.arange(len(sub))))] if len(sub) else sub
            # A repeated row's anchor is the same place as its twin's.
            later = again & ((d[sub] != d[head]) | (r[sub] != r[head]) | (at[sub] != at[head]))
            known, keep = np.zeros(len(h), bool), np.ones(len(h), bool)
            known[sub[later]] = True
            keep[sub[again & ~later]] = False
            h, at = np.where(known, mix((r ^ at).view(U)).view(np.int64), h), np.where(known, ~at, at)
            yield pa.record_batch([pa.array(x[keep]) for x in (h, seg, d, r, at)], names=["h", "seg", "doc", "row", "at"])

    return texts.mapInArrow(run, _ANCHOR)


def _grouped(batches):
    """Anchors sorted by (h, seg, doc, row, at), streamed: what the group says of each without bytes.

    kind 0: a later copy of an equal segment of its group; 1: a first segment of a group of different ones.
    Rows equal in id and text have equal anchors, of which one counts. Only the last first segment of a group of
    one kind is held.
    """
    group, seg0, place0, several, held = None, None, None, False, None
    for batch in batches:
        sure = batch.column("at").to_numpy() < 0
        if sure.any():
            yield _kinds(batch.filter(pa.array(sure)), 0)
            batch = batch.filter(pa.array(~sure))
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("h", "seg", "doc", "row", "at")])
        step = np.ones(cols.shape, bool)
        step[:, 1:] = cols[:, 1:] != cols[:, :-1]
        if group is not None:
            step[:, 0] = cols[:, 0] != np.array([group, seg0, *place0])
        fresh = step.any(0)  # anchors of a repeated row stand next to each other; they are one place
        new_h, new_seg = step[0], step[0] | step[1]
        g = np.cumsum(new_h)  # 0: the group of the batch before goes on
        kinds = np.bincount(g, weights=new_seg, minlength=g[-1] + 1)
        carried = group is not None and not new_h[0]
        kinds[0] += (2 if several else 1) if carried else 0
        yield _kinds(batch.filter(pa.array(fresh & ~new_seg)), 0)
        if held is not None and carried and kinds[0] > 1:
            yield _kinds(held, 1)
            held = None
        elif held is not None and not carried:
            held = None
        lead = new_seg & (kinds[g] > 1)
        yield _kinds(batch.filter(pa.array(lead)), 1)
        last = int(g[-1])
        several = bool(kinds[last] > 1)
        if not several and not (carried and last == 0):
            at = int(np.flatnonzero(new_seg)[-1])
            held = batch.slice(at, 1)
        elif several:
            held = None
        group, seg0, place0 = int(cols[0, -1]), int(cols[1, -1]), tuple(int(x) for x in cols[2:, -1])


def _kinds(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    at = batch.column("at").to_numpy()
    at = np.where(at < 0, ~at, at)
    reach = [(at >> 16).astype(np.int32), ((at >> 8) & 255).astype(np.int32), (at & 255).astype(np.int32)]
    return pa.record_batch([*(batch.column(k) for k in ("h", "doc", "row")), *map(pa.array, reach), pa.array(np.full(len(at), kind, np.int32))], names=["h", "doc", "row", "pos", "left", "right", "kind"])


_SEGMENT = "h long, salt int, doc long, row long, start int, base boolean, bytes binary"


def _segments(batches):
    """The bytes of the wanted anchors of each text; a base of a hot group once for each salt."""
    for batch in batches:
        wanted = batch.column("wanted")
        count = pc.list_value_length(wanted).to_numpy()
        w = pc.list_flatten(wanted)
        h, salt, base, pos, left, right = (w.field(k).to_numpy(zero_copy_only=False) for k in ("h", "salt", "base", "pos", "left", "right"))
        text = np.repeat(np.arange(batch.num_rows), count)
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        low, high = pos - left, pos + right
        body = [raw[t][a:b] for t, a, b in zip(text.tolist(), low.tolist(), high.tolist(), strict=True)]
        yield pa.record_batch([pa.array(h), pa.array(salt), batch.column("doc").take(pa.array(text)), batch.column("row").take(pa.array(text)), pa.array(low.astype(np.int32)), pa.array(base), pa.array(body, pa.binary())], names=["h", "salt", "doc", "row", "start", "base", "bytes"])


_RUN = "doc long, row long, start int, end int, w long"


def _judge(table: pa.Table):
    """Whole groups (h, salt), each with its base first: removed runs, and the windows of split groups that are left, as (w, doc, row, start)."""
    cols = {k: table.column(k).to_numpy(zero_copy_only=False) for k in ("h", "salt", "doc", "row", "start", "base")}
    body = table.column("bytes").to_pylist()
    n = len(body)
    head = np.ones(n, bool)
    head[1:] = (cols["h"][1:] != cols["h"][:-1]) | (cols["salt"][1:] != cols["salt"][:-1])
    g = np.cumsum(head) - 1
    _, text = np.unique(np.stack([cols["doc"], cols["row"]]), axis=1, return_inverse=True)
    text = text.ravel().astype(np.int64)
    lens = np.array([len(b) for b in body], np.int64)
    index = RunLengthIndex([body[i] for i in np.flatnonzero(head)])
    base_of = np.flatnonzero(head)
    # All segments as one array of codes, with a gap after each; hashes of windows come from its prefix sums.
    codes = np.zeros(int((lens + 1).sum()), np.uint16)
    begin = np.cumsum(lens + 1) - lens - 1
    inside = np.ones(len(codes), bool)
    inside[begin + lens] = False
    codes[inside] = np.frombuffer(b"".join(body), np.uint8).astype(np.uint16) + 1
    hashes, own = Hashes(codes), Hashes(index.text)
    count = np.maximum(lens - LENGTH + 1, 0)
    seg = np.repeat(np.arange(n), count)
    t = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    value = hashes.of(begin[seg] + t, begin[seg] + t + LENGTH)
    place = (text[seg] << 32) + cols["start"][seg] + t
    gone = np.zeros(len(seg), bool)
    # The earliest place of each window of the bases; those that also start earlier go.
    at = np.repeat(np.arange(len(base_of)), lens[base_of] + 1)
    offset = np.arange(len(index.text)) - index.start[at]
    there = (text[base_of[at]] << 32) + cols["start"][base_of[at]] + offset
    least = index.earliest(there, LENGTH)
    twice = np.flatnonzero((least < there) & (index.left >= LENGTH))
    gone[(np.cumsum(count) - count)[base_of[at[twice]]] + offset[twice]] = True
    stream = np.flatnonzero(~head)
    if len(stream):
        grid, own_lens = _grid([body[i] for i in stream])
        pointer = index.pointers(grid, own_lens)
        line = np.full(n, -1)
        line[stream] = np.arange(len(stream))
        on = np.flatnonzero(line[seg] >= 0)
        p = pointer[line[seg[on]], t[on]].astype(np.int64)
        ok = (p >= 0) & (index.left[np.maximum(p, 0)] >= LENGTH)
        on, p = on[ok], p[ok]
        # Matching statistic of LENGTH or more: the longest match begins with the whole window.
        gone[on] = (least[p] < place[on]) & (own.of(p, p + LENGTH) == value[on])
    # Windows of the other segments that no base has, against one another.
    left = np.flatnonzero(~gone & ~head[seg])
    order = left[np.lexsort((place[left], mix(value[left] ^ mix(g[seg[left]].astype(U)))))]
    first = np.ones(len(order), bool)
    first[1:] = (value[order][1:] != value[order][:-1]) | (g[seg[order]][1:] != g[seg[order]][:-1])
    lead = place[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    gone[order[place[order] > lead]] = True
    # Runs of marked windows.
    edge = np.flatnonzero(gone & np.concatenate(([True], ~gone[:-1] | (seg[1:] != seg[:-1])))) if len(gone) else np.zeros(0, np.int64)
    stop = np.flatnonzero(gone & np.concatenate((~gone[1:] | (seg[1:] != seg[:-1]), [True]))) if len(gone) else edge
    start = cols["start"][seg[edge]] + t[edge]
    end = cols["start"][seg[stop]] + t[stop] + LENGTH
    i = seg[edge]
    yield pa.record_batch([pa.array(cols["doc"][i]), pa.array(cols["row"][i]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.nulls(len(i), pa.int64())], names=["doc", "row", "start", "end", "w"])
    split = order[first & (cols["salt"][seg[order]] >= 0)] if len(order) else order
    if len(split):
        i = seg[split]
        w = mix(value[split] ^ mix(cols["h"][i].view(U))).view(np.int64)
        s = (cols["start"][i] + t[split]).astype(np.int32)
        yield pa.record_batch([pa.array(cols["doc"][i]), pa.array(cols["row"][i]), pa.array(s), pa.array(s + np.int32(LENGTH)), pa.array(w)], names=["doc", "row", "start", "end", "w"])


def _resolve(size: int):
    """Streams segments sorted by (h, salt, base first, doc, row, start) to _judge, in packs of whole groups whose bases are about `size` bytes."""

    def run(batches):
        keep_memory()
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.column("bytes").nbytes for b in held) < 2 * size:
                continue
            table = pa.Table.from_batches(held)
            group = np.stack([table.column(x).to_numpy().astype(np.int64) for x in ("h", "salt")])
            edge = np.flatnonzero((group[:, 1:] != group[:, :-1]).any(0)) + 1
            if len(edge):
                yield from _judge(table.slice(0, int(edge[-1])))
                table = table.slice(int(edge[-1]))
            held = table.to_batches()
        if held and sum(b.num_rows for b in held):
            yield from _judge(pa.Table.from_batches(held))

    return run


def _later(batches):
    """Windows sorted by (w, doc, row, start): all but the first place of each go."""
    w0, first = None, None
    for batch in batches:
        w = batch.column("w").to_numpy()
        if not len(w):
            continue
        place = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in ("doc", "row", "start")])
        new = np.ones(len(w), bool)
        new[1:] = w[1:] != w[:-1]
        new[0] = w0 is None or w[0] != w0
        at = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
        lead = place[:, np.maximum(at, 0)]
        if first is not None:
            lead[:, at < 0] = first[:, None]
        gone = (place != lead).any(0)
        w0, first = w[-1], lead[:, -1]
        yield batch.select(["doc", "row", "start", "end"]).filter(pa.array(gone))


def _cut(batches):
    """Texts and their removed runs to the result's columns."""
    for batch in batches:
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for doc_id, text, whole, runs in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "whole", "runs")), strict=True):
            raw = (text or "").encode()
            spans: list[list[int]] = [[0, len(raw)]] if whole and len(raw) >= LENGTH else []
            for r in sorted((r["start"], r["end"]) for r in runs or []) if not spans else []:
                if spans and r[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], r[1])
                else:
                    spans.append([*r])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            left = b"".join([*kept, raw[at:]])
            for k, v in zip(out, (doc_id, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                out[k].append(v)
        yield pa.record_batch([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=list(out))


def remove_repeats(documents: DataFrame, pack: int = PACK, hot: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for every document.

    pack: bytes of segments that are judged at once; hot: a group of more different segments is dealt to several tasks.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "suffix")
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("row", F.xxhash64("doc_id", "text"))
    digests = rows.select("doc", "row", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), F.octet_length("text").alias("n"))
    firsts = digests.where(f"n >= {LENGTH}").groupBy("digest").agg(F.min(F.struct("doc", "row")).alias("first"))
    copies = digests.where(f"n >= {LENGTH}").join(firsts, "digest").where("struct(doc, row) <> first").select("doc", "row", F.lit(True).alias("whole")).distinct()
    copies = scratch.write(copies, "copies")
    texts = rows.where(F.octet_length("text") >= LENGTH)
    anchors = _anchor_rows(texts.select("doc", "row", "text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = anchors.repartition(parts, "h").sortWithinPartitions("h", "seg", "doc", "row", "at").mapInArrow(_grouped, "h long, doc long, row long, pos int, left int, right int, kind int")
    grouped = scratch.write(grouped, "grouped")
    equal = grouped.where("kind = 0 and left + right >= 100").select("doc", "row", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"))
    # Groups of many different segments: their number and their base.
    different = grouped.where("kind = 1")
    large = different.groupBy("h").count().where(F.col("count") > hot)
    split = scratch.write(different.join(large, "h").groupBy("h").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts"), F.min(F.struct("doc", "row", "pos")).alias("base")), "split")
    dealt = different.join(split, "h", "left")
    is_base = F.coalesce(F.struct("doc", "row", "pos") == F.col("base"), F.lit(False))
    salts = F.when(F.col("salts").isNull(), F.array(F.lit(-1))).when(is_base, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("row", "pos"), F.col("salts")).cast("int")))
    dealt = dealt.select("doc", "row", "h", F.explode(salts).alias("salt"), is_base.alias("base"), "pos", "left", "right")
    wanted = dealt.groupBy("doc", "row").agg(F.collect_list(F.struct("h", "salt", "base", "pos", "left", "right")).alias("wanted"))
    segments = texts.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(_segments, _SEGMENT)
    judged = segments.repartition(parts, "h", "salt").sortWithinPartitions("h", "salt", F.desc("base"), "doc", "row", "start").mapInArrow(_resolve(pack), _RUN)
    resolved = scratch.write(judged, "resolved")
    runs = equal.unionByName(resolved.where("w is null").drop("w"))
    if split.limit(1).count():
        met = resolved.where("w is not null").repartition(parts, "w").sortWithinPartitions("w", "doc", "row", "start").mapInArrow(_later, "doc long, row long, start int, end int")
        runs = runs.unionByName(scratch.write(met, "later"))
    runs = runs.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    out = rows.join(runs, ["doc", "row"], "left").join(copies, ["doc", "row"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole"), F.lit(None)).otherwise(F.col("runs")).alias("runs"))
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
