"""The corpus operators against brute force, on fixtures with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import chat, decontam, langid, lines, linear, minhash, mixing, quality, queries, rules, suffix, text, toxicity
from orrery.llm.weaklabel import LabelModel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row int"


def docs(spark, texts, start=0):
    rnd = random.Random(5)
    rows = [(i + start, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s1", None]), len(t or ""), 0.5, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdéfgh") for _ in range(rnd.randint(1, 7))) for _ in range(200)]
    out = [None, "", "   ", "one", "one two\nthree", "one", "#$% &&"]
    long = [" ".join(rnd.choice(vocab) for _ in range(80)) for _ in range(6)]
    for _ in range(n):
        t = rnd.choice(long).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 3, 30])):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        cut = rnd.randrange(len(t))
        out.append(" ".join(t[:cut]) + rnd.choice([" ", "\n"]) + " ".join(t[cut:]) + rnd.choice(["", "\n" + long[0]]))
    return out


def folded(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def classes(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_hashes_do_not_depend_on_place():
    import pyarrow as pa

    a, b = (next(iter(text.chunks(pa.array(x))))[2] for x in (["ab cd"], ["zz", "q ab cd"]))
    ha, hb = (text.Hashes(c.codes(text.SPACED)) for c in (a, b))
    assert ha.of(np.array([3]), np.array([5])) == hb.of(np.array([8]), np.array([10]))


def test_dart_signatures_estimate_weighted_jaccard():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rnd.uniform(0.2, 3, 400), rnd.uniform(0.2, 3, 400)
    sig = minhash.dart_signatures(np.concatenate([a, a]), np.repeat([0, 1], 400), 2, k=4096, weight=np.concatenate([wa, wb]))
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_near_duplicates_match_brute_force(spark):
    ts = corpus()
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, ts)).collect()}
    sets = []
    for t in ts:
        w = folded(t)
        sets.append(frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    links = [(i, j) for j in range(len(ts)) for i in range(j) if ts[i] is not None and (ts[i] == ts[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    want = classes(links, range(len(ts)))
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["is_kept"]} == set(want.values())


def test_matching_statistics_match_brute_force():
    rnd = random.Random(1)
    for _ in range(20):
        strs = [bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 8))]
        pats = [bytes(rnd.choice(b"abc\x00") for _ in range(rnd.randint(0, 20))) for _ in range(5)]
        for p, ms in zip(pats, suffix.RunLengthIndex(strs).matching_statistics(pats), strict=True):
            assert list(ms) == [max(k for k in range(len(p) - i + 1) if any(p[i : i + k] in s for s in strs)) for i in range(len(p))]


def removed(ts):
    first, out = {}, []
    for d, t in enumerate(ts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if first.setdefault(b[i : i + 100], (d, i)) != (d, i):
                gone[i : i + 100] = b"\x01" * 100
        out.append(gone)
    return out


def bytes_gone(got, ts):
    for d, (t, gone) in enumerate(zip(ts, removed(ts), strict=True)):
        b = (t or "").encode()
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["kept_sha256"]) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[d]["n_spans"] == len(re.findall(b"\x01+", bytes(gone)))


@pytest.mark.parametrize("pack,hot", [(1 << 19, 20_000), (600, 5)])
def test_repeats_match_brute_force(spark, pack, hot):
    """With small packs, and with groups of more than five segments dealt to several tasks."""
    ts = corpus(40) + ["ab" * 150, "x" + "ab" * 150]
    bytes_gone({r["doc_id"]: r for r in suffix.remove_repeats(docs(spark, ts), pack, hot).collect()}, ts)


def anchor_batches(rows, size):
    import pyarrow as pa

    at = suffix._packed(*(np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6)))
    at = np.where([r[7] for r in rows], ~at, at)  # known to go
    cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    whole = pa.RecordBatch.from_arrays([*cols, pa.array(at)], names=["h", "seg", "doc", "row", "at"])
    return [whole.slice(i, size) for i in range(0, len(rows), size)]


def test_groups_go_on_past_batch_borders():
    rnd = random.Random(7)
    rows = {(h, rnd.randrange(3), d, d, 5, 5, 95, False) for h in range(60) for d in range(rnd.choice([1, 2, 2, 3, 5]))}
    rows = sorted([*rows, *rnd.sample(sorted(rows), 20), (99, 0, 1, 1, 1, 1, 99, True)])  # some rows twice, one that is known to go
    given = lambda size: sorted(tuple(r.values()) for b in suffix._grouped(anchor_batches(rows, size)) for r in b.to_pylist())
    want = [(99, 1, 1, 1, 1, 99, 0)]
    for h in range(60):
        own = sorted({r for r in rows if r[0] == h})
        firsts = {seg: min(r for r in own if r[1] == seg) for seg in {r[1] for r in own}}
        for r in own:
            if r != firsts[r[1]]:
                want.append((h, *r[2:7], 0))
            elif len(firsts) > 1:
                want.append((h, *r[2:7], 1))
    assert all(given(size) == sorted(want) for size in (1, 2, 3, 7, len(rows)))


def test_repeated_rows_keep_what_one_row_keeps(spark):
    rnd = random.Random(8)
    body = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(3)]
    ts = [(1, body[0]), (2, body[1] + body[0][:150]), (3, body[2]), (None, body[2] + body[1])]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    out = lambda d: sorted((repr(r["doc_id"]), r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.remove_repeats(d).collect())
    want = out(make(ts))
    assert [r[1] for r in want] == [0, 150, 0, 600]
    assert out(make([t for t in ts for _ in range(2)])) == sorted(want * 2)


def resolved(segs, pack, salts=1):
    """Removed bytes by row of segments (h, doc, row, start, bytes); groups dealt to several tasks where salts > 1."""
    import pyarrow as pa

    base = {h: min(s[1:4] for s in segs if s[0] == h) for h, *_ in segs}
    dealt = [(h, salt, d, r, a, (d, r, a) == base[h] and salts > 1, b) for h, d, r, a, b in segs for salt in (range(salts) if salts > 1 and (d, r, a) == base[h] else [(d + a) % salts if salts > 1 else -1])]
    dealt.sort(key=lambda x: (x[0], x[1], not x[5], *x[2:5]))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["h", "salt", "doc", "row", "start", "base", "bytes"]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*dealt, strict=True), types, strict=True)], names=names)
    out = [r for b in suffix._resolve(pack)([batch.slice(i, 3) for i in range(0, len(dealt), 3)]) for r in b.to_pylist()]
    left = sorted((r for r in out if r["w"] is not None), key=lambda r: (r["w"], r["doc"], r["row"], r["start"]))
    assert bool(left) == (salts > 1)
    runs = [r for r in out if r["w"] is None]
    if left:
        runs += [r for b in suffix._later([pa.RecordBatch.from_pylist(left[i : i + 5]) for i in range(0, len(left), 5)]) for r in b.to_pylist()]
    got = {}
    for r in runs:
        got.setdefault(r["row"], set()).update(range(r["start"], r["end"]))
    return got


def windows_gone(segs):
    """Bytes that go by row, each window judged against all earlier ones of its group."""
    want, first = {}, {}
    for h, d, row, start, b in sorted(segs, key=lambda x: x[:4]):
        for k in range(len(b) - 99):
            first.setdefault((h, b[k : k + 100]), []).append((d, row, start + k))
    for h, d, row, start, b in segs:
        for k in range(len(b) - 99):
            if min(first[h, b[k : k + 100]]) < (d, row, start + k):
                want.setdefault(row, set()).update(range(start + k, start + k + 100))
    return want


@pytest.mark.parametrize("pack", [100, 900, 1 << 19])
@pytest.mark.parametrize("salts", [1, 3])
def test_segments_of_variants_match_brute_force(pack, salts):
    rnd = random.Random(4)
    base = bytes(rnd.choice(b"abcdef") for _ in range(176))
    segs = []
    for i in range(60):
        s = bytearray(base)
        s[rnd.choice([5, 60, 170])] = rnd.choice(b"uvwxyz")
        segs.append((7 + i % 2, i, 100 + i, 10, bytes(s)))
    # The first occurrence of group 9 has bytes that other groups have at later places: it stays, and its copy goes.
    segs += [(9, -5, 500, 0, base[20:130]), (9, 70, 501, 3, base[20:131]), (11, 71, 502, 0, base[130::-1]), (11, 72, 503, 0, base[120::-1])]
    got, want = resolved(segs, pack, salts), windows_gone(segs)
    assert not {500, 502} & set(got) and set(range(3, 113)) <= got[501] and want[501] <= got[501]
    # A pack may show an earlier equal window of another group too.
    most = windows_gone([(0, *x[1:]) for x in segs])
    assert all(want.get(r, set()) <= got.get(r, set()) <= most.get(r, set()) for r in {x[2] for x in segs})


@pytest.mark.parametrize("pack", [350, 900, 1 << 19])
@pytest.mark.parametrize("salts", [1, 2])
def test_a_place_of_two_segments_does_not_remove_itself(pack, salts):
    """Periodic texts: one hash at many places, whose segments overlap."""
    rnd = random.Random(5)
    unit = bytes(rnd.choice(b"abcdef") for _ in range(30))
    texts = [unit * 9, b"x" + unit * 8 + b"yz", b"q" * 40 + unit * 7]
    segs = [(7, d, 70 + d, max(0, p - 76), t[max(0, p - 76) : p + 100]) for d, t in enumerate(texts) for p in range(len(t) - 23) if t[p : p + 24] == unit[:24]]
    assert resolved(segs, pack, salts) == windows_gone(segs)


def test_lines_match_brute_force(spark):
    ts = corpus(30)
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, ts)).collect()}
    all_lines = [(d, k, s) for d, t in enumerate(ts) if t is not None for k, s in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", s)]
    grams = [frozenset((b := s.encode())[i : i + 8] for i in range(max(1, len(s.encode()) - 7))) for _, _, s in all_lines]
    links = [(i, j) for j in range(len(grams)) for i in range(j) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    keep = classes(links, range(len(grams)))
    gone = {all_lines[i][:2] for i, c in keep.items() if i != c}
    for d, t in enumerate(ts):
        want = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (d, k) not in gone)
        assert got[d]["text"] == want and got[d]["n_removed"] == sum(x[0] == d for x in gone)


def test_lines_of_mixed_buckets_lose_no_link(spark):
    """Variants of one line, about as alike as the threshold: buckets hold several components."""
    rnd = random.Random(11)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    ts = []
    for _ in range(120):
        t = list(base)
        for _ in range(rnd.choice([1, 2, 2, 3])):
            at = rnd.randrange(150)
            t[at : at + 4] = [rnd.choice("xyz") for _ in range(4)]
        ts.append("".join(t))
    grams = [frozenset(t[i : i + 8] for i in range(len(t) - 7)) for t in ts]
    links = [(i, j) for j in range(len(ts)) for i in range(j) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    want = classes(links, range(len(ts)))
    for block, hot in ((2048, 50_000), (16, 50_000), (16, 10)):
        _, drops = lines.removed_lines(docs(spark, ts).select("doc_id", "text"), block=block, hot=hot)
        assert drops.count() == sum(i != c for i, c in want.items())
    assert 1 < len(set(want.values())) < 100


def test_near_duplicates_of_mixed_buckets_lose_no_link(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    ts = []
    for _ in range(80):
        t = list(base)
        for _ in range(rnd.choice([2, 3, 4, 5])):
            t[rnd.randrange(200)] = f"v{rnd.randrange(10**6)}"
        ts.append(" ".join(t))
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)], strict=False)) for t in ts]
    links = [(i, j) for j in range(len(ts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = classes(links, range(len(ts)))
    for block in (2048, 16):
        got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs(spark, ts), block=block).collect()}
        assert got == want


def test_members_of_a_bucket_need_no_like_signatures(spark):
    """Sets right at the threshold link whatever their signatures look like, in blocks of any size."""
    rnd = random.Random(13)
    base = [rnd.randrange(2**62) for _ in range(200)]
    sets = [base[: 180 - 20 * (i % 2)] + [rnd.randrange(2**62) for _ in range(20 * (i % 2))] for i in range(2)]  # 160 of 200: 0.8
    sets += [base[:159] + [rnd.randrange(2**62) for _ in range(21)], [rnd.randrange(2**62) for _ in range(180)]]
    want = {(i, j) for j in range(4) for i in range(j) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    assert want == {(0, 1)}
    table = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "member long, shingles array<long>")
    rows = table.selectExpr("7L as key", "member", "member as component")
    for block, most in ((2048, 1 << 19), (1, 1 << 19), (2048, 200)):
        got = minhash._across(rows, table, 0.8, block, most).collect()
        assert {(r["a"], r["b"]) for r in got} == want


def test_decontamination_matches_brute_force(spark):
    ts = corpus(30)
    bench = [(1, " ".join(folded(ts[9])[:30]).upper()), (2, "one two"), (3, None), (4, "!!"), (5, " ".join(folded(ts[12])[10:40]))]
    items = spark.createDataFrame(bench, "item_id long, text string")
    for blocks in (8_000_000, 40):
        got = {r["doc_id"]: r for r in decontam.decontaminate(docs(spark, ts), items, block_chars=blocks).collect()}
        for d, t in enumerate(ts):
            w, hit, own = folded(t), set(), set()
            for item, body in bench:
                b = folded(body)
                k = min(13, len(b))
                for i in range(len(b) - k + 1 if b else 0):
                    for j in range(len(w) - k + 1):
                        if w[j : j + k] == b[i : i + k]:
                            hit |= set(range(j, j + k))
                            own.add(str(item))
            r = got[d]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest())
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))


def test_decontamination_of_equal_shards_and_items_without_id(spark):
    big = "one two three " * 160_000  # fills a chunk, so its two rows are shards of equal bytes
    d = spark.createDataFrame([(1, big), (1, big), (2, "red green blue and more")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(5, "two three one"), (None, "red green"), (None, "blue")], "item_id long, text string")
    for blocks in (8_000_000, 8):
        got = sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.decontaminate(d, items, block_chars=blocks).collect())
        assert got == [(1, 480_000, 479_997, 1, True)] * 2 + [(2, 5, 3, 0, True)]


def test_proximity():
    s = decontam.Shard(np.array([1, 2, 3]), np.array([1, 1, 1]), np.array([0, 2, 3], np.int32).tobytes())
    phrase, size = np.array([[1, 2, 3]]), np.array([3])
    assert not len(s.find(phrase, size)[0]) and list(s.find(phrase, size, slop=1)[1]) == [0]


def test_measures_match_brute_force(spark):
    ts = corpus(40) + ["a b c d e " * 3 + "x", "é\x00ü b * <\nq\nq\n\nq"]
    for r in rules.measured(docs(spark, ts)).collect():
        t = ts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        rep = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)}
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(rep))


def test_exact_bound_and_cutoffs():
    assert abs(rules.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9 and rules.upper_bound(5, 5, 0.1) == 1
    few = {("en", 0): {0: 20}}
    assert rules.choose_cutoffs(few, 0.1, 0.05)["en"][0] is None
    many = {("en", 0): {0: 5000, 15: 2}}
    assert rules.choose_cutoffs(many, 0.1, 0.05)["en"][0] == 0.01


def test_label_model_discounts_copies():
    rnd = np.random.default_rng(2)
    y = rnd.random(4000) < 0.4
    flip = lambda p: np.where(rnd.random(4000) < p, ~y, y).astype(np.int64)
    bad = flip(0.4)
    votes = np.stack([flip(0.1), flip(0.15), flip(0.2), bad, bad, bad], 1)
    model = LabelModel()
    post = model.fit(votes, np.where(rnd.random(4000) < 0.1, y, -1).astype(int))
    assert ((post > 0.5) == y).mean() > 0.9 and (model.parent[3:] >= 0).sum() >= 2


def test_label_model_matches_brute_force_em():
    """Independent voters: posteriors against a plain sum over the two classes, parameters from weighted counts."""
    rnd = np.random.default_rng(3)
    y = rnd.random(500) < 0.3
    votes = np.stack([np.where(rnd.random(500) < 0.3, 2, np.where(rnd.random(500) < p, ~y, y)).astype(np.int64) for p in (0.1, 0.2, 0.3)], 1)
    labels = np.where(rnd.random(500) < 0.4, y, -1).astype(int)
    model = LabelModel(least_information=9.0, rounds=200)
    got = model.fit(votes, labels)
    assert (model.parent == -1).all()
    known = labels >= 0
    prior = (np.sum(labels == 1) + 1) / (known.sum() + 2)
    agree = ((votes == 1).sum(1) - (votes == 0).sum(1)) / 3
    post = np.where(known, np.where(labels == 1, 0.98, 0.02), np.clip(prior + 0.4 * agree, 0.02, 0.98))

    def said(w):
        table = []
        for j in range(3):
            n = np.array([w[votes[:, j] == k].sum() for k in range(3)])
            single = (n + 0.5) / (n + 0.5).sum()
            table.append((n + single) / (n + single).sum())
        return table

    for _ in range(200):
        p, one, zero = (post.sum() + 1) / 502, said(post), said(1 - post)
        alone = []
        for row in votes:
            a, b = p, 1 - p
            for j, v in enumerate(row):
                if v != 2:
                    a, b = a * one[j][v], b * zero[j][v]
            alone.append(a / (a + b))
        alone = np.array(alone)
        new = np.where(known, post, alone)
        done, post = np.abs(new - post).max() < 1e-4, new
        if done:
            break
    assert np.abs(got - alone).max() < 0.01


def test_linear_finds_the_feature():
    rnd = np.random.default_rng(0)
    y = rnd.random(800) < 0.2
    rows = [np.unique(np.append(rnd.integers(10, 5000, 30), 7 if v else 8)) for v in y]
    w, b = linear.fit(rows, y.astype(float))
    assert ((np.array([w[r].sum() + b for r in rows]) > 0) == y).all()


def labelled(spark, n=300):
    rnd = random.Random(9)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rnd.choice(vocab) for _ in range(30)] + (["you", "idiot", "zorkling"] if bad else [])
        rows.append(" ".join(words))
        labels.append((i, int(not bad), int(bad)))
    return docs(spark, rows), spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int"), rows


def test_toxicity_on_held_out_rows(spark):
    d, lab, rows = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, lab).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in got if got[i]["held_out"]]) > 0.95


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [" ".join(rnd.choice(vocab) for _ in range(60)) if i % 3 else rnd.choice(["SPAM !!! $$$ BUY NOW !!! ", "aa bb aa bb\n"]) * 20 for i in range(300)]
    d = docs(spark, rows).unionByName(docs(spark, [None, "", rows[0], rows[0]], 300))
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (5, None), (7, 1), (7, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = quality.quality(d.withColumn("label", F.lit(3)), lab).collect()
    assert len(got) == 304 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by.items())
    assert np.mean([by[i]["predicted"] == int(i % 3 > 0) for i in range(300) if by[i]["held_out"]]) > 0.95
    assert by[302]["score"] == by[303]["score"] == by[0]["score"] and by[300]["score"] == by[301]["score"]
    again = {r["doc_id"]: r["score"] for r in quality.quality(d.repartition(5), lab).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in by.items())
    assert quality.quality(d.limit(0), lab).count() == 0 and quality.quality(d, lab.limit(0)).count() == 304


def test_pipeline_stages_on_odd_columns(spark, tmp_path):
    """Clashing columns, null ids, repeated rows and an empty table; exact copies and a benchmark passage go, lines are cut."""
    rnd = random.Random(6)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage, a, b = say(40), say(90), say(90)
    ts = [(1, a), (2, a), (None, b), (None, None), (5, passage + " end"), (5, passage + " end"), (6, ""), (7, say(30) + "\n" + b[:200]), (8, say(30) + "\n" + b[:200])]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4) for i, t in ts], "doc_id long, text string, lang string, source string, n_chars long, n_lines int, row int, _row int, own int")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    for docs_ in (d, d.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs_, str(tmp_path)).columns == d.columns
    near = corpus_pipeline.drop_near_duplicates(spark, d, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in near) == sorted((i or -1, t or "") for i, t in {*ts} - {(2, a)})
    clean = corpus_pipeline.drop_contaminated(spark, d, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in clean) == sorted((i or -1, t or "") for i, t in ts if i != 5)
    cut = {r["doc_id"]: r for r in corpus_pipeline.drop_repeated_lines(spark, d.where("doc_id > 6"), str(tmp_path)).collect()}
    assert cut[7]["text"] == ts[7][1] and cut[8]["text"] == ts[8][1].split("\n")[0] and cut[8]["n_chars"] == len(cut[8]["text"])


def test_words_and_long_words_of_language_id():
    assert langid.words_of("½ ² Ⅷ a\u0301b é_x 12 \u0301") == ["a\u0301b", "é", "x"]
    seg = langid.Segmenter(["a", "b", "ab", "▁", "▁a"])
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0, 0.01])[:, None]

    def brute(word):  # log of the sum over segmentations, by recursion from the end
        prob = dict(zip(seg_pieces, p[:, 0], strict=False))
        total = [0.0] * len(word) + [1.0]
        for i in range(len(word) - 1, -1, -1):
            total[i] = sum(prob[q] * total[i + len(q)] for q in seg_pieces if word.startswith(q, i))
        return np.log(total[0])

    seg_pieces = ["a", "b", "ab", "▁", "▁a"]
    words = ["ab" * 10, "ab" * 40, "ba" * 30]
    assert np.allclose(seg.scores(words, p)[:, 0], [brute("▁" + w) for w in words])
    assert np.isfinite(seg.scores(["ab" * 3000], p)).all()


def test_language(spark):
    rnd = random.Random(1)
    words = {"en": ["the", "and", "thing", "this", "that"], "fr": ["le", "eau", "que", "être", "pour"]}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(12)), x) for i in range(60) for x in [["en", "fr"][i % 2]]] + [(90, None, "en"), (91, "12 !", "fr"), (92, "the" * 60, None)]
    got = {r["doc_id"]: r for r in langid.language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:60]) and got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[92]["lang_pred"] == "en"


def test_forward_sums_all_segmentations():
    seg = langid.Segmenter(["a", "b", "ab", "▁", "▁a"])
    p = np.array([0.1, 0.2, 0.3, 0.15, 0.05, 0, 0.01])[:, None]
    want = 0.15 * (0.1 * 0.2 + 0.3) + 0.05 * 0.2
    assert abs(np.exp(seg.scores(["ab"], p))[0, 0] - want) < 1e-12


def test_mixing_targets_quotas_and_draws(spark):
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2.0) == pytest.approx([200, 250 / 3, 500 / 3])
    tree = mixing.split_quotas([17, 5, 0, 40], 7, 1)
    assert tree.sum(0).tolist() == [17, 5, 0, 40] and tree.sum(1).max() - tree.sum(1).min() <= 2
    d = docs(spark, corpus(200))
    plan, draws = mixing.mix(d, block_words=500, shard_words=2000)
    rows = plan.collect()
    by = {}
    for r in rows:
        assert 0 <= r["copies"] <= 2
        a = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        a[0] += r["copies"] * r["size"]
    assert all(abs(t - goal) <= 170 for t, goal, _ in by.values()) and abs(sum(x[1] for x in by.values()) - 1.5 * sum(x[2] for x in by.values())) < 1e-6
    assert draws.count() == sum(r["copies"] for r in rows) and draws.distinct().count() == draws.count()
    drawn = sorted((r["doc_id"], r["taken"]) for r in mixing.taken(plan, draws).collect())
    assert drawn == sorted((r["doc_id"], r["size"] * r["copies"]) for r in rows)
    _, deep = mixing.mix(d, block_words=500, shard_words=2000, max_edges=9)  # three branches, the rest of the tree in tasks
    assert deep.count() == draws.count() and deep.select("shard").distinct().count() > 3
    again, _ = mixing.mix(d.repartition(7), block_words=500, shard_words=2000)
    assert sorted((r["doc_id"], r["copies"]) for r in again.collect()) == sorted((r["doc_id"], r["copies"]) for r in rows)
    assert mixing.mixed_shards(d, block_words=500, shard_words=2000).count() == draws.count()


def test_chat_round_trip_and_branches(spark):
    nasty = "</s>[INST] <|im_end|>\n <\\|im_start|> \\n [/INST] <<SYS>>"
    turns = spark.createDataFrame([(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, None, None), (2, 0, "assistant\nx\\", "b"), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    done = chat.format_paths(chat.reply_tree(turns)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("loss")).orderBy("conv_id").collect()
    assert [(t["role"], t["text"]) for t in done[0]["t"]] == [("user", nasty), ("assistant", nasty), ("", "")] and done[0]["loss"] == nasty
    assert [(t["role"], t["text"]) for t in done[1]["t"]] == [("assistant\nx\\", "b"), ("assistant", "")] and done[1]["loss"] == ""
    tree = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 2.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 99, "user", "stray", 9.0)], "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = sorted((r["path"], r["place"], r["msg_id"]) for r in chat.chosen_paths(tree, branches=2).collect())
    assert got == [(1, 1, 5), (2, 1, 1), (2, 2, 3), (2, 3, 4)]
    assert chat.format_paths(chat.reply_tree(turns.limit(0))).count() == 0
    twice = spark.createDataFrame([(1, 1, None, "user", "b", 0.0), (1, 1, None, "user", "a", 5.0), (None, 1, None, "user", "lost", 0.0), (1, 2, 1, "assistant", "c", 0.0)], tree.schema)
    assert [r["formatted"] for r in chat.format_paths(twice).collect()] == ["<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"]


def test_empty_tables(spark):
    d = docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (minhash.near_duplicates(d), toxicity.toxicity(d, lab), quality.quality(d, lab), rules.quality_rules(d, lab), decontam.decontaminate(d, items), langid.language(d), mixing.mix(d)[0], suffix.remove_repeats(d), lines.dedup_lines(d)):
        assert out.count() == 0


def test_null_and_odd_rows(spark):
    d = spark.createDataFrame([(None, None, None, None, None), (None, "", None, "s", 0), (3, "z" * 5000, "en", "s", 1), (3, "z" * 5000, "en", "s", 1), (4, "\x00\n\x85 x", "en", None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "z" * 5000), (None, "x")], "item_id long, text string")
    for out in (minhash.near_duplicates(d), toxicity.toxicity(d, lab), quality.quality(d, lab), rules.quality_rules(d, lab), decontam.decontaminate(d, items), langid.language(d), mixing.mix(d)[0], suffix.remove_repeats(d), lines.dedup_lines(d)):
        assert out.count() == 5


def test_every_operator_is_registered():
    assert sorted(int(k.split("_")[0][2:]) for k in queries.QUERIES) == list(range(1, 11))
