"""Operators 6 and 7 against enumeration: words of every length, expected uses, the splitting tree behind the draws."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import langid, linear, lines, mixing
from orrery.llm.text import list_array

PIECES = ["a", "b", "ab", "ba", "▁", "▁a", "▁ab"]


def table(seed, langs=2):
    p = np.random.default_rng(seed).random((len(PIECES) + 2, langs))
    p[len(PIECES)] = 0  # no piece
    p[len(PIECES) + 1] = 1e-9  # unknown letters
    return p / p.sum(0)


def segmentations(word):
    """All ways to write ▁word in pieces; letters that are no piece stand alone."""
    if not word:
        yield []
        return
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES:
            for rest in segmentations(word[k:]):
                yield [PIECES.index(word[:k])] + rest
    if word[0] not in PIECES:
        for rest in segmentations(word[1:]):
            yield [len(PIECES) + 1] + rest


@pytest.mark.parametrize("plain", [48, 3])
def test_scores_and_uses_against_enumeration(plain, monkeypatch):
    monkeypatch.setattr(langid, "PLAIN_LENGTH", plain)
    seg, p = langid.Segmenter(PIECES), table(1)
    words = ["a", "ab", "abab", "baab", "z", "azb", "bb"]
    got = seg.scores(words, p)
    for w, row in zip(words, got):
        for lang in range(2):
            assert row[lang] == pytest.approx(math.log(sum(np.prod(p[s, lang]) for s in segmentations("▁" + w))), rel=1e-9)
    counts = np.arange(1.0, len(words) + 1)
    want = np.zeros(len(PIECES) + 2)
    for w, n in zip(words, counts):
        every = [(np.prod(p[s, 0]), s) for s in segmentations("▁" + w)]
        for weight, s in every:
            for i in s:
                want[i] += n * weight / sum(v for v, _ in every)
    assert seg.expected(words, counts, p[:, :1]) == pytest.approx(want, rel=1e-9)


def test_words_of_all_lengths_score_alike():
    seg, p = langid.Segmenter(PIECES), table(2)
    got = seg.scores(["z" * n for n in range(1, 120)], p)
    step = np.log(p[len(PIECES) + 1])
    assert np.allclose(np.diff(got, axis=0), step[None], rtol=1e-9) and np.isfinite(got).all()
    mixed = seg.scores(["ab" * 10 + "z" * n for n in range(10, 60)], p)
    assert np.allclose(np.diff(mixed, axis=0), step[None], rtol=1e-9)


def test_learning_is_expectation_maximisation():
    words = {"x": Counter({"ab": 5, "abab": 3, "ba": 1}), "y": Counter({"ba": 6, "baba": 2})}
    langs, got = langid.learn(words, PIECES, rounds=3)
    for j, lang in enumerate(langs):
        p = np.full(len(PIECES) + 2, 1 / (len(PIECES) + 1))
        for _ in range(3):
            use = np.full(len(PIECES) + 2, 0.05)
            for w, n in words[lang].items():
                every = [(np.prod(p[s]), s) for s in segmentations("▁" + w)]
                for weight, s in every:
                    for i in s:
                        use[i] += n * weight / sum(v for v, _ in every)
            use[len(PIECES)] = 0
            p = use / use.sum()
        assert got[:, j] == pytest.approx(p, rel=1e-6)


def documents(spark, n=160, seed=5, sources=("s0", "s1", None)):
    rnd = random.Random(seed)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(sources), "en") for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, source string, lang string")


def test_the_tree_deals_the_draws(spark):
    d = documents(spark)
    plan, draws = mixing.mix(d, block_words=100, shard_words=400)
    rows = mixing.taken(plan, draws).collect()
    shards = {}
    for r in rows:
        own = [int(x) for x in r.shards.split(",") if x]
        assert len(own) == r.copies == len([x for x in r["at"].split(",") if x]) and r.taken == r.size * r.copies
        for p, s in enumerate(own):
            shards.setdefault((r.sid, s), set()).add((p, r.block))
    # A shard holds no more blocks of a source than the tree gave it, and all shards together hold all that hold a document.
    quotas = Counter()
    for (sid, s), blocks in shards.items():
        quotas[sid] += len(blocks)
    whole = {r.sid: (r.whole, r.blocks) for r in rows}
    started = {}
    for r in rows:
        if r.copies > r.whole:
            started.setdefault(r.sid, set()).add(r.block)
    n = max(s for _, s in shards) + 1
    used = [whole.get(i, (0, 0))[0] * whole.get(i, (0, 0))[1] + len(started.get(i, ())) for i in range(max(whole) + 1)]
    assert all(quotas[i] <= used[i] for i in quotas) and n > 3
    sizes = Counter()
    for (_, s), blocks in shards.items():
        sizes[s] += len(blocks)
    assert max(sizes.values()) <= -(-sum(used) // n) + 1
    again = {(r.doc_id, r.shards) for r in mixing.taken(*mixing.mix(d.repartition(5), block_words=100, shard_words=400)).collect()}
    other = {(r.doc_id, r.shards) for r in mixing.taken(*mixing.mix(d, block_words=100, shard_words=400, seed=11)).collect()}
    assert again == {(r.doc_id, r.shards) for r in rows} and other != again


def test_mixes_of_odd_tables(spark):
    none = documents(spark, 40, sources=(None,))
    plan, draws = mixing.mix(none, block_words=50, shard_words=100)
    rows = mixing.taken(plan, draws).collect()
    assert sum(r.taken for r in rows) == pytest.approx(rows[0].target, abs=41) and rows[0].target == 1.5 * rows[0].source_size
    empty = none.limit(0)
    assert mixing.taken(*mixing.mix(empty)).count() == 0 and mixing.mixed_shards(empty).count() == 0
    wordless = none.withColumn("text", F.lit(None).cast("string"))
    assert {(r.taken, r.target) for r in mixing.taken(*mixing.mix(wordless)).collect()} == {(0, 0.0)}
    ties = spark.createDataFrame([(1, "a b c d", "s", "en")] * 6, "doc_id long, text string, source string, lang string")
    got = mixing.taken(*mixing.mix(ties)).collect()
    assert len({r.taken for r in got}) == 1 and len(got) == 6


def test_lines_that_share_half_a_name_are_not_one(spark, monkeypatch):
    """With a first half of one bit, nearly all lines collide: none may go but for an exact double or a verified likeness."""
    from orrery.llm import lines

    whole = lines.line_table

    def colliding(rows):
        return whole(rows).withColumn("h1", F.when(F.col("body").isNotNull(), F.pmod("h1", F.lit(2)).cast("long")).otherwise(F.col("h1")))

    monkeypatch.setattr(lines, "line_table", colliding)
    texts = ["alpha beta gamma delta epsilon one", "a wholly different line of words here", "zeta eta theta iota kappa lambda mu", "nothing like the other lines at all 7"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:1])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.dedup_lines(d).collect()}
    assert [got[i] for i in range(4)] == texts and got[4] == ""


def test_the_run_length_index_decides_the_removals(monkeypatch):
    import pyarrow as pa

    from orrery.llm import suffix

    rnd = random.Random(2)
    base = bytes(rnd.randrange(97, 123) for _ in range(200))
    base = base[:160] + base[20:140]  # it repeats itself
    other = base[:150] + bytes(rnd.randrange(65, 91) for _ in range(120))
    third = other[120:]  # new text of the second, which no base has
    body = [base, other, third]
    table = pa.table({"h": [1] * 3, "salt": [-1] * 3, "doc": [1, 2, 3], "row": [7] * 3, "start": pa.array([0, 0, 0], pa.int32()), "base": [True, False, False], "bytes": pa.array(body, pa.binary())})

    def removed():
        out = {d: set() for d in (1, 2, 3)}
        for batch in suffix._judge(table):
            for r in batch.to_pylist():
                if r["w"] is None:
                    out[r["doc"]] |= set(range(r["start"], r["end"]))
        return out

    want, seen = {d: set() for d in (1, 2, 3)}, set()
    for d, text in enumerate(body, 1):
        for i in range(len(text) - suffix.LENGTH + 1):
            if text[i : i + suffix.LENGTH] in seen:
                want[d] |= set(range(i, i + suffix.LENGTH))
            seen.add(text[i : i + suffix.LENGTH])
    assert removed() == want and all(want.values())
    monkeypatch.setattr(suffix.RunLengthIndex, "pointers", lambda self, patterns, lens: np.full(patterns.shape, -1, np.int32))
    off = removed()
    assert off[1] == want[1] and off[2] == set() and off[3] == want[3]


def test_fit_holds_little_beside_its_rows():
    rng = np.random.default_rng(0)
    soft = rng.random(3000).round(2)
    # One mark in every second row, and 800 features of no use in each.
    rows = [np.unique(np.append(rng.integers(1000, linear.DIM, 800), 7 if p > 0.5 else 8)).astype(np.int32) for p in soft]
    tracemalloc.start()
    try:
        weights, bias = linear.fit(rows, soft)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert weights[7] > 0 > weights[8] and np.isfinite(bias)
    assert most < 3 * sum(r.nbytes for r in rows)


def bodies(*texts):
    return pa.array([t.encode() for t in texts], pa.binary())


def test_groups_of_lines_share_one_pass_over_their_shingles(monkeypatch):
    calls, grams = [], lines._grams
    monkeypatch.setattr(lines, "_grams", lambda *a: calls.append(1) or grams(*a))
    rng = random.Random(3)
    texts = [rng.choice("xyz") + "".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(200)]
    # Groups of two lines that differ in the last letter, and of two of different text.
    pairs = [(t, t + "!") if i % 2 else (t, t[::-1]) for i, t in enumerate(texts)]
    body = bodies(*[t for p in pairs for t in p])
    row, h = lines._distinct(*grams(body), len(body))
    keys = lines.band_keys(lines.signatures(h, row.astype(np.int32), len(body)))
    key = np.array([next((a for a, b in zip(keys[2 * g], keys[2 * g + 1]) if a == b), keys[2 * g][0]) for g in range(200)])
    order = np.argsort(key, kind="stable")
    at = np.stack([2 * order, 2 * order + 1], 1).ravel()
    at = at[[i % 2 == 0 or g % 2 == 1 for i, g in enumerate(at // 2)]]  # the second of different text is in no bucket with the first
    zero = np.zeros(len(at), np.int32)
    batch = pa.record_batch([pa.array(key[at // 2]), pa.array(zero), pa.array(zero), pa.array(at), pa.array(at), body.take(pa.array(at))], names=["key", "p", "q", "member", "component", "body"])
    for cuts in ([0, len(at)], [0, 7, 100, 101, len(at)]):
        calls.clear()
        out = pa.Table.from_batches(list(lines._forests(0.8)(batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))))
        assert sorted(zip(*out.to_pydict().values(), strict=True)) == [(2 * g, 2 * g + 1) for g in range(1, 200, 2)]
        assert len(calls) <= len(cuts)


def test_links_to_centers_across_batches():
    rng = random.Random(4)
    rows = []
    for a in range(60):
        t = "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 60, 90])))
        rows.append((a, None, t))
        for b in range(rng.choice([1, 2, 30])):
            k = rng.randrange(len(t))
            rows.append((a, 1000 * a + b, t if b % 3 == 0 else t[:k] + "?" + t[k + 1 :] if b % 3 == 1 else t[::-1]))
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for *_, t in rows]
    want, own = [], set()
    for (a, b, _), s in zip(rows, sets, strict=True):
        if b is None:
            own = s
        elif len(s & own) >= 0.8 * len(s | own):
            want.append((a, b))
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), bodies(*[r[2] for r in rows])], names=["a", "b", "n", "body"])
    for size in (1, 7, len(rows)):
        out = pa.Table.from_batches(list(lines._similar(0.8)(batch.slice(i, size) for i in range(0, len(rows), size))))
        assert list(zip(*out.to_pydict().values(), strict=True)) == want


def test_frequent_keys_are_counted_over_all_batches():
    keys = np.concatenate([np.full(3000, 5), np.arange(100, 2_000_000)]).reshape(-1, 1)
    np.random.default_rng(0).shuffle(keys)
    column = list_array(keys.ravel(), np.full(len(keys), 1), pa.int64())
    names = [f"keys{p}" for p in range(lines.PASSES)]
    empty = list_array(np.zeros(0, np.int64), np.zeros(10_000, np.int64), pa.int64())
    found = Counter()
    for out in lines._frequent(pa.record_batch([column.slice(i, 10_000), *[empty.slice(0, len(column.slice(i, 10_000)))] * (lines.PASSES - 1)], names=names) for i in range(0, len(column), 10_000)):
        for k, n in zip(out.column("key").to_pylist(), out.column("n").to_pylist(), strict=True):
            found[k] += n
    assert found == {5: 3000}


def test_band_keys_are_dealt_in_blocks():
    """Every (key, line) comes out once, in order, with all of its key's; a task sends a row a range at most; hot buckets go by part."""
    rng = np.random.default_rng(5)
    line = rng.integers(-(2**63), 2**63, 3000)
    key = rng.integers(-(2**63), 2**63, (3000, 6))
    key[::3, 2], key[:2000, 4] = 77, -5  # a bucket of 1,000 lines and a hot one of 2,000
    want = sorted(zip(key.ravel().tolist(), np.repeat(line, 6).tolist(), strict=True))
    for hot in ({}, {-5: 3}):
        batches = [pa.record_batch([pa.array(line[i : i + 700]), lines._packed(key[i : i + 700].ravel(), np.full(len(line[i : i + 700]), 6))], names=["h1", "keys0"]) for i in range(0, 3000, 700)]
        blocks = [b for x in (batches[:2], batches[2:]) for b in lines._deal(hot, 8)(x)]
        assert sum(b.num_rows for b in blocks) <= 2 * 8
        table = pa.Table.from_batches(blocks).sort_by("range")
        for size in (1, 3, table.num_rows):
            out = list(lines._sorted(table.combine_chunks().to_batches(max_chunksize=size)))
            got = [(k, h) for b in out for k, h in zip(b.column("key").to_pylist(), b.column("h1").to_pylist(), strict=True)]
            assert all(b.column("key").to_pylist() == sorted(b.column("key").to_pylist()) for b in out)
            assert sorted(h for _, h in got) == sorted(h for _, h in want)
            if not hot:
                assert sorted(got) == want and [x for x in got if x[0] == 77] == [x for x in want if x[0] == 77]
                assert not {k for k, _ in got} - {k for k, _ in want}
            else:
                assert [x for x in got if x[0] == 77] == [x for x in want if x[0] == 77] and all(k != -5 for k, _ in got)
                rows = [r for b in lines._of_hot(hot)(batches) for r in b.to_pylist()]
                assert {r["key"] for r in rows} == {-5} and len({r["part"] for r in rows}) == 3 and len(rows) == 2000
                assert {(r["part"], r["h1"]) for r in rows} == set(got) - set(want)


def test_groups_of_few_open_pairs_need_no_index(monkeypatch):
    """Small groups are decided pair by pair, with the components that all pairs would give; nothing is numbered for them."""
    monkeypatch.setattr(lines, "spanning_forest", None)
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh") for _ in range(120))
    texts = [base, base[:60] + "#" + base[61:], base[:119] + "#", base[::-1], base + "!"]
    row, h = lines._distinct(*lines._grams(bodies(*texts)), len(texts))
    sets = [h[row == i] for i in range(len(texts))]
    size, far = np.array([len(x) for x in sets]), np.arange(2 * len(texts)).reshape(-1, 2)
    component = np.array([0, 1, 2, 3, 0])
    like = {(i, j) for j in range(5) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
    pairs = lines._few_pairs(component, size, far, 0.8)
    assert {tuple(p) for p in pairs.tolist()} == {(i, j) for j in range(5) for i in range(j)} - {(0, 4)}
    got = lines._forest_of_pairs(pairs, np.arange(5), component, sets, 0.8).to_pylist()
    assert len(got) == 2 and {(r["a"], r["b"]) for r in got} <= like  # 0, 1, 2 and 4 are alike, 0 and 4 one component before
    far[1, 1] = far[2, 1]
    assert (1, 2) not in {tuple(p) for p in lines._few_pairs(component, size, far, 0.8).tolist()}
    assert lines._few_pairs(np.arange(300), np.ones(300), np.zeros((300, 0)), 0.8) is None
    # Through the operator's own stream, two lines of one bucket:
    keys = lines.band_keys(lines.signatures(h, row.astype(np.int32), len(texts)))
    on = np.array([0, 4])
    band = int(np.flatnonzero(keys[0] == keys[4])[0])
    zero = np.zeros(2, np.int32)
    batch = pa.record_batch([pa.array(keys[on, band]), pa.array(zero), pa.array(zero), pa.array(on), pa.array(on), bodies(texts[0], texts[4])], names=["key", "p", "q", "member", "component", "body"])
    assert [r for x in lines._forests(0.8)(iter([batch])) for r in x.to_pylist()] == [{"a": 0, "b": 4}]


def test_texts_are_cut_by_bytes(spark):
    text = ["a\n \n\tb\n \n", None, "", "\n\n", "x\ny\nx"]
    drop = [[0, 2], None, None, None, [2]]
    got = lines._cut(True).func(pa.array([t if t is None else t.encode() for t in text], pa.binary()), pa.array(drop, pa.list_(pa.int32()))).to_pylist()
    assert [(r["text"], r["n_lines"]) for r in got] == [(" \n \n".encode(), 3), (None, 0), (b"", 0), (b"\n\n", 0), (b"x\ny", 3)]
