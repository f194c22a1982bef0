"""Operator 12: base spans against plain patterns, the recursions against enumeration, what the model adds, odd and very long texts."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(re.findall("[0-9]", m[0]))
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                ok = 14 <= len(digits) <= 19 and sum(v // 10 + v % 10 for v in twice) % 10 == 0
            elif kind == "phone":
                ok = 10 <= len(digits) <= 15
            if ok:
                out.append((m.start(), order, m.end()))
    return sorted(out)


def card(rnd):
    d = "".join(rnd.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def entity(rnd):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    kind = rnd.randrange(4)
    if kind == 0:
        return f"{word()}.{rnd.choice([word(), str(rnd.randint(1, 99))])}@{word()}{rnd.randint(0, 9)}.{word()}.com"
    if kind == 1:
        return ".".join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == 2:
        return card(rnd)
    return f"+{rnd.randint(1, 9)} ({rnd.randint(100, 999)}) {rnd.randint(100, 999)}-{rnd.randint(1000, 9999)}"


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "at", "und", "éa", "ou.", "dot", "in,", "(12)", "n3.5n", "a-b", "\n", "x"]) for _ in range(n))


def corpus(n, seed=1):
    rnd = random.Random(seed)
    return [f"{prose(rnd, 12)} {entity(rnd)} {prose(rnd, 8)} {entity(rnd)}. {prose(rnd, 3)}" for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pii.learn(corpus(150))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(3)
    alphabet = ["1", "22", "255", "256", ".", ".", "@", "a", "b-", "+", " ", "(", ")", "-", "é", "_", "\n", "0001", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "+1 (509) 555-6973"]
    for _ in range(6000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 14)))
        assert pii.base(text) == plain(text), text


def test_long_runs_take_one_pass():
    for text in ["a" * 3_000_000, "1" * 3_000_000, "a@" * 500_000, "+" * 1_000_000, "1." * 500_000, "9 " * 700_000]:
        pii.base(text)


def spans_of(tokens):
    return list(zip(tokens.kind, tokens.text))


def test_features_of_segments_are_those_of_their_text():
    t = pii.Tokens()
    pii.add_stretches(t, 0, "a 4111-1111 1111.1111 b@c.de 10.2.300.4 (+1) 5é")
    columns = pii.Columns(t)
    allowed, values = columns.features(np.arange(columns.n), pii.LONGEST)
    for i in range(columns.n):
        for n in range(1, min(pii.LONGEST, columns.n - i) + 1):
            s = "".join(t.text[i : i + n])
            digits = re.sub("[^0-9]", "", s)
            assert values[2][i, n - 1] == min(7, len(re.findall("[0-9]+", s)))
            assert values[3][i, n - 1] // 3 == min(2, s.count("@")) and values[4][i, n - 1] // 3 == min(4, s.count("."))
            cardlike = 14 <= len(digits) <= 19 and "@" not in s and not re.search("[^\\W\\d_]", s)
            assert values[5][i, n - 1] == (1 + pii.luhn(digits) if cardlike else 0)
            assert values[13][i, n - 1] == min(6, len(re.findall("[A-Za-z]+|[^\\W\\d_A-Za-z]+", s)))
            assert allowed[i, n - 1] == (bool(digits or "@" in s) and s[0] != " " and s[-1] != " ")


def segmentations(n, longest):
    """All ways to cut n tokens into outside tokens and entities of up to `longest` tokens."""
    if n == 0:
        yield []
        return
    for rest in segmentations(n - 1, longest):
        yield rest + [(n - 1, 1, 0)]
    for k in range(1, min(longest, n) + 1):
        for rest in segmentations(n - k, longest):
            for y in range(1, 5):
                yield rest + [(n - k, k, y)]


@pytest.mark.parametrize("seed", [0, 1])
def test_recursions_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    crf = pii.SemiCrf(3)
    crf.weights = [rng.normal(0, 1, w.shape) for w in crf.weights]
    crf.follows = rng.normal(0, 1, crf.follows.shape)
    t = pii.Tokens()
    pii.add_stretches(t, 0, "b@1 2\n+1a", 3)
    columns = pii.Columns(t)
    best_spans = []
    for k in range(len(t.owner)):
        a, b = t.cut[k], t.cut[k + 1]
        s = crf.scores(*columns.features(np.arange(a, b), 3))
        every = []
        for seg in segmentations(b - a, 3):
            score, label = 0.0, 0
            for i, n, y in seg:
                score += crf.follows[label, y] + (s[i, n - 1, y - 1] if y else 0)
                label = y
            every.append((score, seg))
        z = math.log(sum(math.exp(v) for v, _ in every))
        alpha, _ = crf.forward(s[None])
        beta = crf.backward(s[None], np.array([b - a]))
        assert np.isclose(pii._logsum(alpha[:, b - a], 1)[0], z) and np.isclose(beta[0, 0, 0], z)
        best = max(every, key=lambda v: v[0])
        best_spans += [(0, t.start[a + i], y - 1, t.end[a + i + n - 1]) for i, n, y in best[1] if y]
    assert sorted(crf.decode(t)) == sorted(best_spans)


def test_likelihood_rises_to_the_known_segmentation(model):
    held = corpus(60, seed=9)
    tokens = pii.Tokens()
    for k, text in enumerate(held):
        pii.add_stretches(tokens, k, text)
    known = {(k, *s) for k, text in enumerate(held) for s in pii.base(text)}
    found = set(model.decode(tokens))
    assert len(found & known) >= 0.97 * len(known) and len(found - known) <= 0.1 * len(known)


def test_long_stretches_are_decoded_piece_by_piece(model, monkeypatch):
    rnd = random.Random(5)
    text = " ".join(entity(rnd) if rnd.random() < 0.3 else "und 12" for _ in range(200))
    tokens = pii.Tokens()
    pii.add_stretches(tokens, 0, text)
    whole = model.decode(tokens)
    monkeypatch.setattr(pii, "AT_ONCE", 50)
    assert model.decode(tokens) == whole and len(whole) > 40


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("und call 1 (509) 555-6973 or so", "phone", "1 (509) 555-6973"),
        ("the host 10[.]2[.]3[.]44 is up", "ip", "10[.]2[.]3[.]44"),
        ("the card 4111.1111.1111.1111 was", "card", "4111.1111.1111.1111"),
        ("ou write abc.12 at mail3 dot example dot com in, the", "email", "abc.12 at mail3 dot example dot com"),
    ],
)
def test_the_model_adds_other_forms(spark, model, text, kind, part):
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, mask=True).first()
    assert [(s.kind, text[s.start : s.end], s.base) for s in got.spans] == [(kind, part, False)]
    assert got.masked == text.replace(part, f"<{kind}>")


def test_the_model_leaves_others_alone(spark, model):
    texts = ["on 12.05 at noon a dot in 3.5", "version 1.2.3 and 300.1.2.3", "card 4111.1111.1111.1112", "look @ 12", "at the dot"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.spans for r in pii.find(df, model).collect()] == [[]] * len(texts)


def test_odd_rows(spark):
    texts = [None, "", "no data", "a.b@c.de", "a.b@c.de", "4111 1111 1111 1111 é +1 (509) 555-6973"] + corpus(40)
    rows = [(None if i == 3 else min(i, 30), t, 0.5, "k", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans double, kind string, start int").repartition(3)
    got = pii.find(df).collect()
    assert len(got) == len(texts)
    want = sorted((r[0] is None, r[0] or 0, plain(r[1] or "")) for r in rows)
    kinds = {k: i for i, k in enumerate(pii.KINDS)}
    assert sorted((r.doc_id is None, r.doc_id or 0, sorted((s.start, kinds[s.kind], s.end) for s in r.spans if s.base)) for r in got) == want
    assert pii.find(df.limit(0)).collect() == [] and pii.find(df.where("text = 'no data'")).first().spans == []


def test_query_digests(spark, tmp_path):
    texts = corpus(30) + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op12_personal_data(spark, str(tmp_path)).collect():
        known = plain(texts[r.doc_id] or "")
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in known)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in known) for i in range(4)]
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_a_text_of_many_megabytes(spark, model):
    text = ("word " * 200 + "\n") * 6000 + "x " * 500_000 + "a.b@c.de" + " 12" * 20_000
    got = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (text.index("a.b@c.de"), text.index("a.b@c.de") + 8) in {(s.start, s.end) for s in got.spans}
