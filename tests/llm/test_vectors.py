"""Operators 11 and 13 against brute force: nulls, odd components, ties, repeated rows, several lengths, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import codes, negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, n int, code string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.5, 1, "x", 2) for i, v, l in rows], SCHEMA)


def vectors(n=420, dim=16, seed=4, odd=True):
    rnd = random.Random(seed)
    centers = [[rnd.gauss(0, 0.2) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centers[0 if rnd.random() < 0.4 else rnd.randrange(6)]
        rows.append((i, [x + rnd.gauss(0, 0.1) for x in c], rnd.choice([0, 0, 0, 1, 2, 3])))
    if odd:
        same = rows[5][1]
        rows += [(n + k, list(same), k % 2) for k in range(20)]  # ties
        rows += [rows[50], rows[50], rows[7]]  # repeated rows, one an anchor
        rows += [(900, None, 1), (901, [0.1] * (dim - 1) + [None], 1), (902, [math.nan] * dim, 1), (903, [math.inf] * dim, 0), (950, rows[3][1], None)]
        rows += [(1000 + k, [rnd.gauss(0, 0.3) for _ in range(8)], k % 3) for k in range(60)] + [(1100, [], 0), (1101, [], 0), (1102, [], 1)]
    return rows


def whole(rows, scale):
    return [(i, [math.floor(scale * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def brute_negatives(rows):
    own = [r for r in whole(rows, 256) if r[0] is not None and r[2] is not None]
    out = []
    for a in own:
        if a[0] % 50:
            continue
        score = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2]) for b in own if b[0] != a[0] and len(b[1]) == len(a[1]))
        for s, i, _ in [b for b in score if b[2] == a[2]][:5]:
            inside = [b for b in score if b[2] != a[2] and -50 * s <= -100 * b[0] <= -95 * s][:3]
            out += [(a[0], i, k + 1, b[1], -s, -b[0]) for k, b in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_negatives_are_those_of_a_full_comparison(spark, small, monkeypatch):
    rows = vectors() + [(None, [0.1] * 16, 1)]
    df = table(spark, rows).repartition(5)
    sizes = {"group_bytes": 4000, "group_anchors": 3, "cells": 4} if small else {}
    if small:
        monkeypatch.setattr(negatives, "BLOCK", 2)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, **sizes).collect())
    assert got == brute_negatives(rows) and len(got) > 20


def test_negatives_of_odd_tables(spark):
    assert negatives.hard_negatives(table(spark, [])).collect() == []
    assert negatives.hard_negatives(table(spark, [(1, [0.1, 0.2], 0)])).collect() == []
    assert negatives.hard_negatives(table(spark, [(0, None, 0), (50, [0.5], None)])).collect() == []


def test_bounds_hold_and_cut():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(0, 32, (3000, 24))).astype(np.int32)
    a = x[:40]
    code, low, high = negatives.quantise(x)
    below, above = negatives.bounds(code, low, high, a)
    score = x.astype(np.int64) @ a.T.astype(np.int64)
    assert (below <= score).all() and (score <= above).all()
    fifth = np.partition(score, len(x) - 5, axis=0)[len(x) - 5]
    assert (above >= fifth[None]).mean() < 0.02  # few vectors need an exact score
    large = negatives.bounds(code, low * 40000, high * 40000, a)
    assert (large[0] <= score * 40000).all() and (score * 40000 <= large[1]).all()


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    own = sorted(whole(rows, scale), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(own[0][1])
    fit = [r for r in own if len(r[1]) == dim]
    cut = [(dim * p // parts, dim * (p + 1) // parts) for p in range(parts)]
    books = [[list(r[1][a:b]) for r in fit[:entries]] for a, b in cut]

    def assign(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cut):
            groups = {}
            for r in fit:
                groups.setdefault(assign(r[1][a:b], books[p])[1], []).append(r[1][a:b])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    out = []
    for r in own:
        best = [assign(r[1][a:b], books[p]) for p, (a, b) in enumerate(cut)] if len(r[1]) == dim else None
        out.append((r[0], r[2], "".join(f"{k:02x}" for _, k in best) if best else None, sum(d for d, _ in best) if best else None))
    total = {}
    for r in out:
        total[r[1]] = total.get(r[1], 0) + (r[3] or 0)
    return sorted((repr((*r, total[r[1]])) for r in out)), books


@pytest.mark.parametrize("case", ["odd", "uneven", "few"])
def test_codes_are_those_of_plain_lloyd(spark, case):
    rows = vectors() + [(960, vectors()[9][1], None), (None, [0.2] * 16, 2)] if case == "odd" else vectors(150, 11, odd=False) if case == "uneven" else vectors(5, 16, odd=False)
    want, books = brute_codes(rows)
    got, found = codes.compress(table(spark, rows).repartition(4))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert [b.tolist() for b in found] == books


def test_codes_of_odd_tables(spark):
    got, books = codes.compress(table(spark, [(1, None, 0), (2, [math.nan], 0)]))
    assert got.collect() == [] and got.columns == ["vec_id", "label", "code", "error", "label_error"]
    got, books = codes.compress(table(spark, [(1, [], 0), (2, [], 0), (3, [0.5], None)]))
    assert sorted((r.vec_id, r.code, r.error) for r in got.collect()) == [(1, "00" * 8, 0), (2, "00" * 8, 0), (3, None, None)]


def test_a_tree_assigns_as_a_full_comparison_does():
    rng = np.random.default_rng(8)
    for n, d, k in [(1, 3, 2), (7, 2, 5), (9, 4, 16), (1000, 4, 16), (1000, 1, 16), (513, 8, 3)]:
        x = rng.integers(-9, 9, (n, d)).astype(np.int32)  # many ties
        z = np.concatenate((x[:k], rng.integers(-9, 9, (max(0, k - n), d)))).astype(np.int64)
        z[-1] = z[0]
        far = ((x[:, None].astype(np.int64) - z[None]) ** 2).sum(2)
        sums, counts, code = codes.Tree.build(x).assign(z)
        assert (code == far.argmin(1)).all() and (counts == np.bincount(code, minlength=k)).all()
        assert all((sums[e] == x[code == e].sum(0)).all() for e in range(k))


def test_whole_subtrees_are_assigned():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 2, (512, 4)) for c in (0, 1000)]).astype(np.int32)
    tree = codes.Tree.build(x)
    tree.x = np.zeros_like(x)  # only leaves that are still open read the parts
    assert tree.assign(np.array([[0] * 4, [1000] * 4]))[1].tolist() == [512, 512]
