"""A sparse logistic scorer over hashed features, fitted on a bounded sample on the driver."""

from __future__ import annotations

import numpy as np

BITS = 18
DIM = 1 << BITS


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[np.ndarray], soft: np.ndarray, keep: int = 4096, least_rows: int = 3, l1: float = 0.1, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights (DIM) and bias of a logistic model with an L1 penalty.

    rows: the distinct features of each sample row; soft: P(y = 1) of each. Features are screened
    by the chi-squared statistic against the soft labels; `keep` at most stay. No rows, or rows of
    one class only, give the prior.
    """
    weights = np.zeros(DIM, np.float32)
    n = len(rows)
    prior = float((soft.sum() + 0.5) / (n + 1)) if n else 0.5
    bias = float(np.log(prior / (1 - prior)))
    if not any(len(r) for r in rows):
        return weights, bias
    # Row by row: the driver never holds more of the sample at once than its rows and the features that stay.
    seen, good = np.zeros(DIM), np.zeros(DIM)
    for r, p in zip(rows, soft.tolist(), strict=True):
        seen[r] += 1
        good[r] += p
    expect = seen * prior
    chi = (good - expect) ** 2 / (seen * prior * (1 - prior) * (1 - seen / (n + 1)) + 1e-9)
    chi[(seen < min(least_rows, max(1, n // 50))) | (seen >= n)] = 0
    chosen = np.argsort(-chi, kind="stable")[:keep]
    chosen = np.sort(chosen[chi[chosen] > 6.6])
    if not len(chosen):
        return weights, bias
    slot = np.full(DIM, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    col = [c[c >= 0] for c in (slot[r] for r in rows)]
    row, col = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in col]), np.concatenate(col)
    m = len(chosen)
    v = np.ones(m) / np.sqrt(m)
    for _ in range(12):
        v = np.bincount(col, weights=np.bincount(row, weights=v[col], minlength=n)[row], minlength=m)
        top = np.linalg.norm(v)
        v /= top + 1e-12
    step = 1 / (0.25 * (top + n) + 1e-9)
    w = x = np.zeros(m)
    b = y = bias
    t = 1.0
    for _ in range(rounds):
        err = sigmoid(np.bincount(row, weights=x[col], minlength=n) + y) - soft
        new = x - step * np.bincount(col, weights=err[row], minlength=m)
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb = y - step * err.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    weights[chosen] = w
    return weights, float(b)


def score(text: np.ndarray, feature: np.ndarray, n: int, weights: np.ndarray, bias: float) -> np.ndarray:
    """P(y = 1) of n texts; (text, feature) pairs may repeat, a feature counts once for a text."""
    on = weights[feature] != 0
    key = np.unique(text[on].astype(np.int64) * DIM + feature[on])
    z = np.bincount(key >> BITS, weights=weights[key & (DIM - 1)], minlength=n)
    return sigmoid(z + bias)


def distinct_by_text(text: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    key = np.unique(text.astype(np.int64) * DIM + feature)
    return np.split((key & (DIM - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(1, n)))
