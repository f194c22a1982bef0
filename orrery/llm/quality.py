"""Quality classifier (operator 3): EM over overlapping heuristic labellers, hashed linear scorer.

Labellers judge symbol density, capitals, exclamation marks, repeated lines, lack of distinct words,
length, word length and digits; each says good, bad or nothing. The label model finds their
accuracies and overlaps by expectation-maximisation; the posteriors train the scorer, whose
features are hashed words, word endings and thermometer-coded measures of the whole text.

Nulls count as empty texts; a null doc_id is scored and never taught; repeated rows are each scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.learning import fold, sample, scored, train
from orrery.llm.linear import BITS
from orrery.llm.rules import measures
from orrery.llm.text import SPACED, Chunk, Hashes, U, mix, spans

#: Thresholds of the thermometer features.
_STEPS = np.array([0.01, 0.02, 0.04, 0.06, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
_LENGTHS = np.array([3, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 5000])


def ratios(c: Chunk) -> dict[str, np.ndarray]:
    m = {k: v.astype(float) for k, v in measures(c).items()}
    words, chars = np.maximum(m["n_words"], 1), np.maximum(m["word_chars"], 1)
    return {
        "symbols": m["n_symbols"] / chars, "capitals": m["n_upper"] / chars, "marks": m["n_marks"] / words, "digits": m["n_digits"] / chars,
        "lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1), "repeats": m["n_repeat_words"] / words, "same": 1 - m["n_word_kinds"] / words,
        "length": m["n_words"], "mean": chars / words,
    }


def votes(c: Chunk, texts: list) -> np.ndarray:
    r = ratios(c)

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, 2))

    none = np.zeros(c.n, bool)
    return np.stack([
        vote(r["symbols"] > 0.1, r["symbols"] < 0.02), vote(r["capitals"] > 0.3, r["capitals"] < 0.1), vote(r["marks"] > 0.3, r["marks"] < 0.02),
        vote(r["lines"] > 0.3, r["lines"] < 0.05), vote((r["same"] > 0.8) & (r["length"] < 400), r["same"] < 0.5), vote(r["repeats"] > 0.3, r["repeats"] < 0.02),
        vote(r["length"] < 3, none), vote((r["mean"] > 14) | (r["mean"] < 2.5), (r["mean"] > 3.5) & (r["mean"] < 9)), vote(r["digits"] > 0.2, none),
    ], 1)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    codes = c.codes(SPACED)
    s, e = spans(codes)
    h, text = Hashes(codes), c.text_of(s)
    tail = e - s > 3
    out = [mix(h.of(s, e) ^ U(0x11)), mix(h.of(e[tail] - 3, e[tail]) ^ U(0x22))]
    at = [text, text[tail]]
    for k, (name, value) in enumerate(ratios(c).items()):
        steps = _LENGTHS if name in ("length", "mean") else _STEPS
        passed = np.searchsorted(steps, value, "right")
        where = np.repeat(np.arange(c.n), passed)
        step = np.arange(passed.sum()) - np.repeat(np.cumsum(passed) - passed, passed)
        out.append(mix((step + 64 * (k + 1)).astype(U) ^ U(0x3300000000)))
        at.append(where)
    return np.concatenate(at), (np.concatenate(out) >> U(64 - BITS)).astype(np.int64)


def quality(documents: DataFrame, labels: DataFrame, labelled: int = 8000, unlabelled: int = 2000) -> DataFrame:
    """doc_id, held_out, score (1: good), predicted for every document.

    labelled, unlabelled: the most sample rows that teach; ids with crc32(doc_id) mod 5 = 0 never do.
    """
    held = fold(F.col("doc_id"), 5) == 0
    weights, bias, _ = train(sample(documents, labels, "quality", held, labelled, unlabelled), features, votes)
    return scored(documents, features, weights, bias, held)
