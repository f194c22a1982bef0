"""Quality rules with risk-controlled thresholds (operator 4).

Base measures of each text come from one vectorised pass. Labelled good documents are the holdout:
for every stratum (language) and rule, cutoffs are tested from lenient to strict, and the strictest
one is taken up to which the exact (Clopper-Pearson) upper bound of the false-rejection rate stays
within the rule's share of `risk`. A fixed sequence needs no correction along one rule; across
strata and rules the error level is divided (Bonferroni). So with probability 1 - error, no stratum
loses more than `risk` of its good documents to the learned rules. A stratum with too few labelled
rows certifies nothing, and its documents are kept unless the base rule fails.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.text import PLAIN, SPACED, Chunk, Hashes, chunks, spans, windows
from orrery.store import Scratch

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_digits long, n_marks long, n_word_kinds long"


def measures(c: Chunk) -> dict[str, np.ndarray]:
    """The base counts of each text of a chunk, and a few more that the rules use."""
    codes = c.codes(SPACED)
    s, e = spans(codes)
    text = c.text_of(s)
    word = Hashes(codes).of(s, e)
    inside = codes != 0
    out = {"n_words": np.bincount(text, minlength=c.n), "word_chars": c.sums(inside & _LEAD[c.data])}
    out["n_symbols"] = c.sums(_SYMBOL[c.data] & c.inside)
    # Lines: runs between newlines; those with a word, equal to an earlier line of the same text.
    line_code = np.where((c.data == 10) | ~c.inside, 0, PLAIN[c.data])
    ls, le = spans(line_code)
    count = np.concatenate(([0], np.cumsum(inside)))
    has = count[le] > count[ls]
    ls, le = ls[has], le[has]
    lt = c.text_of(ls)
    out["n_lines"] = np.bincount(lt, minlength=c.n)
    out["n_dup_lines"] = np.bincount(lt[_later(lt, Hashes(line_code).of(ls, le))], minlength=c.n)
    w, at = windows(word, text, 5)
    full = text[np.minimum(at + 4, len(text) - 1)] == text[at] if len(at) else np.zeros(0, bool)
    full &= at + 5 <= len(text)
    w, at = w[full], at[full]
    often = _repeated(text[at], w)
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at[often], 1)
    np.add.at(cover, at[often] + 5, -1)
    out["n_repeat_words"] = np.bincount(text[np.cumsum(cover[:-1]) > 0], minlength=c.n)
    out["n_upper"] = c.sums(_UPPER[c.data] & c.inside)
    out["n_digits"] = c.sums(_DIGIT[c.data] & c.inside)
    out["n_marks"] = c.sums((c.data == 33) & c.inside)
    out["n_word_kinds"] = out["n_words"] - np.bincount(text[_later(text, word)], minlength=c.n)
    return out


def _groups(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, text))
    same = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    return order, same


def _later(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indices whose value was seen before in the same text (lexsort is stable)."""
    order, same = _groups(text, value)
    return order[1:][same]


def _repeated(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    order, same = _groups(text, value)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return order[hit]


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, lang and the measures of every row; a null text has no words."""
    names = [m.split()[0] for m in MEASURES.split(", ")]

    def run(batches):
        for batch in batches:
            for i, j, c in chunks(batch.column("text")):
                m = measures(c)
                yield pa.record_batch([batch.column("doc_id").slice(i, j - i), batch.column("lang").slice(i, j - i), *(pa.array(m[x].astype(np.int64)) for x in names)], names=["doc_id", "lang", *names])

    return documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, f"doc_id long, lang string, {MEASURES}")


#: Rules as (name, SQL of the measure; large is bad, cutoffs from lenient to strict).
RULES = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    ("capitals", "n_upper / greatest(word_chars, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    ("marks", "n_marks / greatest(n_words, 1)", [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]),
    ("same lines", "n_dup_lines / greatest(n_lines, 1)", [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1]),
    ("same words", "1 - n_word_kinds / greatest(n_words, 1)", [0.98, 0.96, 0.94, 0.92, 0.9, 0.88, 0.85, 0.8, 0.75, 0.7]),
]


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate of which k of n were seen."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:  # P(X <= k)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and tail(mid) > error else (low, mid)
    return high


def choose_cutoffs(counts: dict, risk: float, error: float) -> dict:
    """{stratum: [cutoff or None of each rule]} from {(stratum, rule index): passed-cutoff histogram}.

    histogram[b] is how many good documents exceed exactly the b strictest... cutoffs counted from
    the lenient end are those with index < (cutoffs - b).
    """
    strata = sorted({s for s, _ in counts})
    level = error / max(1, len(strata) * len(RULES))
    out = {}
    for s in strata:
        out[s] = []
        for r, (_, _, cutoffs) in enumerate(RULES):
            hist = counts.get((s, r), {})
            n, best = sum(hist.values()), None
            for i, cut in enumerate(cutoffs):
                k = sum(v for b, v in hist.items() if b >= len(cutoffs) - i)  # they exceed cutoff i
                if k > n * risk / len(RULES) or upper_bound(k, n, level) > risk / len(RULES):
                    break
                best = cut
            out[s].append(best)
    return out


def quality_rules(documents: DataFrame, labels: DataFrame, risk: float = 0.1, error: float = 0.05, max_strata: int = 1000) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the rule that rejected, for every document.

    risk: the most share of good documents of a stratum that the learned rules may reject; error:
    the probability that this fails anywhere. Null language is a stratum of its own. Repeated rows
    are each judged; repeated labels count once, by the largest value.
    """
    spark = documents.sparkSession
    table = Scratch(spark, "rules").write(measured(documents), "measures")
    table = table.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")).withColumn("stratum", F.coalesce("lang", F.lit("\x00none")))
    good = labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()
    held = table.where("not base_failed").join(good, "doc_id", "left_semi")
    passed = F.array(*[sum((F.expr(sql) > cut).cast("int") for cut in cuts) for _, sql, cuts in RULES])
    found = held.select("stratum", F.posexplode(passed).alias("rule", "passed")).groupBy("stratum", "rule", "passed").count()
    rows = found.limit(max_strata * sum(len(c) + 1 for *_, c in RULES) + 1).collect()  # strata x cutoffs, not rows
    counts: dict = {}
    for r in rows:
        counts.setdefault((r["stratum"], r["rule"]), {})[r["passed"]] = r["count"]
    if len({s for s, _ in counts}) > max_strata:
        raise ValueError(f"more than {max_strata} strata; group them first")
    chosen = choose_cutoffs(counts, risk, error)
    cutoffs = spark.createDataFrame([(s, [float(c) if c is not None else None for c in cs]) for s, cs in chosen.items()], "stratum string, cutoffs array<double>")
    joined = table.join(F.broadcast(cutoffs), "stratum", "left")  # max_strata rows at most
    hits = [F.when(F.coalesce(F.expr(sql) > F.col("cutoffs")[i], F.lit(False)), F.lit(name)) for i, (name, sql, _) in enumerate(RULES)]
    out = joined.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(F.coalesce(*hits)))
    return out.withColumn("kept", F.col("rejected_by").isNull()).select("doc_id", *[m.split()[0] for m in MEASURES.split(", ")], "base_failed", "kept", "rejected_by")
