"""Language identification by segmentation-marginalised unigrams (operator 6).

Every language has a probability for each piece of a fixed public vocabulary. The probability of a
word sums over all its segmentations into pieces (the forward algorithm), so no tokenizer has to
guess one. Words are runs of letters and their marks, lower-cased, of any length, with the vocabulary's word mark in
front. A text's log-probability adds up over its words. Words past `PLAIN_LENGTH` letters, and those whose sums come near the
least number there is, are summed in logarithms; the result is the same.
Piece probabilities come from expectation-maximisation (forward-backward) on a bounded sample.

The forward pass runs over many words at once, and each task keeps the scores of words it has met.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orrery.llm.learning import fold
from orrery.llm.text import U

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PLAIN_LENGTH = 48
LEAST = 1e-200  # sums below this lose digits: such words are summed in logarithms
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_ASCII = re.compile("[a-z]+")
_MARK = "▁"
_CACHE = 200_000


def read_pieces(path: str) -> list[str]:
    """The pieces of a public sentencepiece vocabulary, lower-cased, of letters and the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in found if p and (p == _MARK or _LETTERS.fullmatch(p.replace(_MARK, ""))))


def words_of(text: str | None) -> list[str]:
    """Words with a letter; marks alone are none."""
    text = (text or "").lower()
    if text.isascii():
        return _ASCII.findall(text)
    return [w for w in _LETTERS.findall(text) if w.isalpha() or any(ch.isalpha() for ch in w)]


class Segmenter:
    """Forward and backward sums over all segmentations of words, for all languages at once."""

    def __init__(self, pieces: list[str]):
        self.longest, self.n = max(map(len, pieces), default=1), len(pieces)
        hashes = np.array([self._hash(p) for p in pieces], U)
        order = np.argsort(hashes)
        self.sorted, self.ids = hashes[order], order

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * 0x100000001B3 + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the piece of k+1 letters that starts at i (words x places x k), or n; and lengths.

        A single letter that is no piece has the id n + 1, the unknown letter.
        """
        marked = np.array([_MARK + w for w in words])
        code = marked.view(np.uint32).reshape(len(words), -1).astype(U)
        size = (code != 0).sum(1)
        width = code.shape[1]
        out = np.full((len(words), width, self.longest), self.n, np.int32)
        h = np.zeros_like(code)
        for k in range(min(self.longest, width)):
            h = h[:, : width - k] * U(0x100000001B3) + code[:, k:] + U(1)
            on = np.flatnonzero((code[:, k:] != 0).ravel())  # a piece does not reach past its word
            part = h.ravel()[on]
            at = np.minimum(np.searchsorted(self.sorted, part), self.n - 1)
            hit = self.sorted[at] == part
            spot = on[hit]
            out[spot // (width - k), spot % (width - k), k] = self.ids[at[hit]]
        single = out[:, :, 0]
        single[(single == self.n) & (code != 0)] = self.n + 1
        return out, size

    def _steps(self, ids: np.ndarray) -> list[int]:
        """The piece lengths, less 1, that occur at all."""
        return [k for k in range(min(self.longest, ids.shape[1])) if (ids[:, :, k] != self.n).any()]

    def forward(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """alpha (words x places + 1 x languages): sums over segmentations of each beginning."""
        n, width, _ = ids.shape
        alpha = np.zeros((n, width + 1, table.shape[1]))
        alpha[:, 0] = 1
        steps = self._steps(ids)
        for t in range(1, width + 1):
            for k in steps:
                if k < t:
                    alpha[:, t] += alpha[:, t - k - 1] * table[ids[:, t - k - 1, k]]
        return alpha

    def _forward_log(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Logarithms of the same, for words so long that the sums themselves vanish."""
        n, width, _ = ids.shape
        with np.errstate(divide="ignore"):
            log = np.log(table)
        alpha = np.full((n, width + 1, table.shape[1]), -np.inf)
        alpha[:, 0] = 0
        steps = self._steps(ids)
        for t in range(1, width + 1):
            terms = [alpha[:, t - k - 1] + log[ids[:, t - k - 1, k]] for k in steps if k < t]
            alpha[:, t] = np.logaddexp.reduce(terms, 0)
        return alpha

    def _parts(self, words: list[str]):
        """(indexes, long) of words of like length, so many that their places number about 64,000."""
        size = np.array([len(w) for w in words])
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            long = size[order[i]] > PLAIN_LENGTH
            most = 1 if long else 2048
            stop = len(order) if long else int(np.searchsorted(size[order], PLAIN_LENGTH, "right"))
            yield order[i : min(i + most, stop)], long
            i = min(i + most, stop)

    def scores(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """log P(word) for each language; table: probability of each piece (and none, unknown)."""
        out = np.zeros((len(words), table.shape[1]))
        for part, long in self._parts(words):
            ids, size = self.spell([words[j] for j in part])
            low = np.ones(len(part), bool)
            if not long:
                value = self.forward(ids, table)[np.arange(len(part)), size]
                low = (value < LEAST).any(1)
                out[part[~low]] = np.log(value[~low])
            if low.any():
                out[part[low]] = self._forward_log(ids[low], table)[np.arange(int(low.sum())), size[low]]
        return out

    def expected(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur so many times (one language)."""
        total = np.zeros(self.n + 2)
        for part, long in self._parts(words):
            ids, size = self.spell([words[j] for j in part])
            low = np.ones(len(part), bool)
            if not long:
                alpha = self.forward(ids, table)[:, :, 0]
                low = alpha[np.arange(len(part)), size] < LEAST
                if not low.all():
                    self._uses(total, ids[~low], size[~low], counts[part[~low]], table[:, 0], alpha[~low], False)
            if low.any():
                self._uses(total, ids[low], size[low], counts[part[low]], table[:, 0], self._forward_log(ids[low], table)[:, :, 0], True)
        total[self.n] = 0
        return total

    def _uses(self, total: np.ndarray, ids: np.ndarray, size: np.ndarray, counts: np.ndarray, p: np.ndarray, alpha: np.ndarray, logs: bool) -> None:
        """Adds the pieces' expected uses in some words, in probabilities or in their logs."""
        n, width, _ = ids.shape
        steps = self._steps(ids)
        add, one, zero = (np.add, 0.0, -np.inf) if logs else (np.multiply, 1.0, 0.0)
        with np.errstate(divide="ignore"):
            own = np.log(p) if logs else p
        beta = np.full((n, width + 1), zero)
        beta[np.arange(n), size] = one
        for t in range(width - 1, -1, -1):
            for k in steps:
                if k < width - t:
                    term = add(own[ids[:, t, k]], beta[:, t + k + 1])
                    beta[:, t] = np.logaddexp(beta[:, t], term) if logs else beta[:, t] + term
        for t in range(width):
            for k in steps:
                if k < width - t:
                    use = add(add(alpha[:, t], own[ids[:, t, k]]), beta[:, t + k + 1])
                    use = np.exp(use - beta[:, 0]) if logs else use / beta[:, 0]
                    total += np.bincount(ids[:, t, k], weights=use * counts, minlength=self.n + 2)


def learn(counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the table (pieces + 2) x languages of probabilities."""
    langs = sorted(counts)
    seg = Segmenter(pieces)
    table = np.zeros((len(pieces) + 2, len(langs)))
    for j, lang in enumerate(langs):
        words = sorted(counts[lang])
        n = np.array([counts[lang][w] for w in words], float)
        p = np.full((len(pieces) + 2, 1), 1 / (len(pieces) + 1))
        p[len(pieces)] = 0  # where no piece is, nothing may pass
        for _ in range(rounds):
            use = seg.expected(words, n, p) + smooth if words else np.ones(len(pieces) + 2)
            use[len(pieces)] = 0
            p = (use / use.sum())[:, None]
        table[:, j] = p[:, 0]
    return langs, table


def language(documents: DataFrame, vocabulary: str = VOCABULARY, per_language: int = 600, max_languages: int = 200) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document.

    Learns from text and lang of at most per_language rows of each language, lowest hash of the id
    first, ids with crc32(doc_id) mod 3 = 1 and null ids excluded, with all their words; more than max_languages raises. score is the
    share of the likeliest language in the posterior, tempered to one word's evidence on average. `und`, 0.0: null text, no letter, or
    nothing to learn from. Repeated rows are each predicted; extra columns are ignored.
    """
    spark = documents.sparkSession
    held = fold(F.col("doc_id"), 3) == 1
    base = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    taught = base.where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # The first rows of all languages at once: of each of 256 parts of a language, then of what these leave.
    order = [F.xxhash64("doc_id"), "doc_id"]
    parted = taught.select("lang", "doc_id").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(256)))
    some = parted.withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= per_language)
    chosen = some.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("place") <= per_language).select("lang", "doc_id")
    langs = [r["lang"] for r in chosen.select("lang").distinct().limit(max_languages + 1).collect()]
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")

    def count(batches):
        for batch in batches:
            c: Counter = Counter()
            for t, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                c.update((lang, w) for w in words_of(t))
            yield pa.record_batch([pa.array([x for x, _ in c], pa.string()), pa.array([w for _, w in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, Counter] = {x: Counter() for x in langs}
    sample = taught.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")  # max_languages x per_language rows
    for r in sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    pieces = read_pieces(vocabulary)
    names, table = learn(counts, pieces)
    shared = spark.sparkContext.broadcast((names, pieces, table.astype(np.float64)))  # vocabulary x languages

    def run(batches):
        names, pieces, table = shared.value
        seg = Segmenter(pieces)
        place: dict[str, int] = {}
        known = np.zeros((1024, max(1, len(names))))
        for batch in batches:
            ids, held, texts = batch.column("doc_id"), batch.column("held_out"), batch.column("text").to_pylist()
            pred, conf = [], []
            for at in range(0, len(texts), 128):
                split = [words_of(t) for t in texts[at : at + 128]]
                if len(place) > _CACHE:
                    place.clear()
                new = list({w for ws in split for w in ws if w not in place}) if names else []
                if new:
                    base = len(place)
                    place.update(zip(new, range(base, base + len(new)), strict=True))
                    if base + len(new) > len(known):
                        known = np.concatenate([known[:base], np.zeros((base + 2 * len(new), known.shape[1]))])
                    known[base : base + len(new)] = seg.scores(new, table)
                for ws in split:
                    if not ws or not names:
                        pred.append("und")
                        conf.append(0.0)
                        continue
                    z = known[[place[w] for w in ws]].sum(0)
                    p = np.exp((z - z.max()) / max(1.0, len(ws)))
                    k = int(np.argmax(z))  # ties: first by name
                    pred.append(names[k])
                    conf.append(float(p[k] / p.sum()))
            yield pa.record_batch([ids, held, pa.array(pred, pa.string()), pa.array(conf, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return base.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
