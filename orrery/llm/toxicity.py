"""Toxicity by weak supervision (operator 2).

Voters: word lists and patterns fixed here, and terms mined from labelled training rows. A
generative label model estimates their accuracies and correlations; its posteriors train a sparse
linear classifier over hashed words and word beginnings, which scores whole texts.

Nulls: a null text is scored as empty; a null doc_id is scored and never taught. Repeated rows are
each scored. No labels: every score is the prior. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.learning import fold, sample, scored, train
from orrery.llm.linear import BITS
from orrery.llm.text import FOLDED, Chunk, Hashes, U, mix, spans

#: Common English words of abuse, by kind.
LEXICON = {
    "intellect": ["idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile", "fool", "dimwit", "halfwit", "dunce"],
    "worth": ["worthless", "pathetic", "useless", "loser", "losers", "failure", "nobody"],
    "filth": ["scum", "trash", "garbage", "filth", "vermin", "disgusting", "vile", "dirtbag", "scumbag"],
    "ridicule": ["clown", "clowns", "joke", "buffoon", "jerk", "creep"],
    "hate": ["hate", "despise", "loathe", "kill", "die"],
    "curse": ["damn", "crap", "hell", "bastard", "bloody"],
    "threat": ["hurt", "destroy", "strangle", "stab", "shoot", "punch", "crush", "regret"],
    "looks": ["ugly", "hideous", "fat", "freak", "monster", "pig", "swine", "cow"],
    "deceit": ["liar", "liars", "cheat", "fraud", "snake", "traitor", "coward", "hypocrite"],
    "scorn": ["ridiculous", "laughable", "shameful", "embarrassing", "contemptible", "despicable", "repulsive", "revolting", "sickening"],
    "madness": ["crazy", "insane", "lunatic", "psycho", "maniac", "deranged"],
    "german": ["idioten", "dummkopf", "trottel", "versager", "abschaum", "blöd", "dumm", "hass", "widerlich", "wertlos"],
    "french": ["idiote", "imbécile", "crétin", "débile", "minable", "ordure", "nul", "haine", "stupide", "dégoûtant"],
    "spanish": ["idiotas", "imbécil", "tonto", "estúpido", "basura", "inútil", "asqueroso", "odio", "patético", "escoria"],
}
#: Patterns of address and of masked spelling.
PATTERNS = [
    r"\byou(?:'re| are)? (?:an? |such an? )?(?:\w+ )?(?:idiot|moron|loser|fool|clown|scum|trash|pathetic|stupid|worthless)",
    r"\b(?:1d[i1]ot|m[o0]r0n|l0ser|st[u\*]p[i1\*]d|tr[a@]sh|sc[u\*]m)\b",
    r"\b(?:shut up|go away|get lost|drop dead)\b",
    r"\b(?:i|we|they) (?:all |really |just )?(?:hate|despise|loathe|can't stand) (?:you|them|these|those|people)\b",
    r"\b(?:no one|nobody) (?:likes|loves|wants|needs|cares about) (?:you|him|her|them)\b",
    r"\b(?:piece|bunch|pile|waste) of (?:\w+ )?(?:trash|garbage|crap|filth|scum|space|oxygen|idiots|losers)\b",
    r"\b[a-z]+[\*@#\$%]{2,}[a-z]*\b",
]
_words = {k: re.compile(r"\b(?:" + "|".join(v) + r")\b") for k, v in LEXICON.items()}
_patterns = [re.compile(p) for p in PATTERNS]
PREFIXES = (4, 5, 6)


def features(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word beginnings of 4, 5 and 6 bytes, as (text, feature)."""
    codes = c.codes(FOLDED)
    s, e = spans(codes)
    h = Hashes(codes)
    text = c.text_of(s)
    out, at = [(mix(h.of(s, e) ^ U(0xA5A5)) >> U(64 - BITS)).astype(np.int64)], [text]
    for k in PREFIXES:
        on = e - s > k
        out.append((h.of(s[on], s[on] + k) >> U(64 - BITS)).astype(np.int64))
        at.append(text[on])
    return np.concatenate(at), np.concatenate(out)


def votes(c: Chunk, texts: list) -> np.ndarray:
    """Lexicon and pattern voters: 1 toxic, 2 silent."""
    out = np.full((len(texts), len(_words) + len(_patterns)), 2)
    for i, t in enumerate(texts):
        low = (t or "").lower()
        for k, p in enumerate([*_words.values(), *_patterns]):
            if p.search(low):
                out[i, k] = 1
    return out


def toxicity(documents: DataFrame, labels: DataFrame, labelled: int = 8000, unlabelled: int = 1500, mined: int = 64, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; see the module for the method.

    carry: add the document's row as a struct `own`. labelled, unlabelled: the most sample rows that teach; ids with crc32(doc_id) mod 5 = 0 never do.
    """
    held = fold(F.col("doc_id"), 5) == 0
    weights, bias, _ = train(sample(documents, labels, "toxic", held, labelled, unlabelled), features, votes, mined)
    return scored(documents, features, weights, bias, held, carry)
