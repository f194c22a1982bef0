r"""Personal data by a semi-Markov conditional random field (operator 12).

Fixed patterns give the base spans (email, ip, card, phone); they always stay. The model adds spans that the patterns
miss, such as addresses written with "at" and "dot", numbers without their plus sign, and digits with unusual separators.

A line is cut into tokens: digit runs, runs of ASCII letters, runs of other letters, runs of blanks, single other
characters. A segmentation gives every token to a segment: one token outside, or an entity of at most `LONGEST` tokens
and one of four kinds. Whole segments are scored: counts of digits, groups, dots and letters, the check digit, octets,
what stands at the two ends and beside them, the shape; segments in a row by a table of kinds. Weights maximise the
likelihood of known segmentations (forward-backward over segments). The best segmentation comes from the same recursion with
maxima, over boundaries and kinds at once. An entity must have a digit, an @, or an "at" that a "dot" follows, so only the
surroundings of those are looked at; all other tokens lie outside anyway, and the result is that of the whole text.

Training: of at most TAUGHT rows, by a hash of the id, whatever their texts, at most STRETCHES stretches each of at most STRETCH characters. Base
spans are the entities; each stretch is also given with its entities rewritten in the ways above, and rewritten into look-alikes that are
none (wrong check digit, an octet over 255, too few digits). Where the sample has no base span, nothing is added.

Nulls and odd rows: a null or empty text has no spans; null and repeated ids are rows like all others. Texts and lines of any length are read whole; a
line is the unit of memory, some 300 bytes a token. Only doc_id and text are read, so other columns' names don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds, in order.
KINDS = ["email", "ip", "card", "phone"]
TAUGHT = 300
LONGEST = 24
STRETCHES = 4
STRETCH = 400
FLUSH = 50000  # tokens read before they are scored
AT_ONCE = 4096  # tokens scored at a time

_AT = re.compile("@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the run of local characters before it: one pass, whatever the runs' lengths."""
    free = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < free:
            continue
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (d := _DOMAIN.match(text, at + 1)):
            yield start, d.end()
            free = d.end()
        else:
            free = max(free, at + 1)  # no local part crosses an @


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Of each run of numbers joined by dots, four at a time."""
    for m in _CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = at + sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in own):
                yield at, end
            at = end + 1


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; matches that fail their check are dropped and not tried again."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(a, 1, b) for a, b in ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# Tokens and stretches.

_TOKEN = re.compile(r"(?P<d>[0-9]+)|(?P<a>[A-Za-z]+)|(?P<u>[^\W\d_A-Za-z]+)|(?P<s>[^\S\n]+)|(?P<p>.)", re.S)
_MARK = re.compile(r"[0-9@]|\b[Aa][Tt]\b")
_KIND = {"d": 0, "a": 1, "u": 1, "s": 2}
_MARKS = {"+": 3, "(": 4, ")": 4, "[": 5, "]": 5, ".": 6, "-": 7, "@": 8}
OTHER, EDGE = 9, 10


class Tokens:
    """Token columns of many stretches in a row; stretch k covers tokens cut[k]:cut[k + 1]."""

    def __init__(self):
        self.kind, self.start, self.end, self.text, self.cut, self.owner, self.before, self.after = [], [], [], [], [0], [], [], []

    def add(self, owner: int, at: int, pieces: list[tuple[int, int, int, str]], before: int, after: int) -> None:
        for kind, a, b, s in pieces:
            self.kind.append(kind)
            self.start.append(at + a)
            self.end.append(at + b)
            self.text.append(s)
        self.cut.append(len(self.kind))
        self.owner.append(owner)
        self.before.append(before)
        self.after.append(after)


def _pieces(line: str) -> list[tuple[int, int, int, str]]:
    out = []
    for m in _TOKEN.finditer(line):
        s, g = m.group(), m.lastgroup
        out.append((_KIND[g] if g != "p" else _MARKS.get(s, OTHER), m.start(), m.end(), s))
    return out


def _anchors(pieces: list[tuple[int, int, int, str]], longest: int) -> list[int]:
    dots = [i for i, p in enumerate(pieces) if p[0] == 1 and len(p[3]) == 3 and p[3].lower() == "dot"]
    out, d = [], 0
    for i, p in enumerate(pieces):
        if p[0] in (0, 8):
            out.append(i)
        elif p[0] == 1 and len(p[3]) == 2 and p[3].lower() == "at":
            while d < len(dots) and dots[d] < i:
                d += 1
            if d < len(dots) and dots[d] - i < longest:
                out.append(i)
    return out


def add_stretches(tokens: Tokens, owner: int, text: str, longest: int = LONGEST) -> None:
    """The tokens of the text that may lie in an entity: those nearer than the longest entity to an anchor of their line."""
    done = 0
    while m := _MARK.search(text, done):
        at = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", m.start())
        end = len(text) if end < 0 else end
        pieces = _pieces(text[at:end])
        spans: list[list[int]] = []
        for i in _anchors(pieces, longest):
            a, b = max(0, i - longest + 1), min(len(pieces), i + longest)
            if spans and a <= spans[-1][1]:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        for a, b in spans:
            tokens.add(owner, at, pieces[a:b], pieces[a - 1][0] if a else EDGE, pieces[b][0] if b < len(pieces) else EDGE)
        done = end


# Features of segments.

def _upto(x: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(x, most)


SHAPES = 1024
#: Number of values of each feature of a segment, in the order of `features`.
SIZES = [1, 11, 8, 9, 15, 3, 3, 6, 10, 10, 11, 11, 5, 7, LONGEST + 1, 4, SHAPES]


class Columns:
    """Prefix sums over tokens, from which the features of any segments follow."""

    def __init__(self, t: Tokens):
        n = self.n = len(t.kind)
        kind, self.cut = np.array(t.kind, np.int64), np.array(t.cut, np.int64)
        size = np.diff(self.cut)
        self.stop = np.repeat(self.cut[1:], size)
        self.kind = np.concatenate((kind, np.full(LONGEST + 1, EDGE)))
        self.before = np.concatenate(([EDGE], kind[:-1])) if n else kind
        self.before[self.cut[:-1][size > 0]] = np.array(t.before, np.int64)[size > 0]
        self.after = np.repeat(np.array(t.after, np.int64), size)
        digits = [s if k == 0 else "" for k, s in zip(t.kind, t.text)]
        low = [s.lower() if k == 1 and len(s) <= 3 else "" for k, s in zip(t.kind, t.text)]
        flags = {
            "digits": [len(s) for s in digits], "groups": kind == 0, "ats": kind == 8, "dots": kind == 6, "at_cues": [s == "at" for s in low], "dot_cues": [s == "dot" for s in low],
            "letters": kind == 1, "blanks": kind == 2, "odd": kind == OTHER, "plus": kind == 3, "brackets": (kind == 4) | (kind == 5), "dashes": kind == 7,
            "bad_octets": [len(s.lstrip("0")) > 3 or int(s.lstrip("0")[:4] or 0) > 255 for s in digits],
        }
        self.sums = {k: _prefix(v) for k, v in flags.items()}
        # Check digits: sums of the digits and of their doubles, by parity of the digit's place.
        d = np.frombuffer("".join(digits).encode(), np.uint8).astype(np.int64) - 48
        twice, even = np.where(d > 4, 2 * d - 9, 2 * d), np.arange(len(d)) % 2 == 0
        self.checks = [_prefix(np.where(p, v, 0)) for v in (d, twice) for p in (even, ~even)]

    def features(self, rows: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(allowed, values of each feature) of the segments from `rows` on: a row a token, a column a length, 1 to longest."""
        kind, i, stop = self.kind, rows[:, None], self.stop[rows][:, None]
        end = i + np.arange(1, longest + 1)[None]
        inside = end <= stop
        last = end == stop
        end = np.minimum(end, self.n)
        n = {k: v[end] - v[i] for k, v in self.sums.items()}
        a, b = self.sums["digits"][i], self.sums["digits"][end]
        c = [v[b] - v[a] for v in self.checks]
        good = (np.where((b - 1) % 2 == 0, c[0] + c[3], c[1] + c[2]) % 10 == 0) & (b > a)
        first, final = kind[i], kind[end - 1]
        following = np.where(last, self.after[rows][:, None], kind[end])
        numeric = (n["letters"] == 0) & (n["ats"] == 0)
        marks = n["brackets"] + n["dashes"] + n["dots"] + n["blanks"]
        card = np.where(numeric & (n["digits"] >= 14) & (n["digits"] <= 19), 1 + good, 0)
        ip = np.where(numeric & (n["groups"] == 4) & (n["dots"] >= 3) & (n["odd"] == 0) & (n["dashes"] == 0), 1 + (n["bad_octets"] == 0), 0)
        phone = np.where(numeric & (n["digits"] >= 10) & (n["digits"] <= 15) & (n["odd"] == 0), np.where(marks > 0, 2, 1), 0)
        shape, h = np.zeros(end.shape, np.int64), np.zeros(len(rows), np.int64)
        for j in range(longest):
            h = (h * 31 + kind[np.minimum(rows + j, self.n)] + 1) % 1000003
            shape[:, j] = h % SHAPES
        values = [
            np.zeros_like(end), np.searchsorted([1, 4, 7, 8, 10, 11, 14, 16, 17, 20], n["digits"], "right"), _upto(n["groups"], 7), 3 * _upto(n["ats"], 2) + _upto(n["at_cues"], 2),
            3 * _upto(n["dots"], 4) + _upto(n["dot_cues"], 2), card, ip, 2 * phone + (first == 3), first, final, self.before[i], following, _upto(n["blanks"], 4), _upto(n["letters"], 6),
            np.arange(1, longest + 1)[None], _upto(n["odd"] + n["plus"] - (first == 3), 3), shape,
        ]
        allowed = inside & ((n["digits"] > 0) | (n["ats"] > 0) | (n["at_cues"] > 0)) & (first != 2) & (final != 2)
        return allowed, [np.broadcast_to(v, end.shape) for v in values]


def _prefix(x) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.asarray(x, np.int64))))


# The model.


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class SemiCrf:
    """Weights of (feature value, kind), and of one label after another; label 0 is outside."""

    def __init__(self, longest: int = LONGEST):
        self.longest, self.labels = longest, len(KINDS) + 1
        self.weights = [np.zeros((n, len(KINDS))) for n in SIZES]
        self.follows = np.zeros((self.labels, self.labels))

    def scores(self, allowed: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        """Score of every (token, length, kind); minus infinity where no entity may be."""
        row, col = np.nonzero(allowed)
        own = sum(w[v[row, col]] for w, v in zip(self.weights, values))
        out = np.full((*allowed.shape, len(KINDS)), -np.inf)
        out[row, col] = own
        return out

    def _batch(self, columns: Columns, which: np.ndarray) -> np.ndarray:
        """Scores of some stretches side by side: (stretch, place, length, kind), padded by tokens outside."""
        size = np.diff(columns.cut)[which]
        rows = np.concatenate([np.arange(columns.cut[w], columns.cut[w + 1]) for w in which])
        out = np.full((len(which), int(size.max()), self.longest, len(KINDS)), -np.inf)
        out[np.repeat(np.arange(len(which)), size), rows - np.repeat(columns.cut[which], size)] = self.scores(*columns.features(rows, self.longest))
        return out

    def forward(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """alpha: all segmentations up to a border that end in a label; enter: the same with the next label's transition."""
        n, t = s.shape[:2]
        alpha, enter = (np.full((n, t + 1, self.labels), -np.inf, s.dtype) for _ in range(2))
        follows = self.follows.astype(s.dtype)
        alpha[:, 0, 0] = 0
        for i in range(t + 1):
            if i:
                span = min(i, self.longest)
                back = np.arange(1, span + 1)
                alpha[:, i, 1:] = _logsum(enter[:, i - back, 1:] + s[:, i - back, back - 1], 1)
                alpha[:, i, 0] = enter[:, i - 1, 0]
            enter[:, i] = _logsum(alpha[:, i, :, None] + follows[None], 1)
        return alpha, enter

    def backward(self, s: np.ndarray, size: np.ndarray) -> np.ndarray:
        """beta: all segmentations from a border on, after a label."""
        n, t = s.shape[:2]
        beta = np.full((n, t + 1, self.labels), -np.inf, s.dtype)
        follows = self.follows.astype(s.dtype)
        for i in range(t, -1, -1):
            if i < t:
                ahead = np.arange(1, min(t - i, self.longest) + 1)
                go = np.full((n, self.labels), -np.inf, s.dtype)
                go[:, 1:] = _logsum(s[:, i, ahead - 1] + beta[:, i + ahead, 1:], 1)
                go[:, 0] = beta[:, i + 1, 0]
                beta[:, i] = _logsum(follows[None] + go[:, None, :], 2)
            beta[i == size, i] = 0
        return beta

    def fit(self, t: Tokens, gold: list[list[tuple[int, int, int]]], rounds: int = 40, rate: float = 0.7, decay: float = 0.01) -> None:
        """gold: (first token, length, kind) in each stretch, places counted in the stretch. Adaptive gradient steps on the log-likelihood."""
        columns = Columns(t)
        cut = columns.cut
        allowed, values = columns.features(np.arange(columns.n), self.longest)
        row, col = np.nonzero(allowed)
        own = [v[row, col] for v in values]
        del values
        size = np.diff(cut)
        truth = np.zeros((*allowed.shape, len(KINDS)))
        pairs = np.zeros_like(self.follows)
        for k, spans in enumerate(gold):
            at, label = 0, 0
            for a, n, y in sorted(spans):
                truth[cut[k] + a, n - 1, y] = 1
                for _ in range(a - at):
                    pairs[label, 0] += 1
                    label = 0
                pairs[label, y + 1] += 1
                at, label = a + n, y + 1
            for _ in range(size[k] - at):
                pairs[label, 0] += 1
                label = 0
        groups = [g for g in np.array_split(np.argsort(size, kind="stable"), max(1, len(size) // 64)) if len(g)]
        state = [np.full_like(w, 1e-6) for w in [*self.weights, self.follows]]
        for _ in range(rounds):
            s = np.full((*allowed.shape, len(KINDS)), -np.inf, np.float32)
            s[row, col] = sum(w[v] for w, v in zip(self.weights, own))
            expect, moves = np.zeros_like(truth), np.zeros_like(self.follows)
            for g in groups:
                x = np.full((len(g), int(size[g].max()), self.longest, len(KINDS)), -np.inf, np.float32)
                for k, w in enumerate(g):
                    x[k, : size[w]] = s[cut[w] : cut[w + 1]]
                alpha, enter = self.forward(x)
                beta = self.backward(x, size[g])
                z = alpha[np.arange(len(g)), size[g]]
                z = _logsum(z, 1)[:, None, None]
                for j in range(x.shape[1]):
                    ahead = np.arange(1, min(x.shape[1] - j, self.longest) + 1)
                    inside = np.exp(enter[:, j, None, 1:] + x[:, j, ahead - 1] + beta[:, j + ahead, 1:] - z)
                    on = j < size[g]
                    expect[cut[g[on]] + j, : len(ahead)] += inside[on]
                    go = np.full((len(g), self.labels), -np.inf)
                    go[:, 1:] = _logsum(x[:, j, ahead - 1] + beta[:, j + ahead, 1:], 1)
                    go[:, 0] = beta[:, j + 1, 0]
                    moves += np.exp(alpha[on, j, :, None] + self.follows[None] + go[on, None, :] - z[on]).sum(0)
            gap = (truth - expect)[row, col] / len(size)
            grads = [np.stack([np.bincount(v, weights=gap[:, y], minlength=len(w)) for y in range(len(KINDS))], 1) for w, v in zip(self.weights, own)]
            for w, g, h in zip([*self.weights, self.follows], [*grads, (pairs - moves) / len(size)], state):
                g = g - decay * w / len(size)
                h += g * g
                w += rate * g / np.sqrt(h)

    def decode(self, t: Tokens) -> list[tuple[int, int, int, int]]:
        """(owner, start, kind, end) of the entities of the best segmentation of every stretch."""
        if not t.kind:
            return []
        columns, out = Columns(t), []
        cut, size = columns.cut, np.diff(columns.cut)
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            # Stretches of like length side by side; one longer than AT_ONCE goes alone, scored piece by piece.
            j = i + 1
            while j < len(order) and size[order[j]] <= size[order[i]] + 16 and (j + 1 - i) * size[order[j]] <= AT_ONCE:
                j += 1
            which = order[i:j]
            best, via, length = self._best(columns, which)
            for k, w in enumerate(which):
                p = int(size[w])
                label = int(best[k, p].argmax())
                while p > 0:
                    n = int(length[k, p, label]) if label else 1
                    if label:
                        out.append((t.owner[w], t.start[cut[w] + p - n], label - 1, t.end[cut[w] + p - 1]))
                    p -= n
                    label = int(via[k, p, label])
            i = j
        return out

    def _best(self, columns: Columns, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By (stretch, border, label): the best score, the label before it, the length of its last segment."""
        n, width = len(which), int(np.diff(columns.cut)[which].max())
        best, enter = (np.full((n, width + 1, self.labels), -np.inf) for _ in range(2))
        via, length = np.zeros((n, width + 1, self.labels), np.int8), np.ones((n, width + 1, self.labels), np.int8)
        best[:, 0, 0] = 0
        if width <= AT_ONCE:
            x, first = self._batch(columns, which), 0
        else:
            x, first = np.zeros((1, 0, self.longest, len(KINDS))), 0
        for p in range(width + 1):
            if p:
                if p - first > x.shape[1]:  # one long stretch: keep the last rows and score the next ones
                    rows = np.arange(first + x.shape[1], min(width, first + x.shape[1] + AT_ONCE))
                    kept = x[:, max(0, x.shape[1] - self.longest) :]
                    first = rows[0] - kept.shape[1]
                    x = np.concatenate((kept, self.scores(*columns.features(columns.cut[which[0]] + rows, self.longest))[None]), 1)
                back = np.arange(1, min(p, self.longest) + 1)
                may = enter[:, p - back, 1:] + x[:, p - back - first, back - 1]
                k = may.argmax(1)
                length[:, p, 1:] = k + 1
                best[:, p, 1:] = np.take_along_axis(may, k[:, None], 1)[:, 0]
                best[:, p, 0] = enter[:, p - 1, 0]
            move = best[:, p, :, None] + self.follows[None]
            via[:, p] = move.argmax(1)
            enter[:, p] = move.max(1)
        return best, via, length


# Training stretches.


def _rewrite(kind: int, s: str, rnd: random.Random) -> tuple[str, bool]:
    """Another form of an entity, and whether it still is one."""
    lie = rnd.random() < 0.35
    if kind == 0:
        local, domain = s.split("@", 1)
        if lie:
            return (f"@{local}" if rnd.random() < 0.5 else f"{local}@"), False
        at = rnd.choice([" at ", " (at) ", "[at]", " AT "])
        dot = rnd.choice([" dot ", "[dot]", ".", " DOT "]) if at != "[at]" else rnd.choice(["[dot]", "."])
        if at.lower() == " at " and dot == ".":
            dot = " dot "
        return (local.replace(".", dot) if "dot" in dot.lower() and rnd.random() < 0.5 else local) + at + domain.replace(".", dot), True
    if kind == 1:
        if lie:
            parts = s.split(".")
            parts[rnd.randrange(4)] = str(rnd.randint(256, 999))
            return rnd.choice([".".join(parts), ".".join(parts[:3])]), False
        return s.replace(".", rnd.choice(["[.]", "(.)", " . "])), True
    d = _digits(s)
    if kind == 2:
        if lie:
            d = d[:-1] + str((int(d[-1]) + rnd.randint(1, 9)) % 10)
            return rnd.choice(["", " ", "-", "."]).join(d[i : i + 4] for i in range(0, len(d), 4)), False
        return rnd.choice([".", "/", "_", " - "]).join(d[i : i + 4] for i in range(0, len(d), 4)), True
    if lie:
        return rnd.choice([f"{d[-7:-4]}-{d[-4:]}", d, f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:1]}.{d[1:3]}"]), False
    own = s[1:]
    return rnd.choice([own, "00" + own, own.replace(" ", "."), own.replace(" ", "-"), "(+" + d[:1] + ")" + own[1:]]), True


def _stretches(text: str, most: int = STRETCHES) -> list[str]:
    """Surroundings of the first numbers and @ of a text, at most STRETCH characters each."""
    out, done = [], 0
    for m in re.finditer("[0-9@]", text):
        if m.start() >= done and len(out) < most:
            a, b = max(0, m.start() - STRETCH // 2), min(len(text), m.start() + STRETCH // 2)
            out.append(text[a:b])
            done = b
    return out


def taught(documents: DataFrame, most: int = TAUGHT) -> list[str]:
    """Stretches of at most `most` rows, chosen by a hash of the id; rows times STRETCHES times STRETCH characters bound what the driver gets."""
    rows = documents.count()
    if not rows:
        return []
    order = F.xxhash64(F.col("doc_id"))
    share = min(1.0, 4.0 * most / rows)
    few = documents.where(order.cast("double") <= share * 2.0**64 - 2.0**63).select(order.alias("order"), F.xxhash64("text").alias("also"), "text")

    def run(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            on = pc.match_substring_regex(text, "[0-9@]")
            b = batch.filter(on)
            yield pa.record_batch([b.column("order"), b.column("also"), pa.array([_stretches(x) for x in b.column("text").to_pylist()], pa.list_(pa.string()))], names=["order", "also", "stretches"])

    got = few.mapInArrow(run, "order long, also long, stretches array<string>").orderBy("order", "also").limit(most).collect()
    return [s for r in got for s in r["stretches"]]


def learn(stretches: list[str], longest: int = LONGEST, seed: int = 7) -> SemiCrf | None:
    """A model of the base spans and their rewritten forms; none where there is nothing to learn."""
    rnd, tokens, gold = random.Random(seed), Tokens(), []
    some = False

    def add(text: str, spans: list[tuple[int, int, int]]) -> None:
        first = len(tokens.owner)
        add_stretches(tokens, 0, text, longest)
        for k in range(first, len(tokens.owner)):
            a, b = tokens.cut[k], tokens.cut[k + 1]
            starts = {tokens.start[i]: i - a for i in range(a, b)}
            ends = {tokens.end[i]: i - a for i in range(a, b)}
            own = [(starts[s], ends[e] - starts[s] + 1, y) for s, y, e in spans if s in starts and e in ends]
            gold.append([(i, n, y) for i, n, y in own if n <= longest])

    for text in stretches:
        spans, free = [], 0
        for s, y, e in base(text):
            if s >= free:
                spans.append((s, y, e))
                free = e
        add(text, spans)
        if spans:
            some = True
            for _ in range(2):
                out, new, done = "", [], 0
                for s, y, e in spans:
                    out += text[done:s]
                    form, real = _rewrite(y, text[s:e], rnd)
                    if real:
                        new.append((len(out), y, len(out) + len(form)))
                    out, done = out + form, e
                add(out + text[done:], new)
    if not some:
        return None
    model = SemiCrf(longest)
    model.fit(tokens, gold)
    return model


SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(documents: DataFrame, model: SemiCrf | None = None, mask: bool = False, most: int = TAUGHT) -> DataFrame:
    """doc_id and the spans of every row: base ones, and what the model adds beside them, by start, then kind; offsets in code points, end exclusive.

    mask: also the text with each span replaced by its kind in angle brackets.
    """
    model = model or learn(taught(documents, most))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand weights, whatever the corpus

    def run(batches):
        crf = shared.value
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            on = pc.or_(pc.match_substring_regex(text, "[0-9@]"), pc.and_(pc.match_substring_regex(text, r"(?i)\bat\b"), pc.match_substring_regex(text, r"(?i)\bdot\b")))
            rows = np.flatnonzero(on.to_numpy(zero_copy_only=False))
            spans: dict[int, list[tuple[int, int, int]]] = {}
            added: list[tuple[int, int, int, int]] = []
            tokens = Tokens()
            for i in rows:
                body = text[int(i)].as_py()
                spans[int(i)] = base(body)
                if crf is not None:
                    add_stretches(tokens, int(i), body, crf.longest)
                    if len(tokens.kind) >= FLUSH:
                        added += crf.decode(tokens)
                        tokens = Tokens()
            if crf is not None:
                added += crf.decode(tokens)
            new: dict[int, list[tuple[int, int, int]]] = {}
            for owner, a, y, b in added:
                new.setdefault(owner, []).append((a, y, b))
            found: list[list] = [[] for _ in range(len(text))]
            for i, own in spans.items():
                every = [(*s, True) for s in own] + [(*s, False) for s in _apart(sorted(new.get(i, [])), own)]
                found[i] = [{"kind": KINDS[y], "start": a, "end": b, "base": known} for a, y, b, known in sorted(every)]
            columns, names = [batch.column("doc_id"), pa.array(found, _SPAN)], ["doc_id", "spans"]
            if mask:
                columns, names = [*columns, pa.array([_masked(s, f) for s, f in zip(text.to_pylist(), found)], pa.string())], [*names, "masked"]
            yield pa.record_batch(columns, names=names)

    rows = documents.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN}" + ", masked string" * mask)


def _apart(new: list[tuple[int, int, int]], known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The new spans that overlap no known one; both are sorted by start."""
    out, k, reach = [], 0, 0
    for a, y, b in new:
        while k < len(known) and known[k][0] < b:
            reach = max(reach, known[k][2])
            k += 1
        if reach <= a:
            out.append((a, y, b))
    return out


def _masked(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for s in spans:
        if s["start"] >= done:
            out += [text[done : s["start"]], f"<{s['kind']}>"]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])
