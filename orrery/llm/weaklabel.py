"""A generative label model: latent class, voters with unknown accuracies and pairwise correlations.

Votes are 0, 1 or 2 (abstain). P(votes, y) factors over a forest: every voter depends on y, and
may depend on one other voter. The forest is the maximum spanning forest by conditional mutual
information given y (Chow-Liu), so duplicated or overlapping voters are not counted twice.
Parameters come from expectation-maximisation, calibrated by the rows with a known label.
It runs on a bounded sample on the driver.
"""

from __future__ import annotations

import numpy as np

OUTCOMES = 3


class LabelModel:
    def __init__(self, trust: float = 0.98, smooth: float = 0.5, least_information: float = 0.01, rounds: int = 25):
        self.trust, self.smooth, self.least, self.rounds = trust, smooth, least_information, rounds

    def fit(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Posterior P(y = 1) of every row of votes (n x m), from its votes alone.

        labels: 0, 1 or -1 for each row. The expectation step takes them where they are known, so they calibrate the voters'
        accuracies and the prior; without them it drifts to another latent class. What is returned is the voters' verdict
        alone: no row's own label is part of its posterior.
        """
        n, m = votes.shape
        self.parent = np.full(m, -1)
        known = labels >= 0
        prior = (np.sum(labels == 1) + 1) / (known.sum() + 2) if known.any() else 0.5
        agree = ((votes == 1).sum(1) - (votes == 0).sum(1)) / max(1, m)
        post = np.where(known, np.where(labels == 1, self.trust, 1 - self.trust), np.clip(prior + 0.4 * agree, 0.02, 0.98))
        if not n or not m:
            self.prior, self.tables = prior, np.zeros((m, 2, OUTCOMES, OUTCOMES))
            return np.full(n, prior)
        # The forest comes first: started without it, EM takes a block of copied voters for the class itself.
        self.parent = self._forest(votes, post)
        for _ in range(self.rounds):
            self._maximise(votes, post)
            new = np.where(known, post, self.posterior(votes))
            moved, post = np.abs(new - post).max(), new
            if moved < 1e-4:
                break
        return self.posterior(votes)

    def _maximise(self, votes: np.ndarray, post: np.ndarray) -> None:
        n, m = votes.shape
        self.prior = (post.sum() + 1) / (n + 2)
        self.tables = np.zeros((m, 2, OUTCOMES, OUTCOMES))  # voter, class, parent's vote, vote
        for j in range(m):
            above = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(n, votes.dtype)
            for y, w in enumerate((1 - post, post)):
                single = np.bincount(votes[:, j], weights=w, minlength=OUTCOMES) + self.smooth
                single /= single.sum()
                t = np.bincount(above * OUTCOMES + votes[:, j], weights=w, minlength=OUTCOMES**2).reshape(OUTCOMES, OUTCOMES)
                t = t + 2 * self.smooth * single
                self.tables[j, y] = np.log(t / t.sum(1, keepdims=True))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            above = votes[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(votes), votes.dtype)
            said = self.tables[j, 1, above, votes[:, j]] - self.tables[j, 0, above, votes[:, j]]
            z += np.where(votes[:, j] == 2, 0.0, said)  # silence of many rare voters is no evidence
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def _forest(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        n, m = votes.shape
        weight = np.zeros((m, m))
        for y, w in enumerate((1 - post, post)):
            total = w.sum() + 1e-9
            hot = np.concatenate([(votes == k) for k in range(OUTCOMES)], 1).astype(float)
            joint = (hot * w[:, None]).T @ hot / total
            single = np.diag(joint).copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                part = np.where(joint > 0, joint * np.log(joint / np.outer(single, single)), 0.0)
            share = total / (n + 1e-9)
            for a in range(OUTCOMES):
                for b in range(OUTCOMES):
                    weight += share * part[a * m : (a + 1) * m, b * m : (b + 1) * m]
        self.correlation = weight
        parent, inside = np.full(m, -1), np.zeros(m, bool)
        best, via = np.full(m, -np.inf), np.full(m, -1)
        for _ in range(m):
            j = int(np.argmax(np.where(inside, -np.inf, best))) if (~inside & (best > self.least)).any() else int(np.flatnonzero(~inside)[0])
            parent[j] = via[j] if best[j] > self.least else -1
            inside[j] = True
            better = ~inside & (weight[j] > best)
            best[better], via[better] = weight[j][better], j
        return parent
