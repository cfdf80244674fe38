"""Generative label models: latent truth, voter reliabilities and correlations by expectation-maximization.

Voters say 1, 0 or abstain (-1). Only the distinct vote patterns with their counts are needed,
at most 3 ** voters rows, so a fit covers all rows however many there are. Counts enter as shares,
so the same mix of patterns gives the same model at every size.
"""

from __future__ import annotations

import numpy as np


class LabelModel:
    """A latent truth with one or several causes, fitted without labels.

    hint: each voter's assumed (true positive, false positive) rates, the start and a prior worth
    ``strength`` of all rows, so that a fit can't turn a voter around. prior: assumed rate of
    cases, anchored in the same way and never above ``most``.

    causes: without it a case has one cause and every voter's silence speaks against it. With it
    (one list of voters per cause) the truth is an alternative of causes: a voter that is silent
    speaks against its own causes only, so one reliable voter alone can carry a case.
    """

    def __init__(self, hint: list[tuple[float, float]], prior: float = 0.05, strength: float = 0.02, steps: int = 30, causes: list[list[int]] | None = None, most: float = 0.5, elsewhere: float = 0.1):
        self.strength, self.steps, self.most = strength, steps, most
        groups = causes or [list(range(len(hint)))]
        # Class 0 is no case; class c holds the rates of voters where cause c is at work.
        rate = np.array([[f for _, f in hint]] + [[t if k in g else elsewhere * t for k, (t, _) in enumerate(hint)] for g in groups], float)
        self.hint, self.rate = rate, rate.copy()
        self.anchor = np.array([1 - prior] + [prior / len(groups)] * len(groups))
        self.share = self.anchor.copy()

    @property
    def prior(self) -> float:
        return float(self.share[1:].sum())

    def _classes(self, V: np.ndarray) -> np.ndarray:
        r = np.clip(self.rate, 1e-6, 1 - 1e-6)
        log = np.log(self.share) + (V == 1) @ np.log(r).T + (V == 0) @ np.log(1 - r).T
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def fit(self, V: np.ndarray, n: np.ndarray) -> LabelModel:
        """V: patterns x voters with 1, 0, -1 (abstain); n: rows of each pattern."""
        total = n.sum()
        if total == 0:
            return self
        n = n / total
        for _ in range(self.steps):
            w = self._classes(V) * n[:, None]
            s = self.strength * self.anchor[:, None]
            on, said = w.T @ (V == 1), w.T @ (V >= 0)
            self.rate = (on + s * self.hint) / (said + s)
            share = (w.sum(0) + self.strength * self.anchor) / (1 + self.strength)
            cases = share[1:].sum()
            if cases > self.most:
                share = np.concatenate([[1 - self.most], share[1:] * self.most / cases])
            self.share = np.clip(share, 1e-6, 1)
        return self

    def predict(self, V: np.ndarray) -> np.ndarray:
        return 1 - self._classes(V)[:, 0] if len(V) else np.zeros(0)


class CorrelatedLabelModel:
    """A latent truth whose voters hang together, given the truth, along a tree of pairs.

    The pairs are those of highest mutual information within the classes as the hints see them (a
    maximum spanning tree; pairs below ``least`` are left out): a fit without them would first take
    what two voters share for the truth. Every voter's rate is then estimated given its parent's vote. Two voters that say the same for one reason so count as
    little more than one of them. hint, prior and strength as in LabelModel; no abstentions.
    """

    def __init__(self, hint: list[tuple[float, float]], prior: float = 0.05, strength: float = 0.02, steps: int = 30, most: float = 0.5, least: float = 1e-3):
        self.hint, self.prior, self.anchor = np.array(hint, float), prior, prior
        self.strength, self.steps, self.most, self.least = strength, steps, most, least
        self.parent = [-1] * len(hint)
        self.rate = np.repeat(self.hint.T[:, :, None], 2, 2)  # truth (case, none), voter, parent's vote

    def _under(self, V: np.ndarray, k: int) -> np.ndarray:
        return V[:, self.parent[k]] if self.parent[k] >= 0 else np.zeros(len(V), int)

    def predict(self, V: np.ndarray) -> np.ndarray:
        r, log = np.clip(self.rate, 1e-6, 1 - 1e-6), np.zeros((len(V), 2))
        log += np.log([self.prior, 1 - self.prior])
        for k in range(V.shape[1]):
            up = self._under(V, k)
            for c in (0, 1):
                p = r[c, k, up]
                log[:, c] += np.where(V[:, k] == 1, np.log(p), np.log(1 - p))
        return 1 / (1 + np.exp(np.clip(log[:, 1] - log[:, 0], -60, 60)))

    def pairs(self) -> list[tuple[int, int]]:
        """(parent, voter) of the modelled correlations."""
        return [(p, k) for k, p in enumerate(self.parent) if p >= 0]

    def _tree(self, V: np.ndarray, w: np.ndarray) -> list[int]:
        """Parents by a maximum spanning tree over the information that pairs of voters share given the truth."""
        m = V.shape[1]
        info = np.zeros((m, m))
        for c in range(w.shape[1]):
            all_ = w[:, c].sum()
            for i in range(m):
                for j in range(i):
                    for a in (0, 1):
                        for b in (0, 1):
                            both = w[(V[:, i] == a) & (V[:, j] == b), c].sum()
                            alone = w[V[:, i] == a, c].sum() * w[V[:, j] == b, c].sum()
                            if both > 0 and alone > 0:
                                info[i, j] += both * np.log(both * all_ / alone)
        info = np.maximum(info, info.T)
        parent, rest = [-1] * m, set(range(1, m))
        while rest:
            inside = [k for k in range(m) if k not in rest]
            i, j = max(((i, j) for i in inside for j in rest), key=lambda x: info[x])
            if info[i, j] >= self.least:
                parent[j] = i
            rest.remove(j)
        return parent

    def fit(self, V: np.ndarray, n: np.ndarray) -> CorrelatedLabelModel:
        """V: patterns x voters with 1 and 0; n: rows of each pattern."""
        total = n.sum()
        if total == 0:
            return self
        n = n / total
        for step in range(self.steps):
            p = self.predict(V)
            w = np.stack([p * n, (1 - p) * n], 1)
            if step == 0:
                self.parent = self._tree(V, w)
            for k in range(V.shape[1]):
                up = self._under(V, k)
                for c, anchor in enumerate((self.anchor, 1 - self.anchor)):
                    s, own = self.strength * anchor, w[:, c]
                    for u in (0, 1):
                        at = up == u
                        self.rate[c, k, u] = (own[at & (V[:, k] == 1)].sum() + s * self.hint[k, c]) / (own[at].sum() + s)
            self.prior = float(np.clip((w[:, 0].sum() + self.strength * self.anchor) / (1 + self.strength), 1e-6, self.most))
        return self
