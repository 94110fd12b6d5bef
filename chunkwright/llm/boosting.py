"""Small gradient-boosted trees over integer features: fitted on a bounded sample, applied as a SQL expression."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic loss, exact splits, Newton leaves. ``trees`` nest (feature, threshold, left, right) or hold a value."""

    rounds: int = 30
    depth: int = 3
    rate: float = 0.3
    l2: float = 1.0
    min_leaf: int = 8
    base: float = 0.0
    trees: list = field(default_factory=list)
    #: Platt scaling of the summed score: probability = sigmoid(a * score + b).
    a: float = 1.0
    b: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(round(-self.rate * g / (h + self.l2), 6))
        if depth == 0 or len(rows) < 2 * self.min_leaf:
            return leaf
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, gl, hl = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= self.min_leaf) & (len(rows) - at - 1 >= self.min_leaf)]
            if len(at):
                gain = gl[at] ** 2 / (hl[at] + self.l2) + (g - gl[at]) ** 2 / (h - hl[at] + self.l2) - g**2 / (h + self.l2)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = float(gain[k]), f, int(v[at[k]])
        _, f, t = best
        if f is None:
            return leaf
        left = x[rows, f] <= t
        return f, t, self._grow(x, grad, hess, rows[left], depth - 1), self._grow(x, grad, hess, rows[~left], depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, t, left, right = tree
        return np.where(x[:, f] <= t, self._apply(left, x), self._apply(right, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum(self._apply(t, x) for t in self.trees)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        """Platt scaling on rows not used to fit, by Newton steps with a little shrinkage."""
        s = self.score(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            gradient = np.array([((p - y) * s).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
            hessian = np.array([[(w * s * s).sum() + 0.1, (w * s).sum()], [(w * s).sum(), w.sum() + 0.1]])
            da, db = np.linalg.solve(hessian, gradient)
            a, b = a - da, b - db
        self.a, self.b = float(round(a, 6)), float(round(b, 6))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * self.score(x) + self.b)))

    def sql(self, names: list[str]) -> str:
        """The calibrated probability as a SQL expression over feature expressions."""

        def one(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            f, t, left, right = tree
            return f"if({names[f]} <= {t}, {one(left)}, {one(right)})"

        total = " + ".join([f"{self.base!r}D", *map(one, self.trees)])
        return f"1D / (1D + exp(-({self.a!r}D * ({total}) + {self.b!r}D)))"
