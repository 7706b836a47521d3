"""Small gradient-boosted trees: fitted with numpy on the driver, applied as one SQL expression."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss; each tree splits twice.  ``sql`` compiles the model over named columns."""

    def __init__(self, trees: int = 24, rate: float = 0.4):
        self.trees, self.rate, self.base, self.nodes, self.scale = trees, rate, 0.0, [], (1.0, 0.0)

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, where = -np.inf, (0, np.inf)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, gs, hs = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, where = gain[k], (f, round(float(v[at[k]] + v[at[k] + 1]) / 2, 6))
        return where

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Every fourth row is kept back to calibrate the scores."""
        held = np.arange(len(y)) % 4 == 3
        a, b = x[~held], y[~held]
        rate = b.mean()
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(b), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = b - p, p * (1 - p)
            f, t = self._split(a, g, h)
            left = a[:, f] <= t
            tree = [f, t]
            for side in (left, ~left):
                f2, t2 = self._split(a[side], g[side], h[side]) if side.sum() > 20 else (0, np.inf)
                low = side & (a[:, f2] <= t2)
                values = []
                for part in (low, side & ~low):
                    value = round(float(self.rate * g[part].sum() / (h[part].sum() + 1)), 6)
                    score[part] += value
                    values.append(value)
                tree.append((f2, t2, *values))
            self.nodes.append(tree)
        self._calibrate(self.raw(x[held]), y[held])
        return self

    def _calibrate(self, raw: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps."""
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((y - p) * raw).sum() - 0.01 * (a - 1), (y - p).sum()])
            hess = np.array([[(w * raw * raw).sum() + 0.01, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
            a, b = np.array([a, b]) + np.clip(np.linalg.solve(hess, grad), -1, 1)
        self.scale = (round(float(a), 6), round(float(b), 6))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, *sides in self.nodes:
            left = x[:, f] <= t
            for side, (f2, t2, low, high) in zip((left, ~left), sides, strict=True):
                out += np.where(side, np.where(x[:, f2] <= t2, low, high), 0)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.raw(x) + self.scale[1])))

    def threshold(self, x: np.ndarray, y: np.ndarray, precision: float) -> float:
        """The least probability above which the precision on these rows is reached."""
        p = self.probability(x)
        order = np.argsort(-p)
        good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
        return float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0

    def sql(self, features: list[str]) -> str:
        """The calibrated probability as an expression."""

        def test(f: int, t: float) -> str:
            return "true" if t == np.inf else f"{features[f]} <= {t!r}D"

        terms = [f"CASE WHEN {test(f, t)} THEN " + " ELSE ".join(f"CASE WHEN {test(f2, t2)} THEN {low!r}D ELSE {high!r}D END" for f2, t2, low, high in sides) + " END" for f, t, *sides in self.nodes]
        return f"1D / (1D + exp(-({self.scale[0]!r}D * ({self.base!r}D + " + " + ".join(terms) + f") + {self.scale[1]!r}D)))"
