"""Small boosted trees in numpy, trained on the driver from a bounded sample.

Features are cut into at most `bins` quantile bins; a node takes the split of
largest second-order gain. A feature with constraint +1 or -1 may only raise or
lower the output: splits that break the order are refused, and both sides are
bounded by the midpoint of their values, so the whole tree is monotone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from readloom import ship

ship(__name__)


@dataclass
class Trees:
    """Flattened nodes of all trees: a leaf has feature -1; children are absolute indices."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves reached, for all rows at once: one gather a level."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[rows, np.where(inner, f, 0)] <= self.threshold[at]
                at = np.where(inner, np.where(below, self.left[at], self.right[at]), at)
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15,
        bins: int = 48, ridge: float = 2.0, least: int = 10, monotone: dict[int, int] | None = None,
        seed: int = 7, rows: float = 1.0) -> Trees:
    """Boost logistic loss. An empty sample, or one with one label only, gives a constant."""
    n, m = x.shape
    monotone = monotone or {}
    pos = float(np.clip((y.sum() + 1) / (n + 2), 1e-3, 1 - 1e-3))
    base = float(np.log(pos / (1 - pos)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    f = np.full(n, base)
    rng = np.random.default_rng(seed)

    def node() -> int:
        for arr, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            arr.append(v)
        return len(feature) - 1

    def grow(idx: np.ndarray, level: int, lo: float, hi: float) -> int:
        me = node()
        g, h = grad[idx], hess[idx]
        gt, ht = g.sum(), h.sum()
        value[me] = rate * float(np.clip(-gt / (ht + ridge), lo, hi))
        if level == depth or len(idx) < 2 * least:
            return me
        best = (1e-6, -1, 0, 0.0, 0.0)
        for j in range(m):
            k = len(edges[j]) + 1
            if k < 2:
                continue
            c = code[idx, j]
            gl, hl = np.cumsum(np.bincount(c, g, k))[:-1], np.cumsum(np.bincount(c, h, k))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=k))[:-1]
            gr, hr = gt - gl, ht - hl
            vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
            ok = (nl >= least) & (len(idx) - nl >= least)
            if s := monotone.get(j):
                ok &= s * (vr - vl) >= 0
            if not ok.any():
                continue
            i = int(np.argmax(np.where(ok, gain, -1)))
            if ok[i] and gain[i] > best[0]:
                best = (float(gain[i]), j, i, float(vl[i]), float(vr[i]))
        _, j, i, vl, vr = best
        if j < 0:
            return me
        go = code[idx, j] <= i
        mid = (vl + vr) / 2
        llo, lhi, rlo, rhi = lo, hi, lo, hi
        if s := monotone.get(j):
            llo, lhi, rlo, rhi = (lo, mid, mid, hi) if s > 0 else (mid, hi, lo, mid)
        feature[me], threshold[me] = j, float(edges[j][i])
        left[me] = grow(idx[go], level + 1, llo, lhi)
        right[me] = grow(idx[~go], level + 1, rlo, rhi)
        return me

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            take = np.arange(n) if rows >= 1 else np.flatnonzero(rng.random(n) < rows)
            start = len(feature)
            roots.append(grow(take, 0, -4.0, 4.0))
            part = Trees(np.array([0]), *(np.array(a[start:]) - (start if k in (2, 3) else 0) for k, a in enumerate((feature, threshold, left, right, value)) ), 0.0)
            f = f + part.margin(x)
    return Trees(np.array(roots, int), np.array(feature, int), np.array(threshold), np.array(left, int), np.array(right, int), np.array(value), base)


def paths(t: Trees) -> list[tuple[tuple[int, float, bool], ...]]:
    """Every root-to-node path as a conjunction of (feature, threshold, goes left)."""
    out: list[tuple[tuple[int, float, bool], ...]] = []

    def walk(at: int, so_far: tuple) -> None:
        if so_far:
            out.append(so_far)
        if t.feature[at] >= 0:
            step = (int(t.feature[at]), float(t.threshold[at]))
            walk(int(t.left[at]), (*so_far, (*step, True)))
            walk(int(t.right[at]), (*so_far, (*step, False)))

    for root in t.roots:
        walk(int(root), ())
    return list(dict.fromkeys(out))
