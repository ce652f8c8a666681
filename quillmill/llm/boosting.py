"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees' nodes one after another; a leaf is its own child, so scoring is depth equal steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.bias)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.bias + self.value[at].sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def constant(p: float) -> Trees:
    """The model of no or one-sided labels."""
    none = np.zeros(0, np.int64)
    p = min(max(p, 1e-6), 1 - 1e-6)
    return Trees(none, none.astype(np.float32), none, none, none.astype(float), none, 0, float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0, signs: np.ndarray | None = None) -> Trees:
    """Logistic loss, second order. signs: for each feature +1 or -1 where the margin may only rise or fall with it, else 0.

    A split that breaks a sign is not taken, and the midpoint of its children's values bounds
    all that lie below them, so each tree, hence the sum, is monotonic. least: the least sum of
    second derivatives in a child.
    """
    n, m = x.shape
    if n == 0 or y.min() == y.max():
        return constant(float(y.mean()) if n else 0.5)
    signs = np.zeros(m, int) if signs is None else np.asarray(signs)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
    code = np.column_stack([np.searchsorted(edges[f], x[:, f], "left") for f in range(m)])  # code <= b means x <= edges[b]
    flat = code + np.arange(m) * bins
    bias = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(n, bias)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    for _ in range(trees):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        total = {0: (g.sum(), h.sum())}
        best = lambda G, H, lo, hi: min(max(-G / (H + l2), lo), hi)
        ids = [leaf(best(*total[0], -np.inf, np.inf))]
        roots.append(ids[0])
        bounds = [(-np.inf, np.inf)]
        for _ in range(depth):
            k = len(ids)
            live = np.flatnonzero(node >= 0)
            if not len(live):
                break
            at = (node[live, None] * (m * bins) + flat[live]).ravel()
            hg = np.bincount(at, np.repeat(g[live], m), k * m * bins).reshape(k, m, bins).cumsum(2)
            hh = np.bincount(at, np.repeat(h[live], m), k * m * bins).reshape(k, m, bins).cumsum(2)
            G, H = hg[:, :1, -1:], hh[:, :1, -1:]
            lo, hi = (np.array([b[i] for b in bounds])[:, None, None] for i in (0, 1))
            wl, wr = np.clip(-hg / (hh + l2), lo, hi), np.clip(-(G - hg) / (H - hh + l2), lo, hi)
            obj = lambda G, H, w: -(G * w + 0.5 * (H + l2) * w * w)
            gain = obj(hg, hh, wl) + obj(G - hg, H - hh, wr) - obj(G, H, np.clip(-G / (H + l2), lo, hi))
            bad = (hh < least) | (H - hh < least) | (signs[None, :, None] * (wr - wl) < 0)
            gain = np.where(bad, -np.inf, gain).reshape(k, -1)
            pick = gain.argmax(axis=1)
            new_ids, new_bounds = [], []
            child = np.full((k, 2), -1)
            cut = np.zeros((k, 2), np.int64)
            for i in range(k):
                f, b = divmod(int(pick[i]), bins)
                if gain[i, pick[i]] <= 1e-6 or b >= len(edges[f]):
                    continue
                a, c = float(wl[i, f, b]), float(wr[i, f, b])
                mid, (blo, bhi) = (a + c) / 2, bounds[i]
                s = signs[f]
                low, high = ((blo, mid), (mid, bhi)) if s > 0 else ((mid, bhi), (blo, mid)) if s < 0 else (bounds[i], bounds[i])
                me = ids[i]
                feature[me], threshold[me] = f, edges[f][b]
                left[me], right[me] = leaf(a), leaf(c)
                child[i], cut[i] = (len(new_ids), len(new_ids) + 1), (f, b)
                new_ids += [left[me], right[me]]
                new_bounds += [low, high]
            on = node[live]
            went = code[live, cut[on, 0]] > cut[on, 1]
            node[live] = np.where(child[on, 0] < 0, -1, child[on, 0] + went)
            ids, bounds = new_ids, new_bounds
            if not ids:
                break
        value[roots[-1] :] = [rate * v for v in value[roots[-1] :]]
        one = Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), depth, 0.0)
        margin += one.margin(x)
    return Trees(np.array(feature, np.int64), np.array(threshold, np.float32), np.array(left, np.int64), np.array(right, np.int64), np.array(value), np.array(roots, np.int64), depth, bias)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values of a step function, for step()."""
    if not len(score):
        return np.zeros(0), np.zeros(0)
    x, at = np.unique(score, return_inverse=True)
    total, weight = np.bincount(at, y), np.bincount(at).astype(float)
    stack: list[list[float]] = []
    for k, t, w in zip(x, total, weight, strict=True):
        stack.append([k, t, w])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            _, t1, w1 = stack.pop()
            stack[-1][1] += t1
            stack[-1][2] += w1
    return np.array([s[0] for s in stack]), np.array([s[1] / s[2] for s in stack])


def step(knots: np.ndarray, values: np.ndarray, score: np.ndarray) -> np.ndarray:
    return values[np.maximum(np.searchsorted(knots, score, "right") - 1, 0)] if len(knots) else score
