"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, and flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf points to itself, so every row takes ``depth`` steps in every tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.empty(len(x))
        for at in range(0, len(x), block):
            part = x[at : at + block]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + block] = self.base + self.value[node].sum(1)
        return 1 / (1 + np.exp(-out))


def _best_split(grad, hess, monotone, low, high, l2, least):
    """Best (gain, feature, bin, left value, right value) over histograms ``(features, bins)``."""
    g_left, h_left = grad.cumsum(1)[:, :-1], hess.cumsum(1)[:, :-1]
    g, h = grad[0].sum(), hess[0].sum()
    g_right, h_right = g - g_left, h - h_left
    v_left = np.clip(-g_left / (h_left + l2), low, high)
    v_right = np.clip(-g_right / (h_right + l2), low, high)

    def loss(gs, hs, vs):
        return gs * vs + 0.5 * (hs + l2) * vs * vs

    whole = np.clip(-g / (h + l2), low, high)
    gain = loss(g, h, whole) - loss(g_left, h_left, v_left) - loss(g_right, h_right, v_right)
    against = monotone[:, None] * (v_right - v_left) < 0
    gain = np.where(against | (h_left < least) | (h_right < least), -np.inf, gain)
    at = np.unravel_index(np.argmax(gain), gain.shape)
    return gain[at], *at, v_left[at], v_right[at]


def train_forest(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 2.0
) -> Forest:
    """Boost ``rounds`` trees on the logistic loss.

    ``monotone`` has 1, -1 or 0 per feature: the score must not fall, must not rise,
    or is free as the feature grows. A split that goes against its feature is
    refused, and the children's values are bounded by the middle of the split, which
    keeps the order through all later splits.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        for column, start in ((feature, 0), (threshold, 0.0), (left, len(left)), (right, len(right)), (value, v)):
            column.append(start)
        return len(value) - 1

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(node(0.0))
        open_ = [(roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while open_:
            at, rows, low, high, level = open_.pop()
            if level == depth:
                continue
            own = binned[rows]
            g = np.stack([np.bincount(own[:, f], grad[rows], bins) for f in range(x.shape[1])])
            h = np.stack([np.bincount(own[:, f], hess[rows], bins) for f in range(x.shape[1])])
            gain, f, cut, v_left, v_right = _best_split(g, h, monotone, low, high, l2, least)
            if not gain > 1e-9:
                continue
            feature[at], threshold[at] = int(f), float(edges[f][cut])
            left[at], right[at] = node(v_left), node(v_right)
            middle, goes = (v_left + v_right) / 2, own[:, f] <= cut
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[f])]
            open_.append((left[at], rows[goes], *bounds[0], level + 1))
            open_.append((right[at], rows[~goes], *bounds[1], level + 1))
        for at in range(roots[-1], len(value)):
            value[at] *= rate
        tree = Forest(*[np.array(c) for c in (feature, threshold, left, right, value)], np.array(roots[-1:]), depth, 0.0)
        score = np.clip(tree.score(x), 1e-12, 1 - 1e-12)
        margin = margin + np.log(score / (1 - score))
    return Forest(*[np.array(c) for c in (feature, threshold, left, right, value)], np.array(roots), depth, base)
