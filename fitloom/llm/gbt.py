"""Histogram gradient-boosted trees, kept as flat arrays and walked with numpy; isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, l2: float = 2.0, least: float = 2.0) -> Trees:
    """Boosted trees for labels 0 and 1.  With one label alone the trees are flat."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, d), np.int64)
    inner, leaves = (1 << depth) - 1, 1 << depth
    p = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-4, 1 - 1e-4)) if n else 0.5
    start = float(np.log(p / (1 - p)))
    features, thresholds, values = [], [], []
    score = np.full(n, start)
    flat = code + np.arange(d) * bins
    for _ in range(trees if n else 0):
        q = sigmoid(score)
        g, h = weight * (y - q), weight * q * (1 - q)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = (flat + ((node - first) * d * bins)[:, None]).reshape(-1)
            shape = (width, d, bins)
            hist_g = np.bincount(at, np.repeat(g, d), width * d * bins).reshape(shape).cumsum(2)
            hist_h = np.bincount(at, np.repeat(h, d), width * d * bins).reshape(shape).cumsum(2)
            all_g, all_h = hist_g[:, :, -1:], hist_h[:, :, -1:]
            right_g, right_h = all_g - hist_g, all_h - hist_h
            gain = hist_g**2 / (hist_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
            gain[(hist_h < least * 0.05) | (right_h < least * 0.05)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    shape = (len(features), inner)
    return Trees(np.array(features, np.int64).reshape(shape), np.array(thresholds, float).reshape(shape), np.array(values, float).reshape(len(values), leaves), start)


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing fit by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted labels, first score, last score
    for s, label, w in zip(score[order], y[order], weight[order], strict=True):
        blocks.append([w, w * label, s, s])
        while len(blocks) > 1 and (blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0] or blocks[-2][3] == blocks[-1][2]):
            w2, l2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + l2, blocks[-1][2], last]
    knots_x = [v for b in blocks for v in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    knots_y = [b[1] / b[0] for b in blocks for _ in range(2 if b[3] > b[2] else 1)]
    return np.array(knots_x), np.array(knots_y)
