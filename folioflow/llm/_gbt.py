"""Gradient-boosted trees on binned features and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np


def fit_gbt(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> dict:
    """Logistic boosting over complete binary trees; a leaf needs a hessian of `least`."""
    n, m = x.shape
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    width = bins + 1
    flat = binned + np.arange(m) * width
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    score = np.full(n, base)
    feats, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, int)
        feat, cut = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k, at = 2**level, 2**level - 1
            where = (node[:, None] * (m * width) + flat).ravel()
            g = np.bincount(where, np.repeat(grad, m), k * m * width).reshape(k, m, width).cumsum(2)
            h = np.bincount(where, np.repeat(hess, m), k * m * width).reshape(k, m, width).cumsum(2)
            gt, ht = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain = np.where((h >= least) & (ht - h >= least), gain, 0.0)
            for f in range(m):
                gain[:, f, len(edges[f]) :] = 0.0
            best = gain.reshape(k, -1).argmax(1)
            for j in range(k):
                f, b = divmod(int(best[j]), width)
                if gain[j, f, b] > 1e-9:
                    feat[at + j], cut[at + j] = f, edges[f][b]
            node = 2 * node + (x[np.arange(n), feat[at + node]] > cut[at + node])
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        leaf = -rate * g / (h + l2)
        score += leaf[node]
        feats.append(feat)
        cuts.append(cut)
        leaves.append(leaf)
    return {"base": float(base), "depth": depth, "feats": np.array(feats), "cuts": np.array(cuts), "leaves": np.array(leaves)}


def gbt_margin(model: dict, x: np.ndarray) -> np.ndarray:
    rows, out = np.arange(len(x)), np.full(len(x), model["base"])
    for feat, cut, leaf in zip(model["feats"], model["cuts"], model["leaves"], strict=True):
        at = np.zeros(len(x), int)
        for _ in range(model["depth"]):
            at = 2 * at + 1 + (x[rows, feat[at]] > cut[at])
        out += leaf[at - len(feat)]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending scores and the nondecreasing rates there (a rate of 0 or 1 shrinks by one pseudo-row)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, sum of scores
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    rate = y.mean() if len(y) else 0.5
    return np.array([b[2] / b[1] for b in blocks]), np.maximum.accumulate(np.array([(b[0] + rate) / (b[1] + 1) for b in blocks]))


def isotonic(curve: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    """Linear between the curve's points, flat outside them."""
    return np.clip(np.interp(score, *curve), 0.0, 1.0)
