"""Fitting small linear models on bounded samples."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Coefficients and intercept by Newton steps with a ridge on the coefficients; y may hold probabilities.

    Without rows, or with labels all alike, the coefficients are 0 and the intercept is the smoothed log odds.
    """
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    total = weight.sum()
    base = float(np.log((weight @ y + 0.5) / (total - weight @ y + 0.5))) if n else 0.0
    beta = np.zeros(d + 1)
    beta[-1] = base
    if not n or y.min() == y.max():
        return beta[:-1], base
    full = np.hstack([x, np.ones((n, 1))]).astype(np.float64)
    penalty = np.full(d + 1, float(ridge))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(full @ beta)
        slope = full.T @ (weight * (p - y)) + penalty * beta
        curve = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_sparse(features: np.ndarray, offsets: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 8, steps: int = 8) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a logistic regression on rows whose features, offsets[i] to offsets[i + 1], have value scale.

    Newton steps, each solved by a few rounds of conjugate gradients, so that no matrix of features is ever formed.
    """
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(offsets))
    some = np.flatnonzero(np.diff(offsets) > 0)

    def times(w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        if len(some):
            out[some] = np.add.reduceat((w * scale)[features], offsets[:-1][some])
        return out

    def back(u: np.ndarray) -> np.ndarray:
        return np.bincount(features, weights=u[row], minlength=len(scale)) * scale

    w, bias = np.zeros(len(scale)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for _ in range(rounds):
        p = sigmoid(times(w) + bias)
        slope, slope_b = back(p - y) + ridge * w, float((p - y).sum())
        curve = np.maximum(p * (1 - p), 1e-4)
        move, move_b = np.zeros(len(scale)), 0.0
        left, left_b = -slope, -slope_b
        way, way_b = left.copy(), left_b
        norm = start = left @ left + left_b * left_b
        for _ in range(steps):
            u = curve * (times(way) + way_b)
            bent, bent_b = back(u) + ridge * way, float(u.sum())
            length = norm / (way @ bent + way_b * bent_b)
            move, move_b = move + length * way, move_b + length * way_b
            left, left_b = left - length * bent, left_b - length * bent_b
            now = left @ left + left_b * left_b
            if now < 1e-8 * start:
                break
            way, way_b, norm = left + now / norm * way, left_b + now / norm * way_b, now
        far = np.abs(times(move) + move_b).max(initial=1e-12)
        part = min(1.0, 8.0 / far)
        w, bias = w + part * move, bias + part * move_b
        if part * far < 1e-3:
            break
    return w, bias
