"""Small linear models, fitted on the driver on bounded samples; deterministic."""

from __future__ import annotations

import numpy as np


def _descend(x: np.ndarray, slope, penalty: float, steps: int) -> np.ndarray:
    """In the precision of x: accelerated gradient descent on mean loss + penalty / 2 * |w|^2; the last column of x is 1."""
    n, w = len(x), np.zeros(x.shape[1], x.dtype)
    y, t = w, 1.0
    rate = x.dtype.type(1.0 / (0.25 * _largest(x) / n + penalty))
    for _ in range(steps):
        ahead = y - rate * (slope(x @ y).astype(x.dtype) @ x / n + penalty * np.append(y[:-1], 0.0).astype(x.dtype))
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, w, t = ahead + x.dtype.type((t - 1) / t_next) * (ahead - w), ahead, t_next
    return w


def _largest(x: np.ndarray, rounds: int = 15) -> float:
    """The largest eigenvalue of x'x, by power iteration."""
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(rounds):
        v = (x @ (v / np.linalg.norm(v))) @ x
    return float(np.linalg.norm(v)) * 1.1


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 200) -> np.ndarray:
    """Weights, the intercept last. With one class only, the intercept alone says so."""
    if y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), 10.0 if y[0] else -10.0)
    return _descend(with_one(x), lambda z: sigmoid(z) - y, penalty, steps)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 120) -> np.ndarray:
    """Linear support vector machine with squared hinge loss (an eighth of it, so that its curvature is logistic's)."""
    side = np.where(y > 0, 1.0, -1.0)
    return _descend(with_one(x), lambda z: -0.25 * side * np.maximum(0, 1 - side * z), penalty, steps)
