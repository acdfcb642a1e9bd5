"""Linear models fitted on bounded samples with numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    """First-order steps with running moments; one object per parameter vector."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), x.dtype)])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 250, rate: float = 0.08) -> np.ndarray:
    """Weights of an L2-regularised logistic regression over columns of `x` and a bias."""
    x, weight = with_bias(x), (weight / weight.sum()).astype(x.dtype)
    w, rule, y = np.zeros(x.shape[1], x.dtype), Adam(x.shape[1], rate), y.astype(x.dtype)
    for _ in range(steps):
        w -= rule.step(x.T @ (weight * (sigmoid(x @ w) - y)) + l2 * w).astype(x.dtype)
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(with_bias(x) @ w)
