"""Logistic regression with a ridge penalty, by Newton's method."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)) without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights for columns of ``x`` and, last, the intercept (not penalised)."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (p - y) + penalty @ w)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w
