"""Sparse softmax regression trained with follow-the-regularised-leader, and calibration. For bounded samples."""

from __future__ import annotations

import numpy as np


class SoftmaxFTRL:
    """Per-coordinate FTRL-proximal with elastic-net penalties. A row is (indices, values)."""

    def __init__(self, features: int, classes: int, alpha=0.3, beta=1.0, l1=1e-3, l2=1e-3):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)

    def fit(self, rows: list, labels, epochs: int = 4, seed: int = 0) -> SoftmaxFTRL:
        rng, labels = np.random.default_rng(seed), np.asarray(labels)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                at, x = rows[i]
                z, n = self.z[at], self.n[at]
                w = self._weights(z, n)
                p = softmax(x @ w)
                p[labels[i]] -= 1
                g = x[:, None] * p
                self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        return self


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def scores(rows: list, weights: np.ndarray) -> np.ndarray:
    return np.array([x @ weights[at] for at, x in rows]).reshape(len(rows), weights.shape[1])


def temperature(logits: np.ndarray, labels) -> float:
    """The temperature with the least log loss, found on a fine geometric grid; 1 without rows."""
    if not len(logits):
        return 1.0
    labels, grid = np.asarray(labels), np.geomspace(0.02, 20, 200)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def platt(logit: np.ndarray, labels, steps: int = 50, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and offset that calibrate a logit, by Newton's method with a small ridge towards (1, 0)."""
    y, theta = np.asarray(labels, float), np.array([1.0, 0.0])
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (theta - [1.0, 0.0])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(theta[0], 0.0)), float(theta[1])
