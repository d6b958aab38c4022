"""FTRL-proximal logistic regression over hashed sparse features (per-coordinate rates, L1)."""

from __future__ import annotations

import numpy as np

BITS = 20


class Ftrl:
    """Online learner; a weight is zero until its gradient sum outgrows the L1 penalty."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, size

    def weights(self, idx: np.ndarray) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        l1 = np.where(idx == self.bias, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, idx: np.ndarray, value, target: float) -> None:
        idx = np.append(idx, self.bias)
        value = np.append(np.broadcast_to(value, len(idx) - 1), 1.0)
        w = self.weights(idx)
        g = (sigmoid(float(w @ value)) - target) * value
        n = self.n[idx]
        self.z[idx] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[idx] = n + g * g

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """The features with a weight, and their weights; the bias has the index `size`."""
        used = np.flatnonzero(self.n)
        w = self.weights(used)
        return used[w != 0], w[w != 0]


def dense(pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The weights of compact (feature, weight) pairs as an array, bias last."""
    w = np.zeros((1 << BITS) + 1)
    w[pairs[0]] = pairs[1]
    return w


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
