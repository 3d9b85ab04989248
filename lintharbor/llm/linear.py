"""Sparse linear models: follow-the-regularised-leader with elastic net, and temperature scaling."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Multinomial logistic regression on sparse rows (indices, values), FTRL-proximal updates."""

    def __init__(self, classes: int, dimension: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((dimension, classes))
        self.n = np.zeros((dimension, classes))

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, index: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(index)
        g = softmax((value[:, None] * w).sum(axis=0))
        g[label] -= 1
        gradient = weight * value[:, None] * g[None, :]
        n = self.n[index]
        grown = n + gradient**2
        self.z[index] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[index] = grown


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, dimension: int,
          epochs: int = 3, seed: int = 7, weights: np.ndarray | None = None, **options) -> np.ndarray:
    """Weights (dimension, classes) after `epochs` passes in a fixed random order."""
    model = Ftrl(classes, dimension, **options)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.update(*rows[i], int(labels[i]), 1.0 if weights is None else float(weights[i]))
    return model.weights()


def logits(rows: list[tuple[np.ndarray, np.ndarray]], w: np.ndarray) -> np.ndarray:
    return np.array([(v[:, None] * w[i]).sum(axis=0) for i, v in rows]).reshape(len(rows), w.shape[1])


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held-back rows, by a grid and one refinement of it."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean())

    grid = np.geomspace(0.05, 20, 41)
    best = min(grid, key=loss)
    return float(min(np.geomspace(best / 1.2, best * 1.2, 21), key=loss))
