"""What the trained classifiers share: an optimiser, calibration, and hashes of words in a batch of texts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Adam:
    """Adam over a dict of arrays, changed in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v, p = self.m[k], self.v[k], self.params[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * ((m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8) + self.decay * p)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of sigmoid(a x + b) by Newton steps, with targets drawn in a little and a small penalty on a."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(x).max(initial=0.0)), 1e-9)
    f = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(f @ w)
        g = f.T @ (p - t) + np.array([1e-3, 0]) * w
        h = (f * (p * (1 - p))[:, None]).T @ f + np.diag([1e-3, 1e-6])
        w -= np.clip(np.linalg.solve(h, g), -5, 5)
    return float(w[0] / scale), float(w[1])


def base_rate(y: np.ndarray, taken: tuple[float, float]) -> float:
    """Smoothed share of label 1 among all labels, from a sample that took the shares ``taken`` of label 0 and 1."""
    zeros, ones = (y == 0).sum() / taken[0], (y == 1).sum() / taken[1]
    return float((ones + 0.5) / (zeros + ones + 1))


def prior_shift(taken: tuple[float, float]) -> float:
    """What turns log odds learnt from such a sample into those among all labels."""
    return float(np.log(taken[0]) - np.log(taken[1]))


def runs(count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut each text's words into windows of ``size`` (its last one shorter): text and number of words of each window.

    A text without words has no window.
    """
    n = -(-count // size)
    text = np.repeat(np.arange(len(count)), n)
    words = np.full(len(text), size)
    last = np.cumsum(n)[n > 0] - 1
    words[last] = count[n > 0] - size * (n[n > 0] - 1)
    return text, words


def starts_of(sizes: np.ndarray | Sequence[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
