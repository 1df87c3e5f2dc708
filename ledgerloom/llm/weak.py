"""Weak supervision on vote patterns: labelers vote, expectation-maximisation weighs them, a classifier decides.

Everything works on counts of distinct vote patterns. Their number is bounded by the number of labelers, not by
the data, so counts over all rows fit the driver and nothing is sampled.
"""

from __future__ import annotations

import numpy as np


def reliabilities(patterns: np.ndarray, counts: np.ndarray, sign: np.ndarray, rounds: int = 30, prior: float = 0.2) -> np.ndarray:
    """Posterior of each pattern (rows of 0/1 votes) by a two-class model of independent labelers.

    ``sign`` is +1 for labelers that speak for the class, +2 for precise ones and -1 for those that speak against
    it. Priors worth ``prior`` of all rows keep the classes from trading places.
    """
    n = counts.sum()
    for_it = np.where(sign > 0, 0.55, 0.02)
    against = np.where(sign > 1, 0.004, np.where(sign > 0, 0.08, 0.45))
    p, q, base = for_it.copy(), against.copy(), 0.5
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        a = np.log(base) + (patterns * np.log(p) + (1 - patterns) * np.log(1 - p)).sum(1)
        b = np.log(1 - base) + (patterns * np.log(q) + (1 - patterns) * np.log(1 - q)).sum(1)
        posterior = 1 / (1 + np.exp(np.clip(b - a, -50, 50)))
        w, v, k = counts * posterior, counts * (1 - posterior), prior * n
        p = np.clip((w @ patterns + k * for_it) / (w.sum() + k), 1e-3, 1 - 1e-3)
        q = np.clip((v @ patterns + k * against) / (v.sum() + k), 1e-3, 1 - 1e-3)
        base = np.clip((w.sum() + 0.5 * k) / (n + k), 0.02, 0.98)
    return posterior


def classifier(features: np.ndarray, counts: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft targets, by Newton steps over weighted patterns."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    scale = counts / max(1.0, counts.sum()) * 1000
    for _ in range(rounds):
        y = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (scale * (y - target)) + ridge * w
        hess = (x * (scale * y * (1 - y))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def decide(patterns: list[int], counts: list[int], sign: list[int], threshold: float = 0.5) -> dict[int, float]:
    """Probability of each pattern (bits of votes, least bit first) after both steps; bits of sign 0 are no votes but
    features, which the classifier sees only."""
    if not patterns:
        return {}
    bits = np.array([[p >> i & 1 for i in range(len(sign))] for p in patterns], dtype=float)
    n = np.array(counts, dtype=float)
    vote = np.array(sign) != 0
    posterior = reliabilities(bits[:, vote], n, np.array(sign)[vote])
    w = classifier(bits, np.sqrt(n), posterior)
    y = 1 / (1 + np.exp(-np.clip(np.hstack([bits, np.ones((len(bits), 1))]) @ w, -30, 30)))
    return dict(zip(patterns, y.tolist()))
