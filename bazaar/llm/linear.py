"""Small logistic regressions fitted on the driver over bounded, already collected samples."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2,
                 steps: int = 60) -> np.ndarray:
    """Newton fit of a dense design (last column: intercept, not penalised); soft targets allowed."""
    n, d = x.shape
    w = np.ones(n) if weight is None else weight
    beta = np.zeros(d)
    penalty = np.full(d, ridge * n / 100.0 + 1e-6)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ beta)
        grad = x.T @ (w * (y - p)) - penalty * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        norm = np.abs(step).max()
        beta += step if norm <= 4 else step * (4 / norm)
        if norm < 1e-8:
            break
    return beta


def sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * np.asarray(z, dtype=float)))


def fit_platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of a one-variable logistic calibration with smoothed targets."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    beta = fit_logistic(np.column_stack([score, np.ones(len(score))]), target, ridge=1e-6)
    return float(beta[0]), float(beta[1])
