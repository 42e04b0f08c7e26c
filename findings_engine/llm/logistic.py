"""A small logistic regression for bounded training sets on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def sums(model: Logistic, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows the gradient of the log-likelihood at the model's weights, and minus its second derivative."""
    z = np.hstack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(z @ model.weights, -30, 30)))
    return z.T @ (y - p), (z.T * np.maximum(p * (1 - p), 1e-6)) @ z


def newton_step(weights: np.ndarray, of: list[np.ndarray], ridge: float = 1.0) -> np.ndarray:
    """The weights after a step from the rows' sums."""
    penalty = np.append(np.full(len(weights) - 1, ridge), 1e-6)
    gradient, hessian = of
    return weights + np.clip(np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * weights), -4, 4)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 40) -> Logistic:
    """Newton steps on standardised features. Without both labels the constant rate, smoothed."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    weight = np.ones(len(y)) if weight is None else weight
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    scale = x.std(axis=0) if len(x) else np.ones(x.shape[1])
    scale = np.where(scale > 1e-9, scale, 1.0)
    w = np.zeros(x.shape[1] + 1)
    rate = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    w[-1] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return Logistic(mean, scale, w)
    z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = weight * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z.T * slope) @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)
