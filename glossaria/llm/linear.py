"""Logistic regression, calibration and bounded samples, shared by the classifiers of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 150, rate: float = 0.3, start: np.ndarray | None = None) -> np.ndarray:
    """Weights (last one the intercept) by full-batch Adam on the weighted log loss."""
    n, d = x.shape
    w = np.zeros(d + 1) if start is None else start.copy()
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    m = np.zeros(d + 1)
    v = np.zeros(d + 1)
    for t in range(1, steps + 1):
        r = weight * (sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y)
        g = np.append(r.astype(x.dtype) @ x + l2 * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn a score into a calibrated logit; targets are smoothed by class size."""
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * score + b)
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        h = p * (1 - p)
        k = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(k, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def sampled(key: Column, n: int, bound: int, seed: int) -> Column:
    """True for about min(n, bound) of n keys, by hash: the same keys at every run."""
    share = 1.0 if n <= bound else bound / n
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int, seed: int = 23) -> DataFrame:
    """Rows of docs with `target` (0 or 1) for about `bound` labelled doc_ids at most.

    A doc_id with several labels has the smallest quality and the greatest toxicity. The ids are sampled by hash at a rate
    that gives `bound` of them, so they are the broadcast side.
    """
    pick = F.max if column == "toxic" else F.min
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(pick(column).cast("int").alias("target"))
    n = one.count()
    ids = one.where(sampled(F.col("doc_id"), n, bound, seed))
    return docs.where("text is not null").join(F.broadcast(ids.select(F.col("doc_id").alias("__id"), "target")), F.col("doc_id") == F.col("__id")).drop("__id")
