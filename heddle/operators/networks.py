"""A perceptron with one hidden layer, trained by gradients that are added up over all tasks at each step.

Parameters are never averaged: every step takes the exact gradient of the loss over all training rows, so the result doesn't
depend on how rows are dealt to tasks.  The models of all folds take their steps together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import sums
from heddle.sources.scratch import stored


@dataclass
class Network:
    """Standard scores of the training rows, a hidden layer of rectified units, and one output."""

    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray
    hidden: int

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        d, h = len(self.mean), self.hidden
        return self.theta[: d * h].reshape(d, h), self.theta[d * h : d * h + h], self.theta[d * h + h : -1], self.theta[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        w, b, v, a = self.parts()
        return 1 / (1 + np.exp(-np.clip(np.maximum(((x - self.mean) * self.scale) @ w + b, 0) @ v + a, -500, 500)))


def loss_and_gradient(net: Network, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed cross-entropy of rows and its gradient: one number, then one for each parameter."""
    w, b, v, a = net.parts()
    z = (x - net.mean) * net.scale
    inner = z @ w + b
    active = np.maximum(inner, 0)
    s = np.clip(active @ v + a, -500, 500)
    loss = np.logaddexp(0, s) - y * s
    ds = 1 / (1 + np.exp(-s)) - y
    dh = ds[:, None] * v * (inner > 0)
    return np.concatenate([[loss.sum()], (z.T @ dh).ravel(), dh.sum(0), active.T @ ds, [ds.sum()]])


def _array(f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(f["x"].to_numpy()), f["y"].to_numpy(), f["fold"].to_numpy()


def fitted(rows: DataFrame, k: int, *, hidden: int = 128, steps: int = 100, rate: float = 0.02, decay: float = 3e-4, clip: float = 1.0, seed: int = 42) -> tuple[list[Network], list[list[float]]]:
    """A network for each fold of rows (x, y, fold), trained on the others, and each one's losses by step.

    Adam with a cosine schedule, weight decay and clipped gradients; with k = 1 and no row in fold 0 it is one network of all rows.
    """
    rows = rows.select("x", "y", "fold")
    d = len(rows.select("x").first()[0])
    both = lambda f: (lambda x, y, fold: np.stack([np.concatenate([[len(t)], t.sum(0)]) for i in range(k) for t in [x[fold != i]]]))(*_array(f))
    found = sums.added(rows, k * (d + 1), both).reshape(k, d + 1)
    n = np.maximum(found[:, 0], 1)
    mean = found[:, 1:] / n[:, None]
    spread = lambda f: (lambda x, y, fold: np.stack([((x[fold != i] - mean[i]) ** 2).sum(0) for i in range(k)]))(*_array(f))
    deviation = np.sqrt(sums.added(rows, k * d, spread).reshape(k, d) / n[:, None])
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
    rng = np.random.default_rng(seed)
    start = np.concatenate([rng.uniform(-1, 1, d * hidden) / np.sqrt(d), rng.uniform(-1, 1, hidden) / np.sqrt(d), rng.uniform(-1, 1, hidden + 1) / np.sqrt(hidden)])
    nets = [Network(mean[i], scale[i], start.copy(), hidden) for i in range(k)]
    first, second, losses = np.zeros((k, len(start))), np.zeros((k, len(start))), [[] for _ in range(k)]
    for step in range(steps):

        def part(f, nets=nets):
            x, y, fold = _array(f)
            return np.stack([loss_and_gradient(net, x[fold != i], y[fold != i]) for i, net in enumerate(nets)])

        got = sums.added(rows, k * (1 + len(start)), part).reshape(k, -1) / n[:, None]
        now = rate * (1 + np.cos(np.pi * step / steps)) / 2
        for i, net in enumerate(nets):
            losses[i].append(float(got[i, 0]))
            g = got[i, 1:] + decay * net.theta
            g *= min(1.0, clip / (np.linalg.norm(g) + 1e-12))
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            net.theta = net.theta - now * (first[i] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[i] / (1 - 0.999 ** (step + 1))) + 1e-8)
    return nets, losses


def scored(rows: DataFrame, nets: list[Network]) -> DataFrame:
    """Adds ``score`` to rows (x, fold), the probability of y = 1 by their fold's network."""

    @F.pandas_udf("double")
    def score(x, fold):
        import pandas as pd

        out = np.zeros(len(x))
        for i, net in enumerate(nets):
            own = fold.to_numpy() == i
            if own.any():
                out[own] = net.probability(np.stack(x[own].to_numpy()))
        return pd.Series(out)

    return rows.withColumn("score", score("x", "fold"))


def out_of_fold(rows: DataFrame, folds: DataFrame, k: int, **options) -> DataFrame:
    """Each row (features) scored by the network of the other folds: the columns of rows without features, fold and score."""
    dealt = stored(rows.join(folds, "prompt_id").withColumn("x", F.col("features").cast("array<double>")), name="dealt")
    return scored(dealt, fitted(dealt, k, **options)[0]).drop("x", "features")
