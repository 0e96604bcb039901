"""Conditions: streams put together, shared directions taken out, and what paired differences say of them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import ranking, tensors


def joined_channels(a: Column, b: Column, channels: int) -> Column:
    """Two packed tensors of the same layers, layer by layer: the channels of a, then those of b."""
    layer = lambda x, i: F.slice(x, i * channels + 1, F.lit(channels))
    layers = F.sequence(F.lit(0), (F.size(a) / channels).cast("int") - 1)
    return F.flatten(F.transform(layers, lambda i: F.concat(layer(a, i), layer(b, i))))


def joined_layers(a: Column, b: Column) -> Column:
    """Two packed tensors of the same channels, one above the other."""
    return F.concat(a, b)


def overlap(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """How many distinct keys stand on both sides."""
    both = one.select(key).where(F.col(key).isNotNull()).distinct().join(two.select(key), key, "left_semi")
    return both.agg(F.count("*").alias("n_both"))


def verdict(deltas: DataFrame) -> DataFrame:
    """By condition, from deltas (mean, excludes_zero) on several datasets: any significant loss outweighs any win."""
    win, loss = F.col("excludes_zero") & (F.col("mean") > 0), F.col("excludes_zero") & (F.col("mean") < 0)
    each = deltas.groupBy("condition").agg(F.sum(win.cast("int")).cast("long").alias("wins"), F.sum(loss.cast("int")).cast("long").alias("losses"))
    return each.withColumn("verdict", F.when(F.col("losses") > 0, "worse").when(F.col("wins") > 0, "better").otherwise("same"))


def adopted(deltas: DataFrame) -> DataFrame:
    """By condition: adopted where it improves significantly somewhere and loses significantly nowhere."""
    return verdict(deltas).select("condition", ((F.col("wins") > 0) & (F.col("losses") == 0)).alias("adopt"))


def without_common(rows: DataFrame, train: DataFrame, k: int, layers: int, *, column: str = "features") -> DataFrame:
    """Takes, in every layer on its own, the k leading principal directions of the training rows out of every row, which isn't centred."""
    width = len(train.select(column).first()[0]) // layers
    layer = lambda i: F.slice(column, i * width + 1, F.lit(width))
    directions = np.zeros((layers, width, min(k, width)))
    for i in range(layers):
        n, first, second = tensors.moments(train.select(layer(i).alias("part")), "part")
        mean = first / max(1, n)
        values, vectors = np.linalg.eigh(second / max(1, n) - np.outer(mean, mean))
        directions[i] = vectors[:, np.argsort(-values)[:k]]
    return tensors.without_directions(rows, directions, column)


def fused_residual(rows: DataFrame, train: DataFrame, base: str, *, column: str = "features", name: str = "fused") -> DataFrame:
    """Adds ``name``: the base, then what a least-squares fit on it, from training rows and with an intercept, leaves of the
    column, scaled by the mean and deviation of what it leaves of the training rows.  A number of which nothing but rounding is left gives 0."""
    both = lambda d: d.withColumn("_both", F.concat(base, column))
    n, first, second = tensors.moments(both(train), "_both")
    size = len(train.select(base).first()[0])
    mean = first / max(1, n)
    cov = second / max(1, n) - np.outer(mean, mean)
    w = np.linalg.lstsq(cov[:size, :size], cov[:size, size:], rcond=None)[0]
    keep = np.concatenate([-w, np.eye(len(mean) - size)])
    rest = np.maximum(np.diag(keep.T @ cov @ keep), 0)
    some = rest > 1e-13 * np.diag(second)[size:] / max(1, n)  # what the moments can tell from nothing
    keep = np.where(some, keep / (np.sqrt(rest) + 1e-8), 0)
    matrix = np.concatenate([np.eye(len(mean))[:, :size], keep], axis=1)
    shift = np.concatenate([np.zeros(size), -(mean @ keep)])
    return tensors.times(both(rows), matrix, shift, "_both", name).drop("_both")


def not_negative(deltas: DataFrame) -> DataFrame:
    """The components whose mean paired difference isn't below zero."""
    return deltas.where("mean >= 0").select("condition")


def _compared(rows: DataFrame, pairs: list[tuple[str, str]], reps: int, seed: int) -> DataFrame:
    return ranking.paired_deltas(rows, pairs, [False, True], reps=reps, seed=seed)


def against(rows: DataFrame, new: list[str], baselines: list[str], *, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Every new condition's scores (columns) against every baseline's, pooled and within prompts, on the same draws.  Fails where a condition is missing."""
    missing = [c for c in [*new, *baselines] if c not in rows.columns]
    if missing:
        raise ValueError(f"missing conditions: {', '.join(missing)}")
    return _compared(rows, [(a, b) for a in new for b in baselines], reps, seed)


def replayed(rows: DataFrame, windows: list[str], *, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Scores from several windows (columns), each compared with each later one."""
    return _compared(rows, list(combinations(windows, 2)), reps, seed)
