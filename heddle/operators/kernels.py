"""Support vector machines with a radial kernel, by random Fourier features.

The kernel exp(-gamma * |a - b|**2) is the expectation of the product of two random cosines, so ``width`` of them, the same for every
row by their seed, turn it into an inner product.  The hinge loss over these is then a linear problem that Spark
solves.  An inner product of features is within e of the kernel with probability 1 - 2 * exp(-width * e**2 / 8).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import sums
from heddle.sources.scratch import stored

WIDTH = 512


def waves(size: int, gamma: float, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (size by width) and phases."""
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (size, width)), rng.uniform(0, 2 * np.pi, width)


def with_waves(rows: DataFrame, frequencies: np.ndarray, phases: np.ndarray, *, column: str = "features", name: str = "waves") -> DataFrame:
    """Adds ``name``: the random Fourier features of the column."""
    scale = np.sqrt(2 / len(phases))

    @F.pandas_udf("array<double>")
    def make(x):
        import pandas as pd

        return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()).astype(np.float64) @ frequencies + phases))) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn(name, make(column))


def scale_gamma(train: DataFrame, column: str = "features") -> float:
    """1 / (numbers of a row * variance of all numbers); 1 where they don't vary."""
    found = sums.added(train.select(F.col(column).cast("array<double>").alias("x")), 3, lambda f: (lambda x: np.array([x.size, x.sum(), (x**2).sum()]))(np.stack(f["x"].to_numpy())))
    size = len(train.select(column).first()[0])
    variance = found[2] / max(found[0], 1) - (found[1] / max(found[0], 1)) ** 2
    return 1 / (size * variance) if variance > 0 else 1.0


def machine(train: DataFrame, rows: DataFrame, *, width: int = WIDTH, gamma: float | None = None, c: float = 1.0, seed: int = 42, linear: bool = False, steps: int = 100) -> DataFrame:
    """Adds ``score``, the decision value of y = 1, to rows (features) by a machine of the training rows (y, features), classes balanced.

    With one class alone the scores are 0.  ``linear`` takes the features as they are.
    """
    counts = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return rows.withColumn("score", F.lit(0.0))
    n = sum(counts.values())
    if linear:
        made = lambda d: d.withColumn("waves", F.col("features").cast("array<double>"))
    else:
        f, p = waves(len(train.select("features").first()[0]), scale_gamma(train) if gamma is None else gamma, width, seed)
        made = lambda d: with_waves(d, f, p)
    vector = lambda d: made(d).withColumn("v", array_to_vector("waves"))
    weight = F.when(F.col("y") == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    model = LinearSVC(featuresCol="v", labelCol="y", weightCol="w", regParam=1 / (c * n), standardization=False, maxIter=steps, tol=1e-8).fit(vector(train.withColumn("w", weight)))
    out = model.transform(vector(rows))
    return out.select(*rows.columns, F.element_at(vector_to_array("rawPrediction"), 2).alias("score"))


def out_of_fold(rows: DataFrame, folds: DataFrame, k: int, **options) -> DataFrame:
    """Each row scored by the machine of the other folds."""
    dealt = stored(rows.join(folds, "prompt_id"), name="dealt")
    return reduce(DataFrame.unionByName, [machine(dealt.where(F.col("fold") != i), dealt.where(F.col("fold") == i), **options) for i in range(k)])
