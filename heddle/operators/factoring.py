"""Singular values and directions of tall matrices by a tree of QR factors.

A task keeps the triangular factor of its own rows.  Factors are rows themselves, so they are brought together and
factored again, ``FAN`` tasks' at a time, until one is left.  Unlike a Gram matrix this doesn't square the matrix's condition: small
singular values keep their digits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from heddle.operators.tensors import _signed

FAN = 8


def triangle(rows: DataFrame, width: int, unfold=None, *, column: str = "x", fan: int = FAN) -> np.ndarray:
    """The triangular factor of the matrix whose rows are the column's arrays; ``unfold`` makes rows of a batch of arrays.

    An empty matrix has a factor without rows.  No task holds more than two factors and a batch.
    """

    def factor(unfold):
        def task(frames):
            import pandas as pd

            r = np.zeros((0, width))
            for f in frames:
                if len(f):
                    x = np.stack(f["x"].to_numpy()).astype(np.float64)
                    x = unfold(x) if unfold else x
                    for at in range(0, len(x), max(width, 4096)):
                        r = np.linalg.qr(np.concatenate([r, x[at : at + max(width, 4096)]]), mode="r")
            yield pd.DataFrame({"x": pd.Series(list(r), dtype=object)})

        return task

    tasks = rows.rdd.getNumPartitions()
    parts = rows.select(rows[column].cast("array<double>").alias("x")).mapInPandas(factor(unfold), "x array<double>")
    while tasks > 1:
        tasks = math.ceil(tasks / fan)
        parts = parts.coalesce(tasks) if tasks * fan <= 64 else parts.repartition(tasks)
        parts = parts.mapInPandas(factor(None), "x array<double>")
    found = parts.collect()  # a factor: the width squared
    return np.array([r["x"] for r in found]) if found else np.zeros((0, width))


def singular(rows: DataFrame, width: int, unfold=None, *, column: str = "x") -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular directions (columns) of the matrix."""
    _, values, right = np.linalg.svd(triangle(rows, width, unfold, column=column), full_matrices=False)
    return values, _signed(right.T)


def unfolding(shape: tuple[int, ...], mode: int):
    """Makes the rows of a mode's unfolding, transposed, of a batch of packed tensors."""
    return lambda x: np.moveaxis(x.reshape(-1, *shape), mode + 1, -1).reshape(-1, shape[mode])


def factors(train: DataFrame, shape: tuple[int, ...], ranks: tuple[int, ...]) -> list[np.ndarray]:
    """A factor for each mode of the packed tensors x, as ``tensors.tucker``, by singular value decompositions of the unfoldings."""
    return [singular(train, n, unfolding(shape, mode))[1][:, :r] for mode, (n, r) in enumerate(zip(shape, ranks, strict=True))]
