"""Whether two subspaces share directions: against chance, by draws in parallel, and against two halves of one stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import tensors


def random_pairs(spark: SparkSession, size: int, rank: int, draws: int, *, seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """(draw, shared, largest, mean): shared directions, largest and mean cosine of two random subspaces, by the draw's own seed."""

    def task(frames):
        import pandas as pd

        for f in frames:
            out = []
            for draw in f["id"].tolist():
                rng = np.random.default_rng([seed, draw])
                cosines = tensors.principal_angles(rng.standard_normal((size, rank)), rng.standard_normal((size, rank)))
                out.append((draw, tensors.shared_directions(cosines, threshold), float(cosines.max(initial=0)), float(cosines.mean())))
            yield pd.DataFrame(out, columns=["draw", "shared", "largest", "mean"])

    return spark.range(draws).mapInPandas(task, "draw long, shared int, largest double, mean double")


def chance(spark: SparkSession, size: int, rank: int, draws: int = 1000, *, seed: int = 42, threshold: float = 0.5) -> dict[str, float]:
    """Median, 0.025 and 0.975 quantiles of the directions that random subspaces share."""
    shares = {"lo": 0.025, "mid": 0.5, "hi": 0.975}
    row = random_pairs(spark, size, rank, draws, seed=seed, threshold=threshold).agg(*[F.percentile("shared", p).alias(n) for n, p in shares.items()]).first()  # one row
    return row.asDict()


def verdict(shared: float, null_hi: float, halves: float) -> str:
    """``orthogonal``: no more than chance; ``complementary``: more, but fewer than two halves of one stream; else ``redundant``."""
    if shared <= null_hi:
        return "orthogonal"
    return "complementary" if shared < halves else "redundant"


def compared(one: DataFrame, two: DataFrame, halves: tuple[DataFrame, DataFrame], folds: DataFrame, k: int, shapes: tuple[tuple[int, int], tuple[int, int], tuple[int, int]], rank: int, *, draws: int = 1000, seed: int = 42, threshold: float = 0.5) -> dict:
    """Shared channel directions of two streams (prompt_id, x) and of two halves of one, means over the folds' training rows, and the verdict.

    ``shapes`` are layers and channels of one, two and the halves; one and two have as many channels.
    """
    tables = [t.join(folds, "prompt_id") for t in (one, two, *halves)]
    sizes = [*shapes, shapes[2]]
    each, within = [], []
    for i in range(k):
        u = [tensors.tucker(t.where(F.col("fold") != i), shape, (1, rank))[1] for t, shape in zip(tables, sizes, strict=True)]
        each.append(tensors.shared_directions(tensors.principal_angles(u[0], u[1]), threshold))
        within.append(tensors.shared_directions(tensors.principal_angles(u[2], u[3]), threshold))
    null = chance(one.sparkSession, shapes[0][1], rank, draws, seed=seed, threshold=threshold)
    shared, same = float(np.mean(each)), float(np.mean(within))
    return {"shared": shared, "halves": same, "null_lo": null["lo"], "null_mid": null["mid"], "null_hi": null["hi"], "verdict": verdict(shared, null["hi"], same)}
