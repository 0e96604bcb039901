"""Planted answers and tokens, and what must be found in them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import ranking, repeated, scaling

LAYERS, CHANNELS = 9, 32


@pytest.fixture(scope="module")
def answers(spark):
    """120 prompts of ten answers: channels 0-4 follow the prompt, 5-9 the answer, and the label follows both."""
    rng = np.random.default_rng(42)
    rows = []
    for p in range(120):
        d = rng.normal()
        for i in range(10):
            q = rng.normal()
            x = 0.3 * rng.normal(size=(LAYERS, CHANNELS))
            x[:, :5] += d + 0.1 * rng.normal(size=(LAYERS, 5))
            x[:, 5:10] += q + 0.1 * rng.normal(size=(LAYERS, 5))
            rows.append((10 * p + i, p, int(rng.random() < 1 / (1 + np.exp(-0.9 * d - 0.9 * q))), x.ravel().tolist()))
    return spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, x array<double>").repartition(4)


def quality(rows, within=False):
    found = repeated.repeated_cv(rows, k=3, repeats=1, shape=(LAYERS, CHANNELS), rank=(2, 8))
    return (ranking.within_prompt(found, []) if within else ranking.auroc(found, [])).first()["auroc"]


def test_prompts_and_answers_each_tell(answers):
    cells = answers.select("prompt_id", F.posexplode("x").alias("i", "v")).groupBy("prompt_id", "i").agg(F.avg("v").alias("v"))
    means = cells.groupBy("prompt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("mean"))
    both = answers.join(means, "prompt_id")
    centroid = quality(both.withColumn("x", F.col("mean")))
    delta = quality(both.withColumn("x", F.zip_with("x", "mean", lambda a, b: a - b)))
    core = quality(answers)
    assert centroid > 0.5 and delta > 0.5 and core > max(centroid, delta)
    assert quality(answers, within=True) > 0.6


def test_a_planted_direction_is_read_and_a_spiky_channel_is_not(spark):
    """Tokens of 32 channels, the last with spikes of a thousand: clipped scaling leaves it little weight, and the planted direction tells answers apart."""
    rng = np.random.default_rng(7)
    u = np.append(np.linalg.qr(rng.normal(size=(31, 1)))[0][:, 0], 0)
    rows = []
    for beam in range(240):
        for t in range(rng.integers(4, 16)):
            x = 0.4 * rng.normal(size=32) + 4 * u * (beam % 2 and rng.random() < 1 / 8)
            x[31] += 1000 * rng.choice([-1, 1]) * (rng.random() < 0.01)
            rows.append((beam, beam // 2, beam % 2, t, x.tolist()))
    tokens = spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, pos int, x array<double>").repartition(4)
    cells = tokens.select("beam_id", "prompt_id", "y", "pos", F.posexplode("x").alias("ch", "v"))
    scaled = scaling.winsor_iqr(cells, cells.where("prompt_id % 3 <> 0"), ["ch"]).groupBy("beam_id", "prompt_id", "y", "pos")
    scaled = scaled.agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "scaled"))), lambda c: c["scaled"]).alias("x"))
    dealt = repeated._dealt(scaled, 3, 1, 42)
    models = repeated.fitted(dealt, 3, 1)
    weights = np.abs(models.w[:, :-1])
    assert (weights[:, 31] / weights.sum(1)).max() < 0.3
    found = repeated.held_out(dealt, models).groupBy("beam_id", "prompt_id", "y").agg(F.max("score").alias("score"))
    assert ranking.auroc(found, []).first()["auroc"] > 0.75
