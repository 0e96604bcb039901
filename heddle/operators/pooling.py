"""Pooling of ragged token sequences, and motion across layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool(cells: DataFrame, keys: list[str], value: str = "v", order: str = "beam_idx") -> DataFrame:
    """Maximum, quantiles (exact, interpolated), mean, first, last and the value farthest from zero."""
    v = F.col(value)
    return cells.groupBy(*keys).agg(
        F.max(v).alias("v_max"),
        F.percentile(v, 0.95).alias("q95"),
        F.percentile(v, 0.05).alias("q05"),
        F.avg(v).alias("v_mean"),
        F.min_by(v, order).alias("v_first"),
        F.max_by(v, order).alias("v_last"),
        F.max_by(v, F.struct(F.abs(v), v)).alias("v_far"),
    )


def layer_steps(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Difference to the next layer of the same channel; the last layer has none."""
    step = F.lead("v").over(Window.partitionBy(*keys, "ch").orderBy("layer")) - F.col("v")
    return cells.withColumn("step", step).where("step IS NOT NULL")


def kinematics(cells: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Speed between layers and turn (1 - cosine) between steps: mean and 0.9 quantile over a group's tokens."""
    steps = layer_steps(cells, keys)
    after = F.lead("step").over(Window.partitionBy(*keys, "ch").orderBy("layer"))
    parts = steps.withColumn("after", after).groupBy(*keys, "layer").agg(
        F.sqrt(F.sum(F.col("step") ** 2)).alias("speed"), F.sum(F.col("step") * F.col("after")).alias("dot"), F.sqrt(F.sum(F.col("after") ** 2)).alias("next")
    )
    turn = F.when(F.col("dot").isNotNull(), 1 - F.col("dot") / (F.col("speed") * F.col("next") + 1e-12))
    return parts.groupBy(*group, "layer").agg(
        F.avg("speed").alias("speed_mean"), F.percentile("speed", 0.9).alias("speed_q90"), F.avg(turn).alias("turn_mean"), F.percentile(turn, 0.9).alias("turn_q90")
    )


def depth_path(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Step length between layers scaled to unit norm, and the angle between the layers."""
    norms = cells.groupBy(*keys, "layer").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    unit = cells.join(norms, [*keys, "layer"]).withColumn("v", F.col("v") / (F.col("norm") + 1e-12))
    after = F.lead("v").over(Window.partitionBy(*keys, "ch").orderBy("layer"))
    pairs = unit.withColumn("after", after).where("after IS NOT NULL").groupBy(*keys, "layer")
    cosine = F.sum(F.col("v") * F.col("after"))
    return pairs.agg(F.sqrt(F.sum((F.col("after") - F.col("v")) ** 2)).alias("length"), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))).alias("angle"))


def beam_summary(tokens: DataFrame, beams: DataFrame) -> DataFrame:
    """Six numbers of a beam's token scores: max, p90, mean, last, share above half, log length.

    A beam without tokens has 0.5 four times and 0 twice.
    """
    s = tokens.groupBy("beam_id").agg(
        F.max("score").alias("s_max"),
        F.percentile("score", 0.9).alias("s_p90"),
        F.avg("score").alias("s_mean"),
        F.max_by("score", "pos").alias("s_last"),
        F.avg((F.col("score") > 0.5).cast("double")).alias("s_high"),
        F.log(F.count("*")).alias("s_len"),
    )
    empty = {"s_max": 0.5, "s_p90": 0.5, "s_mean": 0.5, "s_last": 0.5, "s_high": 0.0, "s_len": 0.0}
    return beams.select("beam_id").distinct().join(s, "beam_id", "left").fillna(empty)


def canonical_length(tokens: DataFrame, is_stop: Column) -> DataFrame:
    """Tokens up to and with the first stop token, else all."""
    return tokens.groupBy("beam_id").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(is_stop, F.col("pos"))) + 1, F.count("*")).alias("canonical"))


def truncated(tokens: DataFrame, lengths: DataFrame, length: str = "canonical") -> DataFrame:
    """Tokens before their beam's window length."""
    return tokens.join(lengths.select("beam_id", length), "beam_id").where(F.col("pos") < F.col(length)).drop(length)
