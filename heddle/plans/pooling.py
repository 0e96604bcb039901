"""Queries on pooling, motion across layers and scaling."""

from pyspark.sql import functions as F

from heddle.operators import pooling, scaling
from heddle.plans.registry import query
from heddle.sources import views


def _cells(spark, sf):
    return views.unpacked(views.beams(spark, sf))


@query(
    """SELECT prompt_id, layer, ch, max(v) AS v_max, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.05) AS q05, avg(v) AS v_mean, arg_min(v, beam_idx) AS v_first,
arg_max(v, beam_idx) AS v_last, arg_max(v, (abs(v), v)) AS v_far FROM cells GROUP BY prompt_id, layer, ch""",
    "v_max q95 q05 v_mean v_first v_last v_far",
)
def pool_tokens(spark, sf):
    return pooling.pool(_cells(spark, sf), ["prompt_id", "layer", "ch"])


@query("SELECT beam_id, layer, max(v) AS v_max FROM cells GROUP BY beam_id, layer", "v_max")
def pool_max(spark, sf):
    return _cells(spark, sf).groupBy("beam_id", "layer").agg(F.max("v").alias("v_max"))


@query(
    """SELECT prompt_id, layer, ch, quantile_cont(step, 0.95) AS q95, quantile_cont(step, 0.05) AS q05 FROM
(SELECT *, lead(v) OVER (PARTITION BY beam_id, ch ORDER BY layer) - v AS step FROM cells) WHERE step IS NOT NULL GROUP BY ALL""",
    "q95 q05",
)
def velocity_pool(spark, sf):
    steps = pooling.layer_steps(_cells(spark, sf), ["beam_id"])
    return steps.groupBy("prompt_id", "layer", "ch").agg(F.percentile("step", 0.95).alias("q95"), F.percentile("step", 0.05).alias("q05"))


@query("SELECT beam_id, layer, ch, step FROM (SELECT *, lead(v) OVER (PARTITION BY beam_id, ch ORDER BY layer) - v AS step FROM cells) WHERE step IS NOT NULL", "step")
def layer_deltas(spark, sf):
    return pooling.layer_steps(_cells(spark, sf), ["beam_id"]).select("beam_id", "layer", "ch", "step")


@query(
    """SELECT prompt_id, layer, avg(speed) AS speed_mean, quantile_cont(speed, 0.9) AS speed_q90, avg(turn) AS turn_mean, quantile_cont(turn, 0.9) AS turn_q90 FROM (
SELECT prompt_id, beam_id, layer, sqrt(sum(step * step)) AS speed, 1 - sum(step * after) / (sqrt(sum(step * step)) * sqrt(sum(after * after)) + 1e-12) AS turn FROM (
SELECT *, lead(step) OVER (PARTITION BY beam_id, ch ORDER BY layer) AS after FROM (
SELECT *, lead(v) OVER (PARTITION BY beam_id, ch ORDER BY layer) - v AS step FROM cells) WHERE step IS NOT NULL) GROUP BY ALL) GROUP BY ALL""",
    "speed_mean speed_q90 turn_mean turn_q90",
)
def kinematic30(spark, sf):
    return pooling.kinematics(_cells(spark, sf), ["prompt_id", "beam_id"], ["prompt_id"])


@query(
    """SELECT beam_id, layer, sqrt(sum((after - u) * (after - u))) AS length, acos(least(1.0, greatest(-1.0, sum(u * after)))) AS angle FROM (
SELECT *, lead(u) OVER (PARTITION BY beam_id, ch ORDER BY layer) AS after FROM (
SELECT *, v / (sqrt(sum(v * v) OVER (PARTITION BY beam_id, layer)) + 1e-12) AS u FROM cells)) WHERE after IS NOT NULL GROUP BY ALL""",
    "length angle",
)
def depth_kinematics(spark, sf):
    return pooling.depth_path(_cells(spark, sf), ["beam_id"])


@query(
    """SELECT beam_id, max(score) AS s_max, quantile_cont(score, 0.9) AS s_p90, avg(score) AS s_mean, arg_max(score, pos) AS s_last,
avg(CASE WHEN score > 0.5 THEN 1.0 ELSE 0.0 END) AS s_high, ln(count(*)) AS s_len FROM tokens GROUP BY beam_id""",
    "s_max s_p90 s_mean s_last s_high s_len",
)
def beam_agg6(spark, sf):
    tokens = views.tokens(spark, sf)
    return pooling.beam_summary(tokens, tokens)


@query("SELECT beam_id, layer, ch, avg(v) OVER w AS centroid, v - avg(v) OVER w AS delta FROM cells WINDOW w AS (PARTITION BY prompt_id, layer, ch)", "centroid delta")
def centroid_delta(spark, sf):
    return scaling.centred(_cells(spark, sf), ["prompt_id", "layer", "ch"]).select("beam_id", "layer", "ch", "centroid", "delta")


_TRAIN = "prompt_id % 5 <> 0"


@query(
    f"""SELECT c.beam_id, layer, ch, (v - mid) / (dev + 1e-6) AS scaled FROM cells c JOIN (SELECT layer, ch, any_value(mid) AS mid, quantile_cont(abs(v - mid), 0.5) AS dev FROM
(SELECT * FROM cells WHERE {_TRAIN}) JOIN (SELECT layer, ch, quantile_cont(v, 0.5) AS mid FROM cells WHERE {_TRAIN} GROUP BY ALL) USING (layer, ch) GROUP BY ALL) USING (layer, ch)""",
    "scaled",
)
def mad_scale(spark, sf):
    cells = _cells(spark, sf)
    return scaling.mad(cells, cells.where(_TRAIN), ["layer", "ch"]).select("beam_id", "layer", "ch", "scaled")


@query(
    f"""SELECT beam_id, layer, ch, least(greatest((least(greatest(v, lo), hi) - mid) / (iqr / 1.349 + 1e-8), -6.0), 6.0) AS scaled FROM cells JOIN (
SELECT layer, ch, any_value(lo) AS lo, any_value(hi) AS hi, quantile_cont(least(greatest(v, lo), hi), 0.5) AS mid,
quantile_cont(least(greatest(v, lo), hi), 0.75) - quantile_cont(least(greatest(v, lo), hi), 0.25) AS iqr FROM (SELECT * FROM cells WHERE {_TRAIN}) JOIN
(SELECT layer, ch, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM cells WHERE {_TRAIN} GROUP BY ALL) USING (layer, ch) GROUP BY ALL) USING (layer, ch)""",
    "scaled",
)
def winsor_iqr_scale(spark, sf):
    cells = _cells(spark, sf)
    return scaling.winsor_iqr(cells, cells.where(_TRAIN), ["layer", "ch"]).select("beam_id", "layer", "ch", "scaled")


@query(
    f"""SELECT beam_id, layer, ch, (v - mid) / CASE WHEN dev > 0 THEN dev ELSE 1.0 END AS scaled FROM cells JOIN
(SELECT layer, ch, avg(v) AS mid, stddev_pop(v) AS dev FROM cells WHERE {_TRAIN} GROUP BY ALL) USING (layer, ch)""",
    "scaled",
)
def zscore_scale(spark, sf):
    cells = _cells(spark, sf)
    return scaling.zscore(cells, cells.where(_TRAIN), ["layer", "ch"]).select("beam_id", "layer", "ch", "scaled")


@query(
    """SELECT beam_id, layer, n.ch, greatest(least(s, edge), -edge) AS scaled FROM (SELECT *, v / sqrt(avg(v * v) OVER (PARTITION BY beam_id, layer) + 1e-8) AS s FROM cells) n JOIN
(SELECT ch, quantile_cont(abs(s), 0.99) AS edge FROM (SELECT *, v / sqrt(avg(v * v) OVER (PARTITION BY beam_id, layer) + 1e-8) AS s FROM cells) GROUP BY ch) e ON n.ch = e.ch""",
    "scaled",
)
def rms_clip(spark, sf):
    return scaling.rms_clip(_cells(spark, sf), ["beam_id", "layer"], "ch").select("beam_id", "layer", "ch", "scaled")


@query("SELECT prompt_id, layer, ch, arg_max(beam_idx, (v, -beam_idx)) AS at FROM cells GROUP BY ALL")
def argmax_token(spark, sf):
    return _cells(spark, sf).groupBy("prompt_id", "layer", "ch").agg(F.max_by("beam_idx", F.struct("v", -F.col("beam_idx"))).alias("at"))


@query("SELECT beam_id, layer, ch, v FROM cells WHERE layer BETWEEN 3 AND 6", "v")
def layer_crop(spark, sf):
    return _cells(spark, sf).where("layer BETWEEN 3 AND 6").select("beam_id", "layer", "ch", "v")
