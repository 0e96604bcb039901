"""Queries on stores of raw states and 16-bit floats: the answers of a prompt, in order, as the tokens of one."""

from pyspark.sql import functions as F

from heddle.functions import halves
from heddle.plans.registry import query
from heddle.sources import scratch, states, views

_LAYERS, _CHANNELS = views.LAYERS, views.CHANNELS


def _rounded(digits: int, least: int) -> str:
    """The cells with their values to so many binary digits."""
    return f"""(SELECT * EXCLUDE (unit) REPLACE (coalesce(round_even(v / unit, 0) * unit, 0.0) AS v) FROM
(SELECT *, CASE WHEN v <> 0 THEN pow(2.0, greatest(floor(log2(abs(v))), {least}) - {digits - 1}) END AS unit FROM cells))"""


def _store(spark, sf):
    tokens = views.beams(spark, sf).select(F.col("prompt_id").alias("beam_id"), F.floor(F.col("prompt_id") / 5).alias("prompt_id"), F.lit(0).alias("y"), F.col("beam_idx").alias("pos"), "x")
    path = scratch.folder(spark, name="states")
    states.write(tokens, path, _LAYERS, _CHANNELS, block_bytes=1 << 16)
    return states.read(spark, path)


@query(f"SELECT beam_id, layer, ch, v FROM {_rounded(11, -14)}", "v")
def half_pack(spark, sf):
    """Tensors through 16-bit floats and back."""
    b = views.beams(spark, sf).select("beam_id", halves.packed("x").alias("h"))
    return views.unpacked(b.select("beam_id", halves.unpacked("h").alias("x"))).select("beam_id", "layer", "ch", "v")


@query(f"SELECT prompt_id AS beam_id, prompt_id // 5 AS prompt_id, (beam_idx)::INTEGER AS pos, layer, ch, v FROM {_rounded(8, -126)}", "v")
def state_store(spark, sf):
    return views.unpacked(states.unpacked(_store(spark, sf)).drop("y")).select("beam_id", "prompt_id", "pos", "layer", "ch", "v")


_STEPS = "(SELECT *, lead(v) OVER (PARTITION BY beam_id, ch ORDER BY layer) - v AS step FROM half)"
_POOLED = "SELECT prompt_id AS beam_id, '{name}' AS stream, layer, ch, {value}::DOUBLE AS v FROM {rows} GROUP BY ALL"
_MOTION = "SELECT prompt_id AS beam_id, '{name}' AS stream, layer, 0 AS ch, {value} AS v FROM motion{where} GROUP BY ALL"


@query(
    f"WITH half AS {_rounded(8, -126)}, steps AS (SELECT * FROM {_STEPS} WHERE step IS NOT NULL), "
    """motion AS (SELECT prompt_id, beam_id, layer, sqrt(sum(step * step)) AS speed, 1 - sum(step * after) / (sqrt(sum(step * step)) * sqrt(sum(after * after)) + 1e-12) AS turn
FROM (SELECT *, lead(step) OVER (PARTITION BY beam_id, ch ORDER BY layer) AS after FROM steps) GROUP BY ALL) """
    + " UNION ALL ".join(
        [_POOLED.format(name=n, value=v, rows="half") for n, v in (("v_max", "max(v)"), ("at", "arg_max(beam_idx, (v, -beam_idx))"), ("s95", "quantile_cont(v, 0.95)"), ("s05", "quantile_cont(v, 0.05)"))]
        + [_POOLED.format(name=n, value=f"quantile_cont(step, {p})", rows="steps") for n, p in (("v95", 0.95), ("v05", 0.05))]
        + [_MOTION.format(name=n, value=v, where="") for n, v in (("speed_mean", "avg(speed)"), ("speed_q90", "quantile_cont(speed, 0.9)"))]
        + [_MOTION.format(name=n, value=v, where=f" WHERE layer < {_LAYERS - 2}") for n, v in (("turn_mean", "avg(turn)"), ("turn_q90", "quantile_cont(turn, 0.9)"))]
    ),
    "v",
)
def raw_streams(spark, sf):
    """Every stream from one pass over the store, a row a number."""
    found = states.streams(_store(spark, sf))

    def named(stream):
        by_layer = stream.startswith(("speed", "turn"))
        layer = lambda i: i if by_layer else F.floor(i / _CHANNELS)
        ch = lambda i: F.lit(0) if by_layer else i % _CHANNELS
        return F.transform(stream, lambda v, i: F.struct(F.lit(stream).alias("stream"), layer(i).cast("int").alias("layer"), ch(i).alias("ch"), v.alias("v")))

    return found.select("beam_id", F.inline(F.concat(*map(named, states.STREAMS))))
