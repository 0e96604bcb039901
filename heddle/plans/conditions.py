"""Queries on conditions and what compares them."""

from pyspark.sql import functions as F

from heddle.functions import columns
from heddle.operators import conditions, ranking
from heddle.plans.ranking import _REPS, _SEED, _replicates, _with_draws
from heddle.plans.registry import query
from heddle.plans.splits import _ANSWER, split_answer_rows
from heddle.sources import views

_C = views.CHANNELS


def _two_streams(spark, sf):
    """Each beam with its own tensor and that of its prompt's first beam."""
    b = views.beams(spark, sf)
    return b.join(b.where("beam_idx = 0").select("prompt_id", F.col("x").alias("other")), "prompt_id")


@query(
    """SELECT beam_id, len(z) AS n, CAST(z[8] AS DOUBLE) AS eighth, CAST(z[9] AS DOUBLE) AS ninth, CAST(z[128] AS DOUBLE) AS last FROM (SELECT a.beam_id,
flatten([list_concat(a.x[8 * l + 1 : 8 * l + 8], b.x[8 * l + 1 : 8 * l + 8]) for l in range(8)]) AS z FROM beams a JOIN beams b ON a.prompt_id = b.prompt_id AND b.beam_idx = 0)""",
    "eighth ninth last",
)
def stream_concat(spark, sf):
    z = conditions.joined_channels(F.col("x"), F.col("other"), _C)
    at = lambda i: F.element_at("z", i).cast("double")
    return _two_streams(spark, sf).withColumn("z", z).select("beam_id", F.size("z").cast("long").alias("n"), at(8).alias("eighth"), at(9).alias("ninth"), at(128).alias("last"))


@query(
    "SELECT a.beam_id, len(a.x) + len(b.x) AS n, CAST(a.x[64] AS DOUBLE) AS upper, CAST(b.x[1] AS DOUBLE) AS lower FROM beams a JOIN beams b ON a.prompt_id = b.prompt_id AND b.beam_idx = 0",
    "upper lower",
)
def joint_concat(spark, sf):
    z = _two_streams(spark, sf).withColumn("z", conditions.joined_layers(F.col("x"), F.col("other")))
    return z.select("beam_id", F.size("z").cast("long").alias("n"), F.element_at("z", 64).cast("double").alias("upper"), F.element_at("z", 65).cast("double").alias("lower"))


@query(f"WITH {_ANSWER} SELECT count(*) AS n_both FROM (SELECT prompt_id FROM answer WHERE part = 'train' INTERSECT SELECT prompt_id FROM answer WHERE part = 'valid')")
def prompt_overlap(spark, sf):
    rows = split_answer_rows(spark, sf)
    return conditions.overlap(rows.where("part = 'train'"), rows.where("part = 'valid'"), "prompt_id")


_DELTAS = " UNION ALL ".join(
    f"""SELECT '{"within" if within else "pooled"}' AS condition, avg(d) AS mean, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM
(SELECT p.auroc - q.auroc AS d FROM ({_replicates('score', within)}) p JOIN ({_replicates('other', within)}) q USING (rep))"""
    for within in (False, True)
)


def _deltas(spark, sf):
    rows = views.scored(spark, sf)
    each = [
        ranking.paired_delta(rows, "score", "other", reps=_REPS, seed=_SEED, within=within).select(F.lit(name).alias("condition"), "mean", "excludes_zero")
        for name, within in (("pooled", False), ("within", True))
    ]
    return each[0].union(each[1])


@query(
    _with_draws(
        f"""SELECT condition, count(*) FILTER (excludes_zero AND mean > 0) AS wins, count(*) FILTER (excludes_zero AND mean < 0) AS losses,
CASE WHEN count(*) FILTER (excludes_zero AND mean < 0) > 0 THEN 'worse' WHEN count(*) FILTER (excludes_zero AND mean > 0) > 0 THEN 'better' ELSE 'same' END AS verdict FROM ({_DELTAS}) GROUP BY condition"""
    )
)
def condition_verdict(spark, sf):
    return conditions.verdict(_deltas(spark, sf))


@query(_with_draws(f"SELECT condition, bool_and(NOT (excludes_zero AND mean < 0)) AND bool_or(excludes_zero AND mean > 0) AS adopt FROM ({_DELTAS}) GROUP BY condition"))
def adoption(spark, sf):
    return conditions.adopted(_deltas(spark, sf))


def _features(spark, sf):
    x = F.transform("x", lambda v: v.cast("double"))
    return views.beams(spark, sf).select("beam_id", "prompt_id", x.alias("features"), F.slice(x, 1, _C).alias("base"))


@query()
def remove_common(spark, sf):
    rows = _features(spark, sf)
    out = conditions.without_common(rows, rows.where("prompt_id % 5 <> 0"), 3, views.LAYERS)
    return out.select("beam_id", F.sqrt(columns.dot(F.col("features"), F.col("features"))).alias("norm"))


@query()
def residual_block(spark, sf):
    rows = _features(spark, sf)
    out = conditions.fused_residual(rows, rows.where("prompt_id % 5 <> 0"), "base")
    return out.select("beam_id", F.size("fused").alias("n"), F.sqrt(columns.dot(F.col("fused"), F.col("fused"))).alias("norm"))


@query(_with_draws(f"SELECT condition FROM ({_DELTAS}) WHERE mean >= 0"))
def components_kept(spark, sf):
    return conditions.not_negative(_deltas(spark, sf))
