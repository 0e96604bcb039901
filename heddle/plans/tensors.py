"""Queries on tensors and subspaces."""

import numpy as np
from pyspark.sql import functions as F

from heddle.functions import columns
from heddle.operators import conditions, factoring, pooling, scaling, splits, subspaces, tensors
from heddle.plans.registry import query
from heddle.sources import views
from heddle.sources.scratch import stored

_L, _C, _RANKS = views.LAYERS, views.CHANNELS, (3, 4)


@query("SELECT a.layer AS i, b.layer AS j, sum(a.v * b.v) AS g FROM cells a JOIN cells b ON a.beam_id = b.beam_id AND a.ch = b.ch GROUP BY ALL", "g")
def gram_layer(spark, sf):
    return tensors.grams(views.beams(spark, sf), (_L, _C)).where("mode = 0").drop("mode")


@query("SELECT a.ch AS i, b.ch AS j, sum(a.v * b.v) AS g FROM cells a JOIN cells b ON a.beam_id = b.beam_id AND a.layer = b.layer GROUP BY ALL", "g")
def gram_channel(spark, sf):
    return tensors.grams(views.beams(spark, sf), (_L, _C)).where("mode = 1").drop("mode")


@query(
    """SELECT beam_id, sqrt(s) AS norm, s / (sum(s) OVER (PARTITION BY prompt_id) + 1e-12) AS leverage, ln(sum(s) OVER (PARTITION BY prompt_id) + 1e-8) AS log_trace FROM
(SELECT beam_id, prompt_id, sum(d * d) AS s FROM (SELECT *, v - avg(v) OVER (PARTITION BY prompt_id, layer, ch) AS d FROM cells) GROUP BY ALL)""",
    "norm leverage log_trace",
)
def contrast_leverage(spark, sf):
    from pyspark.sql import Window

    d = scaling.centred(views.unpacked(views.beams(spark, sf)), ["prompt_id", "layer", "ch"])
    s = d.groupBy("beam_id", "prompt_id").agg(F.sum(F.col("delta") ** 2).alias("s"))
    total = F.sum("s").over(Window.partitionBy("prompt_id"))
    return s.select("beam_id", F.sqrt("s").alias("norm"), (F.col("s") / (total + 1e-12)).alias("leverage"), F.log(total + 1e-8).alias("log_trace"))


@query(
    """SELECT beam_id, sqrt(sum(v * v)) AS magnitude, sum(CASE WHEN layer = 0 THEN v * far END) / (sqrt(sum(v * v) FILTER (layer = 0)) * sqrt(sum(far * far) FILTER (layer = 0))) AS first_last
FROM (SELECT *, lead(v, 7) OVER (PARTITION BY beam_id, ch ORDER BY layer) AS far FROM cells) GROUP BY beam_id""",
    "magnitude first_last",
)
def geometric_extras(spark, sf):
    x = F.transform("x", lambda v: v.cast("double"))
    return views.beams(spark, sf).select(
        "beam_id", F.sqrt(columns.dot(x, x)).alias("magnitude"), columns.cosine(F.slice(x, 1, _C), F.slice(x, _C * (_L - 1) + 1, _C)).alias("first_last")
    )


@query(
    """SELECT a.beam_id, list_cosine_similarity(list_transform(a.x, lambda e: CAST(e AS DOUBLE)), list_transform(b.x, lambda e: CAST(e AS DOUBLE))) AS cosine, list_cosine_similarity(a.x, b.x) > 0.2 AS "same"
FROM beams a JOIN beams b ON a.prompt_id = b.prompt_id AND b.beam_idx = 0""",
    "cosine",
)
def fingerprint_cosine(spark, sf):
    b = views.beams(spark, sf)
    first = b.where("beam_idx = 0").select("prompt_id", F.col("x").alias("x0"))
    c = columns.cosine(F.col("x"), F.col("x0"))
    return b.join(first, "prompt_id").select("beam_id", c.alias("cosine"), (c > 0.2).alias("same"))


@query(
    """SELECT beam_id, len(z) AS n, list_sum(z) AS total, z[5] AS fifth, z[14] AS last FROM (SELECT beam_id, list_concat(a, list_transform(flatten([[[i, j] for j in range(i, 5)] for i in range(1, 5)]), lambda p: a[p[1]] * a[p[2]])) AS z FROM
(SELECT beam_id, list_transform(x[1:4], lambda e: CAST(e AS DOUBLE)) AS a FROM beams))""",
    "total fifth last",
)
def deg2_expand(spark, sf):
    z = columns.degree2(F.transform(F.slice("x", 1, 4), lambda v: v.cast("double")))
    total = F.aggregate(z, F.lit(0.0), lambda a, v: a + v)
    return views.beams(spark, sf).select("beam_id", F.size(z).cast("long").alias("n"), total.alias("total"), F.element_at(z, 5).alias("fifth"), F.element_at(z, 14).alias("last"))


@query("SELECT beam_id, len(b) AS n, CAST(b[1] AS DOUBLE) AS first FROM (SELECT beam_id, x[57:62] AS b FROM beams)", "first")
def band_slice(spark, sf):
    b = columns.band(F.col("x"), -8, -2)
    return views.beams(spark, sf).select("beam_id", F.size(b).cast("long").alias("n"), F.element_at(b, 1).cast("double").alias("first"))


def _factors(spark, sf, **options):
    b = views.beams(spark, sf)
    return b, *tensors.hosvd(b.where("prompt_id % 5 <> 0"), _L, _C, *_RANKS, **options)


@query()
def hosvd_core(spark, sf):
    b, u_l, u_c = _factors(spark, sf)
    return tensors.core(b, u_l, u_c).select("beam_id", "prompt_id", "y", "core")


@query()
def q_statistic(spark, sf):
    return tensors.q_statistic(*_factors(spark, sf))


@query()
def contrast_block(spark, sf):
    """On cores in the training rows' factors; the principal directions are those of the training rows' differences."""
    b, u_l, u_c = _factors(spark, sf)
    return tensors.contrast(tensors.core(b, u_l, u_c), F.col("prompt_id") % 5 != 0)


def _channel_factors(spark, sf, modulus):
    b = views.beams(spark, sf)
    return [tensors.hosvd(b.where(f"prompt_id % {modulus} = {i}"), _L, _C, *_RANKS)[1] for i in range(modulus)]


@query()
def principal_angles(spark, sf):
    """Angles between the channel factors of two halves of the prompts, beside those of random subspaces."""
    cosines = tensors.principal_angles(*_channel_factors(spark, sf, 2))
    null = tensors.random_angles(_C, _RANKS[1])
    rows = [(i, float(c), float(n)) for i, (c, n) in enumerate(zip(cosines, null, strict=True))]
    return spark.createDataFrame(rows, "i int, cosine double, random double")


@query()
def subspace_stability(spark, sf):
    """Of each pair of datasets: the mean cosine of their channel factors' angles, how many directions they share, and how many random ones would."""
    u = _channel_factors(spark, sf, 3)
    null = tensors.shared_directions(tensors.random_angles(_C, _RANKS[1]))
    cosines = {(i, j): tensors.principal_angles(u[i], u[j]) for i in range(3) for j in range(3)}
    rows = [(i, j, float(c.mean()), tensors.shared_directions(c), null) for (i, j), c in cosines.items()]
    return spark.createDataFrame(rows, "a int, b int, mean double, shared int, random int")


@query()
def hosvd_random(spark, sf):
    """Cores in the factors of the randomised route."""
    b = views.beams(spark, sf)
    u = tensors.hosvd_randomised(b.where("prompt_id % 5 <> 0"), _L, _C, *_RANKS)
    return tensors.core(b, *u).select("beam_id", "core")


@query()
def head_tucker(spark, sf):
    """Cores of three modes: layers, heads and the channels of a head."""
    b = views.beams(spark, sf)
    u_l, u_h, u_c = tensors.tucker(b.where("prompt_id % 5 <> 0"), (_L, 2, _C // 2), (3, 2, 2))
    return tensors.core(b, u_l, np.kron(u_h, u_c)).select("beam_id", "core")


@query()
def spectral_concentration(spark, sf):
    b, u_l, u_c = _factors(spark, sf)
    return tensors.spectral_concentration(tensors.core(b, u_l, u_c), *_RANKS, "core", leading=2).select("beam_id", "concentration")


@query()
def state_projection(spark, sf):
    """Tensors in the trailing directions of the matrix that they make, and their size."""
    b = views.beams(spark, sf)
    band, _, _ = tensors.basis_of_rows(b, _L * _C, 8, 8)
    z = tensors.projected(b, band)
    return z.select("beam_id", "rms", F.sqrt(columns.dot(F.col("z"), F.col("z"))).alias("inside"))


@query()
def spectral_invariants(spark, sf):
    """Of each prompt's answers taken as the states of one trajectory."""
    return tensors.spectral_invariants(views.beams(spark, sf).withColumnRenamed("beam_idx", "pos"), "prompt_id")


@query()
def block_terms(spark, sf):
    """Two streams: the channels of the training rows' factor, and the rest."""
    b, _, u_c = _factors(spark, sf)
    p = u_c @ u_c.T
    found = tensors.block_terms(b, "prompt_id", {"inside": (p, 3, 4), "outside": (np.eye(_C) - p, 3, 2)}, _L, _C)
    return found.select("prompt_id", "inside_rest", "outside_rest", F.size("inside_core").alias("n_inside"), F.size("outside_core").alias("n_outside"))


@query()
def svd_route(spark, sf):
    """Singular values of both modes' unfoldings of the training tensors, and each one's share of the energy."""
    train = views.beams(spark, sf).where("prompt_id % 5 <> 0")
    rows = []
    for mode, n in enumerate((_L, _C)):
        values, _ = factoring.singular(train, n, factoring.unfolding((_L, _C), mode))
        rows += [(mode, i, float(v), float(v**2 / (values**2).sum())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "mode int, i int, value double, share double")


@query()
def subspace_verdict(spark, sf):
    """Channel directions that upper and lower quantiles of states share with those of steps between layers, against chance and the halves of one stream."""
    cells = views.unpacked(views.beams(spark, sf))

    def quantiles(rows, value):
        pooled = rows.groupBy("prompt_id", "layer", "ch").agg(F.percentile(value, 0.95).alias("hi"), F.percentile(value, 0.05).alias("lo"))
        pack = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("layer", "ch", F.col(c).alias("v")))), lambda p: p["v"])
        return pooled.groupBy("prompt_id").agg(pack("hi").alias("hi"), pack("lo").alias("lo"))

    static, steps = stored(quantiles(cells, "v"), name="static"), stored(quantiles(pooling.layer_steps(cells, ["beam_id"]), "step"), name="steps")
    both = lambda d: d.select("prompt_id", conditions.joined_channels(F.col("hi"), F.col("lo"), _C).alias("x"))
    halves = static.select("prompt_id", F.col("hi").alias("x")), static.select("prompt_id", F.col("lo").alias("x"))
    found = subspaces.compared(both(static), both(steps), halves, splits.folds(static, 3), 3, ((_L, 2 * _C), (_L - 1, 2 * _C), (_L, _C)), _RANKS[1])
    return spark.createDataFrame([tuple(found.values())], "shared double, halves double, null_lo double, null_mid double, null_hi double, verdict string")
