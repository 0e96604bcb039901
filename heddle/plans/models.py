"""Queries on detectors."""

from pyspark.sql import functions as F

from heddle.operators import conditions, kernels, models, networks, pooling, ranking, repeated, scaling, splits, tensors
from heddle.plans.registry import query
from heddle.plans.tensors import _C, _L, _RANKS
from heddle.sources import views
from heddle.sources.scratch import stored


def _features(spark, sf):
    return views.beams(spark, sf).select("beam_id", "prompt_id", "y", F.transform("x", lambda v: v.cast("double")).alias("features"))


@query()
def lr_oof(spark, sf):
    rows = _features(spark, sf)
    return models.out_of_fold("logistic", rows, splits.folds(rows), 5).select("beam_id", "y", "fold", "score")


@query()
def rf_oof(spark, sf):
    rows = _features(spark, sf)
    return models.out_of_fold("forest", rows, splits.folds(rows), 5, trees=20).select("beam_id", "y", "fold", "score")


@query(
    """SELECT beam_id, y, sqrt(sum((v - m0) * (v - m0))) - sqrt(sum((v - m1) * (v - m1))) AS score FROM cells JOIN
(SELECT layer, ch, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1 FROM cells WHERE prompt_id % 5 <> 0 GROUP BY ALL) USING (layer, ch) GROUP BY beam_id, y""",
    "score",
)
def centroid_distance(spark, sf):
    rows = _features(spark, sf)
    return models.centroid_distance(rows.where("prompt_id % 5 <> 0"), rows)


@query()
def transfer_matrix(spark, sf):
    """Factors and a detector fitted on one dataset and scored on every other, with pooled quality."""
    b = views.beams(spark, sf).withColumn("dataset", F.col("prompt_id") % 3)
    found = None
    for source in range(3):
        train = b.where(F.col("dataset") == source)
        u = tensors.hosvd(train, _L, _C, *_RANKS)
        cores = tensors.core(b, *u).select("beam_id", "dataset", "y", F.col("core").alias("features"))
        model = models.detector("logistic", cores.where(F.col("dataset") == source))
        part = ranking.auroc(models.scores(model, cores), ["dataset"]).select(F.lit(source).alias("source"), F.col("dataset").alias("target"), "auroc")
        found = part if found is None else found.union(part)
    return found


_SHAPE = (_L, _C)
_KINDS = {"logistic": {}, "forest": {"trees": 20}}


@query()
def grouped_cv(spark, sf):
    """Core, prompt mean and difference on grouped folds: pooled, within-prompt and fold-wise quality of both detectors."""
    b = views.beams(spark, sf)
    cores = models.fold_cores(b, splits.folds(b), 5, _SHAPE, _RANKS)
    return models.evaluation_summary(models.grouped_evaluation(cores, 5, ["core", "centroid", "delta"], _KINDS))


@query()
def split_protocol(spark, sf):
    """Both detectors by question and by answer, with intervals."""
    b = views.beams(spark, sf)
    by = {"question": splits.by_question(splits.known_prompts(b)), "answer": splits.by_answer(b)}
    each = [models.split_evaluation(b, s, _SHAPE, _RANKS, _KINDS).withColumn("protocol", F.lit(name)) for name, s in by.items()]
    return each[0].unionByName(each[1])


@query()
def seed_protocol(spark, sf):
    """The split by question under several seeds."""
    b = views.beams(spark, sf)
    known, found = splits.known_prompts(b), None
    for seed in (42, 43, 44):
        part = models.split_evaluation(b, splits.by_question(known, seed=seed), _SHAPE, _RANKS, {"logistic": {}}, seed=seed).withColumn("seed", F.lit(seed))
        found = part if found is None else found.unionByName(part)
    return found


@query()
def layer_readout(spark, sf):
    b = views.beams(spark, sf)
    return models.layer_readout(b, splits.folds(b, 3), 3, _SHAPE, 4, reps=200)


@query()
def quadratic_readout(spark, sf):
    rows = _features(spark, sf)
    return models.quadratic_readout(rows.where("prompt_id % 5 <> 0"), rows, components=6).select("beam_id", "y", "score")


@query()
def contrast_cv(spark, sf):
    """The contrast block alone and beside the core, on grouped folds."""
    b = views.beams(spark, sf)
    cores = models.fold_cores(b, splits.folds(b, 3), 3, _SHAPE, _RANKS)
    return models.evaluation_summary(models.contrast_evaluation(cores, 3, {"logistic": {}}, components=6))


@query()
def stacked_cv(spark, sf):
    """Layers as tokens: their scores, out of inner folds, beside the core."""
    b = views.beams(spark, sf)
    folds = splits.folds(b, 3)
    layer = F.transform(F.sequence(F.lit(0), F.lit(_L - 1)), lambda i: F.slice("x", i * _C + 1, F.lit(_C)))
    tokens = b.select("beam_id", "prompt_id", "y", F.posexplode(layer).alias("pos", "features"))
    return models.evaluation_summary(models.stacked_evaluation(tokens, models.fold_cores(b, folds, 3, _SHAPE, _RANKS), folds, 3, {"logistic": {}}))


@query()
def hygiene_ladder(spark, sf):
    """Four ways to prepare tensors: median and deviation, clipped quartiles, and these without each layer's leading direction or its
    three; the others against the first, pooled and within prompts."""
    b = views.beams(spark, sf)

    def without(k):
        def prepared(d, train):
            t = models.scaled_tensors(d, train, _C, scaling.WINSOR_IQR)
            return conditions.without_common(t, t.where("fit"), k, _L, column="x")

        return prepared

    steps = {
        "mad": lambda d, t: models.scaled_tensors(d, t, _C), "clipped": lambda d, t: models.scaled_tensors(d, t, _C, scaling.WINSOR_IQR), "uncommon": without(1), "uncommon3": without(3)
    }
    found = models.ladder(b, splits.folds(b, 3), 3, _SHAPE, _RANKS, steps, {"logistic": {}})
    wide = stored(found.groupBy("beam_id", "prompt_id", "y").agg(*[F.max(F.when(F.col("feature") == s, F.col("score"))).alias(s) for s in steps]), name="ladder")
    deltas = conditions.against(wide, [s for s in steps if s != "mad"], ["mad"], reps=200)
    of = lambda c, metric: F.max(F.when(F.col("metric") == metric, F.col(c)))
    deltas = deltas.groupBy(F.col("condition").alias("feature")).agg(
        of("mean", "within").alias("delta"), of("excludes_zero", "within").alias("excludes_zero"), of("mean", "pooled").alias("pooled_delta"), of("excludes_zero", "pooled").alias("pooled_excludes_zero")
    )
    return models.evaluation_summary(found).join(deltas, "feature", "left")


@query()
def repeated_cv(spark, sf):
    """Five repeats of five shuffled grouped folds, all models in one pass: quality of the core, over repeats and folds."""
    return repeated.summary(repeated.repeated_cv(views.beams(spark, sf), shape=_SHAPE, rank=_RANKS))


@query()
def repeated_delta(spark, sf):
    """The core against the whole tensor over three repeats, in one paired bootstrap."""
    b = views.beams(spark, sf)
    core, whole = repeated.repeated_cv(b, repeats=3, shape=_SHAPE, rank=_RANKS), repeated.repeated_cv(b, repeats=3)
    return repeated.compared(core, whole, reps=200).select("metric", "mean", "lo", "hi", "excludes_zero")


@query()
def rbf_oof(spark, sf):
    """Decision values of radial-kernel machines, out of fold."""
    rows = _features(spark, sf)
    return kernels.out_of_fold(rows, splits.folds(rows, 3), 3, width=128).select("beam_id", "y", "fold", "score")


@query()
def mlp_oof(spark, sf):
    """Scores of perceptrons with a hidden layer, out of fold."""
    rows = _features(spark, sf)
    return networks.out_of_fold(rows, splits.folds(rows), 5, hidden=32, steps=20).select("beam_id", "y", "fold", "score")


@query()
def rank_probe(spark, sf):
    """Nested channel ranks on two datasets, against the smallest, and which are adopted."""
    b = views.beams(spark, sf)
    found = None
    for name, rest in (("first", 0), ("second", 1)):
        part = repeated.rank_probe(b.where(F.col("prompt_id") % 2 == rest), _SHAPE, [(3, 2), (3, 4), (3, 6)], k=3, reps=200).withColumn("dataset", F.lit(name))
        found = part if found is None else found.unionByName(part)
    found = stored(found, name="probes")
    return found.join(repeated.ranks_adopted(found, "first", "second"), "rank", "left").select("dataset", "rank", "pooled", "within", "mean", "excludes_zero", "adopt")


@query()
def stream_conditions(spark, sf):
    """The core, and beside it steps between layers and their speeds and turns, each alone and together; tensors pooled anew in the core's place."""
    b = views.beams(spark, sf).withColumn("x", F.col("x").cast("array<double>"))
    folds = splits.folds(b, 3)
    layer = lambda i: F.slice("x", i * _C + 1, F.lit(_C))
    steps = b.withColumn("x", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_L - 2)), lambda i: F.zip_with(layer(i + 1), layer(i), lambda p, q: p - q))))
    square = b.withColumn("x", conditions.joined_channels(F.col("x"), F.transform("x", F.abs), _C))
    cores = lambda d, shape: models.fold_cores(d, folds, 3, shape, _RANKS).select("beam_id", "fold", F.col("core").alias("block"))
    motion = pooling.kinematics(views.unpacked(b), ["beam_id"], ["beam_id"])
    number = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("layer", F.col(c).alias("v")))), lambda p: p["v"])
    motion = motion.groupBy("beam_id").agg(F.concat(number("speed_mean"), F.filter(number("turn_mean"), lambda v: v.isNotNull())).alias("block"))
    found = models.stream_conditions(
        models.fold_cores(b, folds, 3, _SHAPE, _RANKS), {"velocity": cores(steps, (_L - 1, _C)), "kinematic": motion}, 3, {"logistic": {}}, alone={"repooled": cores(square, (_L, 2 * _C))}
    )
    return models.evaluation_summary(found)
