"""Detectors on grouped folds with Spark ML, and their out-of-fold scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import columns, sums
from heddle.operators import conditions, pooling, ranking, scaling, splits, tensors
from heddle.sources import views
from heddle.sources.scratch import stored


def _balanced(train: DataFrame) -> DataFrame:
    n = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    weight = F.when(F.col("y") == 1, total / (2 * max(1, n.get(1, 0)))).otherwise(total / (2 * max(1, n.get(0, 0))))
    return train.withColumn("w", weight)


def detector(kind: str, train: DataFrame, *, c: float = 1.0, trees: int = 200, seed: int = 42):
    """A fitted pipeline on column ``features`` (array) and label y, with balanced class weights.

    The training rows are read once and kept while the model is fitted.
    """
    train = train.select("y", F.col("features").cast("array<double>").alias("features")).persist()
    try:
        return _fitted(kind, train, c, trees, seed)
    finally:
        train.unpersist()


def _fitted(kind: str, train: DataFrame, c: float, trees: int, seed: int):
    rows = _balanced(train.withColumn("raw", array_to_vector("features")))
    if kind == "logistic":
        stages = [
            StandardScaler(inputCol="raw", outputCol="v", withMean=True),
            LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=1 / (c * max(1, rows.count())), standardization=False, maxIter=200),
        ]
    else:
        stages = [RandomForestClassifier(featuresCol="raw", labelCol="y", weightCol="w", numTrees=trees, maxDepth=10, seed=seed)]
    return Pipeline(stages=stages).fit(rows)


def scores(model, rows: DataFrame) -> DataFrame:
    """Adds ``score``, the probability of y = 1."""
    out = model.transform(rows.withColumn("raw", array_to_vector(F.col("features").cast("array<double>"))))
    return out.select(*rows.columns, F.element_at(vector_to_array("probability"), 2).alias("score"))


def out_of_fold(kind: str, rows: DataFrame, folds: DataFrame, k: int, **options) -> DataFrame:
    """Each row scored by the model of the other folds."""
    dealt = stored(rows.join(folds, "prompt_id"), name="dealt")  # in parts by size: what a forest shuffles grows with their number
    return reduce(DataFrame.unionByName, [scores(detector(kind, dealt.where(F.col("fold") != i), **options), dealt.where(F.col("fold") == i)) for i in range(k)])


def _scaled(scale: scaling.Scale, parameters: np.ndarray):
    """Scales a column of tensors where they lie."""

    @F.pandas_udf("array<double>")
    def scaled(x):
        import pandas as pd

        return pd.Series(list(scale.apply(np.stack(x.to_numpy()).astype(np.float64), *parameters))) if len(x) else pd.Series([], dtype=object)

    return scaled


def scaled_tensors(packed: DataFrame, train: Column, channels: int, scale: scaling.Scale = scaling.MAD) -> DataFrame:
    """The tensors, each channel of a layer scaled by the training rows (by their median and deviation, if nothing else is asked for),
    and ``fit``, which marks those rows.  Stored.

    Only the parameters are found by cells; they are as many as a tensor has numbers, and tensors are scaled where they lie.
    """
    found = scaling.parameters(packed, "x", [train], scale)[0]
    return stored(packed.withColumn("fit", train).withColumn("x", _scaled(scale, found)("x")), name="tensors")


def _fold_grams(dealt: DataFrame, found: np.ndarray, scale: scaling.Scale, sizes: list[int], part: Callable[[np.ndarray], list[np.ndarray]]) -> list[list[np.ndarray]]:
    """Of each fold's training rows (x, own), scaled by the fold's parameters: square matrices of ``sizes``, which ``part`` makes of an array of them.

    As many folds go in one pass as keep what a task adds up to the size of one matrix of ``MOST_CHANNELS``.
    """
    size, k, out = sum(n * n for n in sizes), len(found), []
    at_once = max(1, tensors.MOST_CHANNELS**2 // size)
    for first in range(0, k, at_once):
        turn = range(first, min(k, first + at_once))

        def each(f, turn=turn):
            x, own = np.stack(f["x"].to_numpy()).astype(np.float64), f["own"].to_numpy()
            return np.concatenate([g.ravel() for i in turn for g in part(scale.apply(x[own != i], *found[i]))])

        total = sums.added(dealt.select("x", "own"), len(turn) * size, each).reshape(len(turn), size)
        out += [[g.reshape(n, n) for g, n in zip(np.split(s, np.cumsum([n * n for n in sizes])[:-1]), sizes, strict=True)] for s in total]
    return out


def _dealt(packed: DataFrame, folds: DataFrame) -> DataFrame:
    return stored(packed.select("beam_id", "prompt_id", "y", "x").join(folds.select("prompt_id", F.col("fold").alias("own")), "prompt_id"), name="dealt")


def _others(k: int) -> list[Column]:
    """Of each fold, the rows that train it."""
    return [F.col("own") != i for i in range(k)]


def _fold_factors(dealt: DataFrame, found: np.ndarray, scale: scaling.Scale, shape: tuple[int, int], ranks: tuple[int, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    if shape[1] > tensors.MOST_CHANNELS:
        train = [stored(dealt.where(F.col("own") != i).select(_scaled(scale, p)("x").alias("x")), name="tensors") for i, p in enumerate(found)]
        return [tensors.hosvd(t, *shape, *ranks) for t in train]

    def part(x):
        x = x.reshape(-1, *shape)
        flat = [np.moveaxis(x, mode + 1, 0).reshape(n, -1) for mode, n in enumerate(shape)]
        return [m @ m.T for m in flat]

    return [tuple(tensors._top(g, r) for g, r in zip(grams, ranks, strict=True)) for grams in _fold_grams(dealt, found, scale, list(shape), part)]


def fold_cores(packed: DataFrame, folds: DataFrame, k: int, shape: tuple[int, int], ranks: tuple[int, int]) -> DataFrame:
    """Every row once for each fold (fold, fit): the tensor, scaled by the training rows' medians, in the training rows' factors
    (core), its prompt's mean (centroid) and what is left of it (delta).  ``fit`` marks the training rows.  Stored.

    Folds share the passes for scales, factors and cores.
    """
    dealt = _dealt(packed, folds)
    found = scaling.parameters(dealt, "x", _others(k), scaling.MAD)
    factors = _fold_factors(dealt, found, scaling.MAD, shape, ranks)

    @F.pandas_udf("array<array<double>>")
    def cores(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        x = np.stack(x.to_numpy()).astype(np.float64)
        each = [(l.T @ (scaling.MAD.apply(x, *p).reshape(-1, *shape) @ c)).reshape(len(x), -1) for p, (l, c) in zip(found, factors, strict=True)]
        return pd.Series(np.stack(each, axis=1).tolist())

    out = dealt.select("beam_id", "prompt_id", "y", "own", F.posexplode(cores("x")).alias("fold", "core"))
    out = stored(out.withColumn("fit", F.col("own") != F.col("fold")).drop("own"), name="cores")
    mean = F.array(*[F.avg(F.get("core", F.lit(j))) for j in range(ranks[0] * ranks[1])])
    means = out.groupBy("fold", "prompt_id").agg(mean.alias("centroid"))
    return stored(out.join(means, ["fold", "prompt_id"]).withColumn("delta", F.zip_with("core", "centroid", lambda a, b: a - b)), name="fold-cores")


def grouped_evaluation(cores: DataFrame, k: int, features: list[str], kinds: dict[str, dict]) -> DataFrame:
    """Out-of-fold scores of each detector on each feature of ``fold_cores``: feature, kind, fold, beam_id, prompt_id, y, score.  Stored."""
    parts = []
    for feature in features:
        for i in range(k):
            here = cores.where(F.col("fold") == i).select("beam_id", "prompt_id", "y", "fold", "fit", F.col(feature).alias("features"))
            for kind, options in kinds.items():
                model = detector(kind, here.where("fit"), **options)
                parts.append(scores(model, here.where("not fit")).select(F.lit(feature).alias("feature"), F.lit(kind).alias("kind"), "fold", "beam_id", "prompt_id", "y", "score"))
    return stored(reduce(DataFrame.unionByName, parts), name="out-of-fold")


def evaluation_summary(found: DataFrame) -> DataFrame:
    """Of ``grouped_evaluation``: pooled and within-prompt quality, and mean and deviation over folds."""
    keys = ["feature", "kind"]
    by_fold = ranking.auroc(found, [*keys, "fold"]).groupBy(*keys).agg(F.avg("auroc").alias("fold_mean"), F.stddev_pop("auroc").alias("fold_std"))
    pooled = ranking.auroc(found, keys).withColumnRenamed("auroc", "pooled")
    within = ranking.within_prompt(found, keys).withColumnRenamed("auroc", "within")
    return pooled.join(within, keys, "left").join(by_fold, keys)


def _with_interval(found: DataFrame, key: str, value, drawn: DataFrame, reps: int) -> DataFrame:
    point = ranking.auroc(found.withColumn(key, F.lit(value)), [key])
    return point.join(F.broadcast(ranking.interval(found.select("prompt_id", "y", "score"), drawn, reps=reps)))  # one row


def split_evaluation(packed: DataFrame, split: DataFrame, shape: tuple[int, int], ranks: tuple[int, int], kinds: dict[str, dict], *, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Quality on the validation rows of a split (beam_id or prompt_id, part), with its interval over draws of prompts."""
    key = "beam_id" if "beam_id" in split.columns else "prompt_id"
    dealt = packed.select("beam_id", "prompt_id", "y", "x").join(split.select(key, "part"), key)
    tensor = scaled_tensors(dealt, F.col("part") == "train", shape[1])
    cores = stored(tensors.core(tensor, *tensors.hosvd(tensor.where("fit"), *shape, *ranks)).select("prompt_id", "y", "fit", F.col("core").alias("features")), name="cores")
    rest = cores.where("not fit")
    drawn = ranking._drawn(rest, reps, seed)
    found = {kind: stored(scores(detector(kind, cores.where("fit"), **options), rest).select("prompt_id", "y", "score"), name="scores") for kind, options in kinds.items()}
    parts = [_with_interval(f, "kind", kind, drawn, reps) for kind, f in found.items()]
    return stored(reduce(DataFrame.unionByName, parts), name="split-evaluation")


def layer_readout(packed: DataFrame, folds: DataFrame, k: int, shape: tuple[int, int], rank: int, *, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Of each layer on its own: out-of-fold quality of a logistic readout of its core, with an interval over draws of prompts."""
    layers, channels = shape
    dealt = _dealt(packed, folds)
    found = scaling.parameters(dealt, "x", _others(k), scaling.MAD)
    if channels > tensors.MOST_CHANNELS:
        one = lambda i, layer: dealt.where(F.col("own") != i).select(F.slice(_scaled(scaling.MAD, found[i])("x"), layer * channels + 1, F.lit(channels)).alias("x"))
        factors = [[tensors.hosvd(one(i, layer), 1, channels, 1, rank)[1] for layer in range(layers)] for i in range(k)]
    else:
        factors = [[] for _ in range(k)]
        at_once = max(1, tensors.MOST_CHANNELS**2 // channels**2)  # layers whose Gram matrices a task adds up together
        for first in range(0, layers, at_once):
            turn = range(first, min(layers, first + at_once))
            part = lambda x, turn=turn: [(lambda m: m.T @ m)(x[:, layer * channels : (layer + 1) * channels]) for layer in turn]
            for f, grams in zip(factors, _fold_grams(dealt, found, scaling.MAD, [channels] * len(turn), part), strict=True):
                f += [tensors._top(g, rank) for g in grams]

    @F.pandas_udf("array<array<array<double>>>")
    def cores(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        x = np.stack(x.to_numpy()).astype(np.float64)
        each = [np.stack([t[:, j] @ u for j, u in enumerate(f)], axis=1) for f, t in ((f, scaling.MAD.apply(x, *p).reshape(-1, *shape)) for p, f in zip(found, factors, strict=True))]
        return pd.Series(np.stack(each, axis=1).tolist())

    rows = dealt.select("prompt_id", "y", "own", F.posexplode(cores("x")).alias("fold", "core"))
    rows = stored(rows.select("prompt_id", "y", "own", "fold", *[F.get("core", F.lit(layer)).alias(f"c{layer}") for layer in range(layers)]), name="cores")
    parts: list[DataFrame] = []
    for i in range(k):
        here = rows.where(F.col("fold") == i)
        for layer in range(layers):
            one = here.select("prompt_id", "y", (F.col("own") != i).alias("fit"), F.col(f"c{layer}").alias("features"))
            parts.append(scores(detector("logistic", one.where("fit")), one.where("not fit")).select(F.lit(layer).alias("layer"), "prompt_id", "y", "score"))
    scored = stored(reduce(DataFrame.unionByName, parts), name="layer-scores")
    drawn = ranking._drawn(scored, reps, seed)
    by = [_with_interval(scored.where(F.col("layer") == layer), "layer", layer, drawn, reps) for layer in range(layers)]
    return stored(reduce(DataFrame.unionByName, by), name="layer-readout")


def quadratic_readout(train: DataFrame, rows: DataFrame, *, components: int = 32, c: float = 1.0) -> DataFrame:
    """Scores of a logistic model on the training rows' principal components and their products; 0.5 with one class alone."""
    n, first, second = tensors.moments(train, "features")
    if train.select("y").distinct().count() < 2:
        return rows.withColumn("score", F.lit(0.5))
    mean = first / n
    k = min(components, len(mean), max(1, n - 1))
    v = tensors._top(second / n - np.outer(mean, mean), k)
    expand = lambda d: tensors.times(d, v, -mean @ v, "features").withColumn("features", columns.degree2(F.col("features")))
    return scores(detector("logistic", expand(train), c=c), expand(rows))


def centroid_distance(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Distance to the centroid of truthful training rows less that to the other class; above 0 is called y = 1."""
    cells = train.select("y", F.posexplode("features").alias("i", "v"))
    means = cells.groupBy("i").agg(F.avg(F.when(F.col("y") == 0, F.col("v"))).alias("m0"), F.avg(F.when(F.col("y") == 1, F.col("v"))).alias("m1"))
    long = rows.select("beam_id", "y", F.posexplode("features").alias("i", "v")).join(means, "i")
    far = lambda m: F.sqrt(F.sum((F.col("v") - F.col(m)) ** 2))
    return long.groupBy("beam_id", "y").agg((far("m0") - far("m1")).alias("score"))


def _both_detectors(rows: DataFrame, feature: str, column: str, kinds: dict[str, dict]) -> list[DataFrame]:
    """Validation rows' scores by detectors of the training rows, in the form of ``grouped_evaluation``."""
    here = rows.select("beam_id", "prompt_id", "y", "fold", "fit", F.col(column).alias("features"))
    found = [(kind, scores(detector(kind, here.where("fit"), **options), here.where("not fit"))) for kind, options in kinds.items()]
    return [f.select(F.lit(feature).alias("feature"), F.lit(kind).alias("kind"), "fold", "beam_id", "prompt_id", "y", "score") for kind, f in found]


def contrast_evaluation(cores: DataFrame, k: int, kinds: dict[str, dict], *, components: int = 32) -> DataFrame:
    """Of ``fold_cores``: out-of-fold scores on the contrast block alone (block), and on the core with what the core doesn't explain of it (fused).  Stored."""
    parts = []
    for i in range(k):
        here = cores.where(F.col("fold") == i).select("beam_id", "prompt_id", "y", "fold", "fit", "core")
        found = tensors.contrast(here, F.col("fit"), components)
        block = F.concat("scores", F.array(*[c for c in found.columns if c not in ("beam_id", "scores")]))
        rows = stored(here.join(found.select("beam_id", block.alias("block")), "beam_id"), name="contrast")
        fused = conditions.fused_residual(rows, rows.where("fit"), "core", column="block")
        parts += _both_detectors(rows, "block", "block", kinds) + _both_detectors(fused, "fused", "fused", kinds)
    return stored(reduce(DataFrame.unionByName, parts), name="out-of-fold")


def stacked_evaluation(tokens: DataFrame, cores: DataFrame, folds: DataFrame, k: int, kinds: dict[str, dict], *, inner: int = 3, reader: str = "logistic", **options) -> DataFrame:
    """Out-of-fold scores on the core with what it doesn't explain of six numbers of an answer's token scores.  Stored.

    ``tokens`` are beam_id, prompt_id, y, pos and features, which training tokens scale.  Validation tokens are scored by the reader of
    all training tokens.  Training tokens are scored by readers of the other inner folds, so no token's score comes from a reader
    that saw its prompt.
    """
    dealt = stored(tokens.select("beam_id", "prompt_id", "y", "pos", "features").join(folds.select("prompt_id", F.col("fold").alias("own")), "prompt_id"), name="dealt")
    scales = scaling.parameters(dealt, "features", _others(k), scaling.WINSOR_IQR)
    parts = []
    for i in range(k):
        read = stored(dealt.withColumn("fit", F.col("own") != i).withColumn("features", _scaled(scaling.WINSOR_IQR, scales[i])("features")).drop("own"), name="tokens")
        train, rest = read.where("fit"), read.where("not fit")
        found = scores(detector(reader, train, **options), rest).unionByName(out_of_fold(reader, train, splits.folds(train, inner), inner, **options).drop("fold"))
        here = cores.where(F.col("fold") == i).select("beam_id", "prompt_id", "y", "fold", "fit", "core")
        six = pooling.beam_summary(found, here)
        rows = stored(here.join(six.select("beam_id", F.array(*[c for c in six.columns if c != "beam_id"]).alias("block")), "beam_id"), name="stacked")
        parts += _both_detectors(conditions.fused_residual(rows, rows.where("fit"), "core", column="block"), "stacked", "fused", kinds)
    return stored(reduce(DataFrame.unionByName, parts), name="out-of-fold")


def ladder(packed: DataFrame, folds: DataFrame, k: int, shape: tuple[int, int], ranks: tuple[int, int], steps: dict[str, Callable[[DataFrame, Column], DataFrame]], kinds: dict[str, dict]) -> DataFrame:
    """Out-of-fold scores on cores after each way to prepare the tensors, which takes (tensors, which rows train) and returns them with ``fit``.  Stored."""
    dealt = packed.select("beam_id", "prompt_id", "y", "x").join(folds, "prompt_id")
    parts = []
    for name, prepared in steps.items():
        for i in range(k):
            tensor = prepared(dealt, F.col("fold") != i).withColumn("fold", F.lit(i))
            parts += _both_detectors(tensors.core(tensor, *tensors.hosvd(tensor.where("fit"), *shape, *ranks)), name, "core", kinds)
    return stored(reduce(DataFrame.unionByName, parts), name="out-of-fold")


def stream_conditions(cores: DataFrame, blocks: dict[str, DataFrame], k: int, kinds: dict[str, dict], *, alone: dict[str, DataFrame] | None = None) -> DataFrame:
    """Out-of-fold scores on the core, on the core with what it doesn't explain of each block, and of all blocks (combined).  Stored.

    ``cores`` are of ``fold_cores``.  Blocks are (beam_id, block), with a fold where they follow from its training rows, and so are those of ``alone``,
    which take the core's place.
    """
    parts, blocks, alone = [], {n: b.withColumnRenamed("block", f"b_{n}") for n, b in blocks.items()}, alone or {}
    for i in range(k):
        here = cores.where(F.col("fold") == i).select("beam_id", "prompt_id", "y", "fold", "fit", "core")
        own = lambda b: b.where(F.col("fold") == i).drop("fold") if "fold" in b.columns else b  # noqa: B023, E731
        rows = here
        for b in blocks.values():
            rows = rows.join(own(b), "beam_id")
        for name in blocks:
            rows = conditions.fused_residual(rows, rows.where("fit"), "core", column=f"b_{name}", name=f"f_{name}")
            rows = stored(rows, name="fused")
        parts += _both_detectors(rows, "core", "core", kinds)
        rest = lambda n: F.slice(f"f_{n}", F.size("core") + 1, F.size(f"b_{n}"))
        for name in blocks:
            parts += _both_detectors(rows, name, f"f_{name}", kinds)
        if len(blocks) > 1:
            parts += _both_detectors(rows.withColumn("all", F.concat("core", *map(rest, blocks))), "combined", "all", kinds)
        for name, b in alone.items():
            parts += _both_detectors(stored(here.drop("core").join(own(b), "beam_id"), name="alone"), name, "block", kinds)
    return stored(reduce(DataFrame.unionByName, parts), name="out-of-fold")
