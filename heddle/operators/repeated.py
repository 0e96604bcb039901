"""Repeated grouped cross-validation, all repeats and folds in one pass.

A model belongs to a repeat and a fold and is trained on the other folds.  What can be added up is added up once for each fold, and a
model's share is all less its own fold: counts of classes and the Gram matrices behind its factors.  Newton steps
are taken for all models together, so the number of jobs doesn't depend on repeats or folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions import ranks, sums
from heddle.operators import conditions, ranking, tensors
from heddle.sources.scratch import stored

#: Newton steps at most, and the largest change of a coefficient at which they end.
STEPS, CLOSE = 25, 1e-9


def repeated_folds(rows: DataFrame, k: int = 5, repeats: int = 5, *, seed: int = 42) -> DataFrame:
    """(prompt_id, folds): a prompt's fold in each repeat, dealt in turn in the order of the repeat's hash."""
    each = rows.select("prompt_id").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    keyed = each.withColumn("_key", F.sha2(F.concat_ws(":", F.col("repeat") + seed, "prompt_id"), 256))
    placed = ranks.running_total(keyed, ["repeat"], "_key", ranks.by_hash(F.col("_key")), F.lit(1), "place")
    at = F.array_sort(F.collect_list(F.struct("repeat", (F.col("place") % k).cast("int").alias("fold"))))  # a row a repeat
    return placed.groupBy("prompt_id").agg(F.transform(at, lambda f: f["fold"]).alias("folds"))


@dataclass
class Models:
    """One model for each repeat and fold, in that order; arrays have a row for each."""

    k: int
    repeats: int
    #: Layer and channel factors of each model, or None where features are taken as they are.
    factors: list[tuple[np.ndarray, np.ndarray]] | None
    #: Weights of the classes 0 and 1, means, deviations, and coefficients with the intercept last.
    weight: np.ndarray
    #: How many rows train each model.
    rows: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None

    @property
    def n(self) -> int:
        return self.k * self.repeats

    def width(self, rows: DataFrame) -> int:
        return len(rows.select("x").first()[0]) if self.factors is None else self.factors[0][0].shape[1] * self.factors[0][1].shape[1]

    def features(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Each model's raw features of tensors or vectors laid out as rows."""
        for m in range(self.n):
            if self.factors is None:
                yield x
            else:
                l, c = self.factors[m]
                yield np.einsum("nlc,lr,cs->nrs", x.reshape(len(x), len(l), len(c)), l, c, optimize=True).reshape(len(x), -1)

    def design(self, x: np.ndarray) -> Iterator[np.ndarray]:
        for m, z in enumerate(self.features(x)):
            yield np.concatenate([(z - self.mean[m]) * self.scale[m], np.ones((len(z), 1))], axis=1)

    def trains(self, folds: np.ndarray) -> Iterator[np.ndarray]:
        """Which rows train each model, from their folds by repeat."""
        for m in range(self.n):
            yield folds[:, m // self.k] != m % self.k


def _arrays(frame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(frame["x"].to_numpy()).astype(np.float64), frame["y"].to_numpy(), np.stack(frame["folds"].to_numpy())


def _summed(rows: DataFrame, size: int, part) -> np.ndarray:
    return sums.added(rows.select("x", "y", "folds"), size, lambda f: part(*_arrays(f)))


def _by_fold(rows: DataFrame, k: int, repeats: int, size: int, part) -> np.ndarray:
    """Sums of ``part`` over the rows that train each model: all of them less the model's own fold."""

    def each(x, y, folds):
        out = np.zeros((repeats * k + 1, size))
        out[-1] = part(x, y)
        for r in range(repeats):
            for f in range(k):
                own = folds[:, r] == f
                out[r * k + f] = part(x[own], y[own])
        return out

    total = _summed(rows, (repeats * k + 1) * size, each).reshape(-1, size)
    return total[-1] - total[:-1]


def _started(rows: DataFrame, k: int, repeats: int, shape: tuple[int, int] | None, ranks: list[tuple[int, int]] | None) -> list[Models]:
    """Models of each rank without coefficients: class weights and, by one decomposition at the greatest rank, factors."""
    if shape:
        l, ch = shape

        def grams(x, y):
            t = x.reshape(-1, l, ch)
            return np.concatenate([[(y == 0).sum(), (y == 1).sum()], np.einsum("nlc,nmc->lm", t, t).ravel(), np.einsum("nlc,nld->cd", t, t).ravel()])

        stats = _by_fold(rows, k, repeats, 2 + l * l + ch * ch, grams)
        top = max(r for r, _ in ranks), max(r for _, r in ranks)
        whole = [(tensors._top(s[2 : 2 + l * l].reshape(l, l), top[0]), tensors._top(s[2 + l * l :].reshape(ch, ch), top[1])) for s in stats]
        factors = [[(u[:, :a], v[:, :b]) for u, v in whole] for a, b in ranks]
    else:
        stats = _by_fold(rows, k, repeats, 2, lambda x, y: np.array([(y == 0).sum(), (y == 1).sum()]))
        factors = [None]
    counts = stats[:, :2]
    return [Models(k, repeats, f, counts.sum(1)[:, None] / (2 * np.maximum(counts, 1)), counts.sum(1)) for f in factors]


def fitted(rows: DataFrame, k: int, repeats: int, *, shape: tuple[int, int] | None = None, rank: tuple[int, int] | None = None, c: float = 1.0) -> Models:
    """A logistic model for each repeat and fold, on rows (x, y, folds), with balanced classes and standard scores of training rows.

    With ``shape`` and ``rank``, x is a packed tensor and its features are the core in the factors of the model's training rows.
    """
    return _newton(rows, _started(rows, k, repeats, shape, [rank])[0], c)


def fitted_ranks(rows: DataFrame, k: int, repeats: int, shape: tuple[int, int], ranks: list[tuple[int, int]], *, c: float = 1.0) -> list[Models]:
    """``fitted`` for several ranks: factors are nested, so one decomposition at the greatest serves all, and all ranks take their steps in the same passes."""
    return _together(rows, _started(rows, k, repeats, shape, ranks), c)


def _newton(rows: DataFrame, models: Models, c: float) -> Models:
    return _together(rows, [models], c)[0]


def _each(rows: DataFrame, many: list[Models], sizes: list[int], part) -> list[np.ndarray]:
    """The sums of ``part``, a row a model and ``sizes`` wide, for several sets of models in one pass."""
    found = _summed(rows, sum(m.n * s for m, s in zip(many, sizes, strict=True)), lambda x, y, folds: np.concatenate([np.ravel(part(m, x, y, folds)) for m in many]))
    return [f.reshape(m.n, s) for f, m, s in zip(np.split(found, np.cumsum([m.n * s for m, s in zip(many, sizes, strict=True)])[:-1]), many, sizes, strict=True)]


def _together(rows: DataFrame, many: list[Models], c: float) -> list[Models]:
    """Fits several sets of models; a pass serves all of them that still move."""
    widths = [m.width(rows) for m in many]
    totals = _each(rows, many, widths, lambda m, x, y, folds: np.stack([z[t].sum(0) for z, t in zip(m.features(x), m.trains(folds), strict=True)]))
    for m, total in zip(many, totals, strict=True):
        m.mean = total / np.maximum(m.rows, 1)[:, None]
    # A second pass about the means, so that large ones cost no digits.
    spread = _each(rows, many, widths, lambda m, x, y, folds: np.stack([((z[t] - mean) ** 2).sum(0) for z, t, mean in zip(m.features(x), m.trains(folds), m.mean, strict=True)]))
    for m, width, s in zip(many, widths, spread, strict=True):
        deviation = np.sqrt(s / np.maximum(m.rows - 1, 1)[:, None])
        m.scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
        m.w = np.zeros((m.n, width + 1))

    def step(models, x, y, folds):
        q = models.w.shape[1]
        out = np.zeros((models.n, q + q * q))
        for m, (d, t) in enumerate(zip(models.design(x), models.trains(folds), strict=True)):
            d, yt = d[t], y[t]
            p = 1 / (1 + np.exp(-np.clip(d @ models.w[m], -500, 500)))
            u = models.weight[m][yt]
            out[m, :q] = d.T @ (u * (p - yt))
            out[m, q:] = ((d * (u * p * (1 - p))[:, None]).T @ d).ravel()
        return out

    moving = list(many)
    for _ in range(STEPS):
        sizes = [m.w.shape[1] for m in moving]
        left = []
        for models, q, found in zip(moving, sizes, _each(rows, moving, [q + q * q for q in sizes], step), strict=True):
            ridge = np.append(np.full(q - 1, 1 / c), 0.0)
            change = np.zeros_like(models.w)
            for m in range(models.n):
                h = found[m, q:].reshape(q, q) + np.diag(ridge)
                change[m] = np.linalg.lstsq(h, found[m, :q] + ridge * models.w[m], rcond=None)[0]
            models.w = models.w - change
            left += [models] if np.abs(change).max(initial=0) >= CLOSE else []
        moving = left
        if not moving:
            break
    return many


def held_out(rows: DataFrame, models: Models) -> DataFrame:
    """(beam_id, prompt_id, y, repeat, fold, score): each row scored, in every repeat, by the model that didn't see its prompt."""
    schema = "beam_id long, prompt_id long, y int, repeat int, fold int, score double"

    def task(frames):
        import pandas as pd

        for f in frames:
            if not len(f):
                continue
            x, y, folds = _arrays(f)
            score = np.zeros((len(f), models.repeats))
            for m, (d, t) in enumerate(zip(models.design(x), models.trains(folds), strict=True)):
                score[~t, m // models.k] = 1 / (1 + np.exp(-np.clip(d[~t] @ models.w[m], -500, 500)))
            each = lambda c: np.repeat(f[c].to_numpy(), models.repeats)
            yield pd.DataFrame(
                {"beam_id": each("beam_id"), "prompt_id": each("prompt_id"), "y": each("y"), "repeat": np.tile(np.arange(models.repeats), len(f)), "fold": folds.ravel(), "score": score.ravel()}
            )

    return rows.select("beam_id", "prompt_id", "y", "x", "folds").mapInPandas(task, schema)


def _dealt(packed: DataFrame, k: int, repeats: int, seed: int) -> DataFrame:
    rows = packed.select("beam_id", "prompt_id", "y", F.col("x").cast("array<double>").alias("x"))
    return stored(rows.join(repeated_folds(packed, k, repeats, seed=seed), "prompt_id"), name="dealt")


def rank_probe(packed: DataFrame, shape: tuple[int, int], ranks: list[tuple[int, int]], *, k: int = 5, seed: int = 42, reps: int = 1000, c: float = 1.0) -> DataFrame:
    """Of each rank: pooled and within-prompt quality out of fold, and pooled differences to the first rank with an interval (null for itself)."""
    dealt = _dealt(packed, k, 1, seed)
    found = {"x".join(map(str, r)): held_out(dealt, m) for r, m in zip(ranks, fitted_ranks(dealt, k, 1, shape, ranks, c=c), strict=True)}
    names = list(found)
    wide = None
    for name, one in found.items():
        one = one.select("beam_id", *(["prompt_id", "y"] if wide is None else []), F.col("score").alias(name))
        wide = one if wide is None else wide.join(one, "beam_id")
    wide = stored(wide, name="ranks")
    long = wide.select("beam_id", "prompt_id", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("rank"), F.col(n).alias("score")) for n in names])).alias("r")).select("beam_id", "prompt_id", "y", "r.*")
    quality = ranking.auroc(long, ["rank"]).withColumnRenamed("auroc", "pooled").join(ranking.within_prompt(long, ["rank"]).select("rank", F.col("auroc").alias("within")), "rank", "left")
    deltas = conditions.against(wide, names[1:], names[:1], reps=reps, seed=seed).where("metric = 'pooled'").select(F.col("condition").alias("rank"), "mean", "lo", "hi", "excludes_zero")
    return quality.join(deltas, "rank", "left")


def ranks_adopted(probes: DataFrame, improves: str, keeps: str) -> DataFrame:
    """(rank, adopt) from probes of two datasets: a rank is adopted if it improves significantly on one and loses significantly on none of both."""
    sure = F.coalesce("excludes_zero", F.lit(False))
    better = F.max(sure & (F.col("mean") > 0) & (F.col("dataset") == improves))
    worse = F.max(sure & (F.col("mean") < 0) & F.col("dataset").isin(improves, keeps))
    return probes.where("mean IS NOT NULL").groupBy("rank").agg((better & ~worse).alias("adopt"))


def repeated_cv(packed: DataFrame, *, k: int = 5, repeats: int = 5, seed: int = 42, shape: tuple[int, int] | None = None, rank: tuple[int, int] | None = None, c: float = 1.0) -> DataFrame:
    """Out-of-fold scores of all repeats, as ``held_out``.  Stored.  Rows are beam_id, prompt_id, y and x."""
    dealt = _dealt(packed, k, repeats, seed)
    return stored(held_out(dealt, fitted(dealt, k, repeats, shape=shape, rank=rank, c=c)), name="repeated")


def summary(found: DataFrame) -> DataFrame:
    """One row: mean and deviation, over repeats, of pooled and within-prompt quality, and over all folds of all repeats."""
    spread = lambda d, name: d.agg(F.avg("auroc").alias(f"{name}_mean"), F.stddev_pop("auroc").alias(f"{name}_std"))
    parts = [spread(ranking.auroc(found, ["repeat"]), "pooled"), spread(ranking.within_prompt(found, ["repeat"]), "within"), spread(ranking.auroc(found, ["repeat", "fold"]), "fold")]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # a row each


def compared(a: DataFrame, b: DataFrame, *, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Paired differences of two conditions' repeated scores, pooled and within prompts: every repeat's scores stand in one bootstrap."""
    both = a.withColumnRenamed("score", "one").join(b.select("beam_id", "repeat", F.col("score").alias("two")), ["beam_id", "repeat"])
    parts = [ranking.paired_delta_over_repeats(both, "one", "two", reps=reps, seed=seed, within=w).withColumn("metric", F.lit(n)) for n, w in (("pooled", False), ("within", True))]
    return parts[0].unionByName(parts[1])
