"""Folds and choices of training rows share their passes."""

import numpy as np
from pyspark.sql import functions as F

from heddle.functions import ranks
from heddle.operators import conditions, models, ranking, repeated, scaling, splits, tensors


def _packed(spark, n=120, shape=(3, 4), seed=0):
    x = np.random.default_rng(seed).normal(size=(n, shape[0] * shape[1])).round(1)  # with ties
    rows = [(i, i // 4, i % 2, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, x array<double>")


def test_parameters_of_several_choices_equal_those_by_cells(spark):
    x, packed = _packed(spark)
    fits = [F.col("prompt_id") % 3 != i for i in range(3)] + [F.col("prompt_id") < 0]
    for scale in (scaling.MAD, scaling.WINSOR_IQR):
        found, cells = scaling.parameters(packed, "x", fits, scale), scaling.parameters(packed, "x", fits[:3], scale, most=10)
        assert found.shape == (4, len(scale.names), 12) and np.isnan(found[3]).all()
        assert np.array_equal(found[:3], cells)
    mid = np.stack([np.median(x[(np.arange(120) // 4) % 3 != i], axis=0) for i in range(3)])
    assert np.allclose(scaling.parameters(packed, "x", fits[:3], scaling.MAD)[:, 0], mid)


def test_null_numbers_count_for_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, None]), (1, [2.0, 5.0]), (1, [9.0, 7.0]), (0, [100.0, 100.0])], "y int, x array<double>")
    assert scaling.parameters(rows, "x", [F.col("y") == 1], scaling.MAD).tolist() == [[[2.0, 6.0], [1.0, 1.0]]]


def test_fold_cores_take_no_pass_by_cells_and_equal_each_fold_alone(spark, monkeypatch):
    x, packed = _packed(spark)
    folds = splits.folds(packed, 3)
    monkeypatch.setattr(ranks, "quantiles", lambda *a: (_ for _ in ()).throw(AssertionError("by cells")))
    got = models.fold_cores(packed, folds, 3, (3, 4), (2, 2)).toPandas()
    own = {r.prompt_id: r.fold for r in folds.collect()}
    fold = np.array([own[i // 4] for i in range(120)])
    assert len(got) == 360
    for i in range(3):
        fit = fold != i
        mid = np.median(x[fit], axis=0)
        t = ((x - mid) / (np.median(np.abs(x[fit] - mid), axis=0) + 1e-6)).reshape(-1, 3, 4)
        u = tensors._top(np.einsum("nlc,nmc->lm", t[fit], t[fit]), 2), tensors._top(np.einsum("nlc,nld->cd", t[fit], t[fit]), 2)
        core = np.einsum("nlc,lr,cs->nrs", t, *u).reshape(120, -1)
        here = got[got.fold == i].sort_values("beam_id")
        assert (here.fit.to_numpy() == fit).all() and np.allclose(np.stack(here.core), core)
        assert np.allclose(np.stack(here.centroid), np.repeat(core.reshape(30, 4, -1).mean(1), 4, axis=0))
        assert np.allclose(np.stack(here.delta), np.stack(here.core) - np.stack(here.centroid))


def test_layers_share_their_draws(spark, monkeypatch):
    _, packed = _packed(spark)
    drawn, one = [], ranking._drawn
    monkeypatch.setattr(ranking, "_drawn", lambda *a: drawn.append(1) or one(*a))
    found = models.layer_readout(packed, splits.folds(packed, 2), 2, (3, 4), 2, reps=20).toPandas()
    assert sorted(found.layer) == [0, 1, 2] and found.auroc.between(0, 1).all() and len(drawn) == 1


def test_forests_read_few_parts_however_the_rows_lie(spark, monkeypatch):
    """What a forest shuffles grows with the parts of its table."""
    _, packed = _packed(spark)
    rows, seen, one = packed.withColumnRenamed("x", "features").repartition(40), [], models.detector
    monkeypatch.setattr(models, "detector", lambda kind, train, **o: seen.append(train.rdd.getNumPartitions()) or one(kind, train, **o))
    found = models.out_of_fold("forest", rows, splits.folds(rows, 2), 2, trees=2)
    assert found.count() == 120 and len(seen) == 2 and max(seen) <= 8


def test_ranks_take_their_steps_in_the_same_passes(spark, monkeypatch):
    _, packed = _packed(spark)
    dealt, passes, one = repeated._dealt(packed, 2, 1, 42), [], repeated._summed
    monkeypatch.setattr(repeated, "_summed", lambda *a: passes.append(1) or one(*a))
    both = repeated.fitted_ranks(dealt, 2, 1, (3, 4), [(2, 1), (2, 2)])
    together, passes[:] = len(passes), []
    alone = [repeated.fitted(dealt, 2, 1, shape=(3, 4), rank=r) for r in [(2, 1), (2, 2)]]
    assert together <= len(passes) / 2 + 1
    for a, b in zip(both, alone, strict=True):
        np.testing.assert_allclose(a.w, b.w, atol=1e-8)


def test_a_constant_number_leaves_nothing_of_itself(spark):
    """Rounding in it isn't blown up to a feature."""
    base = np.random.default_rng(0).normal(size=(97, 2))
    rows = spark.createDataFrame([(b.tolist(), [float(np.log(8)), float(b[0] ** 2)]) for b in base], "base array<double>, features array<double>").repartition(4)
    got = np.stack(conditions.fused_residual(rows, rows, "base").toPandas()["fused"])
    assert (got[:, 2] == 0).all() and abs(got[:, 3].std() - 1) < 1e-6 and abs(got[:, 3].mean()) < 1e-9
