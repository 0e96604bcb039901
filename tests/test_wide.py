"""Tensors of the width that states have, in little memory."""

import resource

import numpy as np
from pyspark.sql import functions as F

from heddle.operators import conditions, ranking, tensors

LAYERS, CHANNELS = 9, 2048


def test_nine_layers_of_2048_channels(spark):
    """Factors, projections and common directions: nothing on the driver grows beyond a mode's square."""
    rng = np.random.default_rng(0)
    u = np.linalg.qr(rng.normal(size=(CHANNELS, 3)))[0]
    x = np.einsum("nlr,cr->nlc", rng.normal(size=(40, LAYERS, 3)) * [9, 5, 3], u) + 0.01 * rng.normal(size=(40, LAYERS, CHANNELS))
    rows = spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "beam_id long, x array<double>").repartition(4)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    u_l, u_c = tensors.hosvd(rows, LAYERS, CHANNELS, 5, 3)
    assert np.linalg.svd(u.T @ u_c, compute_uv=False).min() > 0.999
    cores = np.array([r.core for r in tensors.core(rows, u_l, u_c).orderBy("beam_id").select("core").collect()])
    np.testing.assert_allclose(cores, np.einsum("nlc,li,cj->nij", x, u_l, u_c).reshape(40, -1), atol=1e-8)
    by_rounds = tensors.hosvd(rows, LAYERS, CHANNELS, 5, 3, most=1024)[1]
    assert np.linalg.svd(u_c.T @ by_rounds, compute_uv=False).min() > 0.999
    few = rows.select("beam_id", F.slice("x", 1, 2 * CHANNELS).alias("x"))
    left = np.array([r.x for r in conditions.without_common(few, few, 3, 2, column="x").orderBy("beam_id").select("x").collect()])
    assert np.abs(left).mean() < 0.02 < np.abs(x[:, :2]).mean()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 1500


def test_draws_of_frequent_scores(spark):
    """Pooled quality of bootstrap draws where a few scores have most rows, against numpy."""
    rng = np.random.default_rng(1)
    score = np.where(rng.random(3000) < 0.6, 0.5, np.round(rng.normal(size=3000), 3))
    y, prompt = rng.integers(0, 2, 3000), np.arange(3000) // 6
    rows = spark.createDataFrame([(int(p), int(a), float(s)) for p, a, s in zip(prompt, y, score, strict=True)], "prompt_id long, y int, score double").repartition(5)
    drawn = {r.prompt_id: np.frombuffer(r.k, "<u2") for r in ranking._drawn(rows, 30, 42).collect()}
    table = {(r.rep, r.prompt_id): r.k for r in ranking.draws(rows, 30, 42).collect()}
    assert all(drawn[p][rep] == table.get((rep, p), 0) for p in drawn for rep in range(30))
    got = {r.rep: r.auroc for r in ranking._replicates(rows, ranking._drawn(rows, 30, 42), False, 30).collect()}
    for rep in range(30):
        k = np.array([drawn[p][rep] for p in prompt])
        a, b = (y == 1) & (k > 0), (y == 0) & (k > 0)
        won = (score[a][:, None] > score[b]) + (score[a][:, None] == score[b]) / 2
        want = (won * k[a][:, None] * k[b]).sum() / (k[a].sum() * k[b].sum())
        assert abs(got[rep] - want) < 1e-12
    sparse = rows.where("y = 1")
    assert ranking._replicates(sparse, ranking._drawn(sparse, 5, 1), False, 5).count() == 0


def test_round_trips_hold_one_text_at_a_time(monkeypatch):
    import pandas as pd
    import public_tokenizers
    from heddle.operators import validation

    path, most = public_tokenizers.path("byte_bpe_50k.json"), [0]

    class One:
        def __init__(self, t):
            self.decode, self.encode = t.decode, lambda *a, **b: (most.__setitem__(0, most[0] + 1), t.encode(*a, **b))[1]

    from tokenizers import Tokenizer

    monkeypatch.setattr(validation, "_tokenizer", lambda p, t=One(Tokenizer.from_file(path)): t)
    udf = []
    monkeypatch.setattr(validation.F, "pandas_udf", lambda kind: lambda f: udf.append(f) or (lambda c: c))
    validation.round_trips("a", path)
    assert udf[0](pd.Series(["plain words", None, "", "Straße\n 7"])).tolist() == [True, pd.NA, True, True] and most[0] == 6


def test_splits_of_a_bin_meet_before_all_bins_do(spark):
    """One frame of all bins has a row a bin; the splits of a frequent score, 64 a bin, don't get there."""
    one = np.ones(3).tobytes()
    bins = spark.createDataFrame([(b, one, one, one) for b in (1, 3, 4) for _ in range(64 if b % 2 else 1)], "bin int, n1 binary, n0 binary, won binary")
    found = ranking._over_bins(bins, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2 and "hashpartitioning(bin" in plan
    want = (64 * 64 / 2 + 64 * 64 + 64 * 64 / 2 + 128 + 1) / (129 * 129)
    assert [r.rep for r in found.orderBy("rep").collect()] == [0, 1, 2] and all(np.isclose(r.auroc, want) for r in found.collect())


def test_small_shards_are_no_files_of_their_own(spark, tmp_path):
    from heddle.sources import packed

    rows = spark.range(4000).selectExpr("id div 4 AS beam_id", "id div 40 AS prompt_id", "0 AS y", "cast(id % 4 as int) AS pos", "id * 1.0D AS score")
    packed.write(rows, str(tmp_path / "s"), ["score"], most_bytes=64)
    beams, tokens = packed.read(spark, str(tmp_path / "s"))
    assert beams.agg({"shard": "max"}).first()[0] == 249 and tokens.count() == 4000
    assert [r.start for r in beams.orderBy("beam_id").collect()] == list(range(0, 4000, 4))
    assert len(list((tmp_path / "s").rglob("part-*"))) < 40


def test_prompts_are_drawn_once_for_all_pairs(spark, monkeypatch):
    rng, drawn, measured = np.random.default_rng(1), [], []
    rows = spark.createDataFrame([(i // 5, int(i % 3 == 0), *map(float, rng.integers(0, 9, 3))) for i in range(100)], "prompt_id long, y int, a double, b double, c double")
    one, two = ranking._drawn, ranking._replicates
    each = {(p, m): tuple(ranking.paired_delta(rows, *p, reps=40, within=m == "within").first()) for p in (("a", "b"), ("a", "c"), ("b", "c")) for m in ("pooled", "within")}
    monkeypatch.setattr(ranking, "_drawn", lambda *x: drawn.append(1) or one(*x))
    monkeypatch.setattr(ranking, "_replicates", lambda *x: measured.append(1) or two(*x))
    found = conditions.replayed(rows, ["a", "b", "c"], reps=40).collect()
    assert (len(drawn), len(measured)) == (1, 6)
    assert len(found) == 6 and all(np.allclose(tuple(r)[3:], each[(r.condition, r.baseline), r.metric]) for r in found)
