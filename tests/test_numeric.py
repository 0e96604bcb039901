"""Queries that SQL cannot express, against plain numpy over the same tables."""

import numpy as np
import pandas as pd
import pytest

from heddle import catalog
from heddle.operators import models, splits, tensors

SF = "/root/testdata/sf0.001"
RANKS = (3, 4)


@pytest.fixture(scope="module")
def data():
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.stack(e["embedding"]).astype(float).reshape(-1, 8, 8)
    prompt = e["vec_id"].to_numpy() // 10
    return e["vec_id"].to_numpy(), prompt, (e["label"].to_numpy() >= prompt % 11).astype(int), x


def run(spark, name, order="beam_id"):
    return catalog.QUERIES[name](spark, SF).toPandas().sort_values(order).reset_index(drop=True)


def signed(u):
    return u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def by_svd(x, mode, rank):
    return signed(np.linalg.svd(np.moveaxis(x, mode + 1, 0).reshape(x.shape[mode + 1], -1), full_matrices=False)[0][:, :rank])


def factors(x):
    return by_svd(x, 0, RANKS[0]), by_svd(x, 1, RANKS[1])


def cores(x, u_l, u_c):
    return np.einsum("nlc,li,cj->nij", x, u_l, u_c).reshape(len(x), -1)


def logistic(x, y):
    """Balanced ridge-penalised logistic model on standardised columns, by Newton's method."""
    mid, dev = x.mean(0), x.std(0, ddof=1)
    z = np.column_stack([np.ones(len(x)), (x - mid) / dev])
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    b, ridge = np.zeros(z.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (y - p)) - ridge @ b)
    return lambda v: 1 / (1 + np.exp(-(b[0] + (v - mid) / dev @ b[1:])))


def auroc(y, s):
    a, b = s[y == 1][:, None], s[y == 0][None]
    return ((a > b) + (a == b) / 2).mean()


def within(prompt, y, s):
    won = [(auroc(y[m], s[m]), (y[m] == 1).sum() * (y[m] == 0).sum()) for p in np.unique(prompt) for m in [prompt == p] if 0 < y[m].sum() < m.sum()]
    return sum(a * n for a, n in won) / sum(n for _, n in won)


def mad(x, train):
    mid = np.median(x[train], axis=0)
    return (x - mid) / (np.median(np.abs(x[train] - mid), axis=0) + 1e-6)


def test_factors_and_what_they_leave(spark, data):
    beam, prompt, y, x = data
    train = prompt % 5 != 0
    u_l, u_c = factors(x[train])
    got = run(spark, "hosvd_core")
    assert np.allclose(np.stack(got["core"]), cores(x, u_l, u_c), atol=1e-5)
    q = run(spark, "q_statistic")
    rest = x - np.einsum("nlc,lm,cd->nmd", x, u_l @ u_l.T, u_c @ u_c.T)
    assert np.allclose(q["q"], (rest**2).sum((1, 2)), atol=1e-5)
    assert np.allclose(np.stack(q["q_layers"]), ((x - x @ u_c @ u_c.T) ** 2).sum(2), atol=1e-5)
    random = run(spark, "hosvd_random")
    assert np.allclose(np.abs(np.stack(random["core"])).sum(), np.abs(cores(x, u_l, u_c)).sum(), rtol=0.05)
    heads = x.reshape(-1, 8, 2, 4)
    u = [by_svd(heads[train], m, r) for m, r in enumerate((3, 2, 2))]
    want = np.einsum("nlhc,li,hj,ck->nijk", heads, *u).reshape(len(x), -1)
    assert np.allclose(np.stack(run(spark, "head_tucker")["core"]), want, atol=1e-5)
    s = np.linalg.svd(cores(x, u_l, u_c).reshape(-1, *RANKS), compute_uv=False)
    assert np.allclose(run(spark, "spectral_concentration")["concentration"], s[:, :2].sum(1) / s[:, 2:].sum(1), atol=1e-4)


def test_randomised_factors_span_the_exact_ones(spark):
    rng = np.random.default_rng(1)
    x = np.einsum("nr,rlc->nlc", rng.standard_normal((200, 5)) * [9, 7, 5, 3, 2], rng.standard_normal((5, 4, 40))) + 0.05 * rng.standard_normal((200, 4, 40))
    df = spark.createDataFrame([(row.ravel().tolist(),) for row in x], "x array<double>")
    exact, found = tensors.hosvd(df, 4, 40, 2, 5), tensors.hosvd_randomised(df, 4, 40, 2, 5)
    assert np.allclose(exact[0], found[0], atol=1e-6) and tensors.principal_angles(exact[1], found[1]).min() > 0.999
    with pytest.raises(ValueError):
        tensors.hosvd(df, 4, 40, 2, 5, offset=36)
    after = tensors.hosvd(df, 4, 40, 2, 3, offset=2)[1]
    assert np.allclose(after, exact[1][:, 2:5], atol=1e-6)


def test_angles(spark, data):
    _, prompt, _, x = data
    got = run(spark, "principal_angles", "i")
    want = np.linalg.svd(factors(x[prompt % 2 == 0])[1].T @ factors(x[prompt % 2 == 1])[1], compute_uv=False)
    assert np.allclose(got["cosine"], want, atol=1e-5) and got["random"].between(0, 1).all()
    u = [factors(x[prompt % 3 == i])[1] for i in range(3)]
    for r in run(spark, "subspace_stability", ["a", "b"]).itertuples():
        c = np.linalg.svd(u[r.a].T @ u[r.b], compute_uv=False)
        assert abs(r.mean - c.mean()) < 1e-5 and r.shared == (c > 0.5).sum() and (r.a != r.b or r.shared == 4)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((96, 20)))[0]
    one, two = q[:, :12], np.concatenate([q[:, :4], q[:, 12:]], axis=1)
    assert tensors.shared_directions(tensors.principal_angles(one * 3, two)) >= 4 > tensors.shared_directions(tensors.random_angles(96, 12), 0.9)


def test_contrast(spark, data):
    beam, prompt, _, x = data
    train = prompt % 5 != 0
    c = cores(x, *factors(x[train]))
    delta = c - np.stack([c[prompt == p].mean(0) for p in prompt])
    got = run(spark, "contrast_block")
    fit = delta[train]
    _, _, v = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
    want = (delta - fit.mean(0)) @ signed(v.T)
    assert np.allclose(np.stack(got["scores"]), want, atol=1e-4) and got.shape[1] == 9
    assert np.allclose(got["norm"], np.linalg.norm(delta, axis=1), atol=1e-5)
    for p in np.unique(prompt)[:20]:
        m = prompt == p
        e, u = np.linalg.eigh(delta[m] @ delta[m].T)
        e = np.clip(e[::-1], 0, None)
        share = e[e > 1e-12 * e.sum()] / e.sum()
        g = got[m]
        assert np.allclose(g["leverage"], (delta[m] ** 2).sum(1) / e.sum(), atol=1e-5) and np.allclose(g["log_lambda"], np.log(e[0]), atol=1e-5)
        assert np.allclose(g["log_trace"], np.log(e.sum()), atol=1e-5) and np.allclose(g["entropy"], -(share * np.log(share)).sum(), atol=1e-5)
        assert np.allclose(g["participation"], e.sum() ** 2 / (e**2).sum(), atol=1e-4) and np.allclose(g["leading"], np.abs(u[:, -1]) * np.sqrt(e[0]), atol=1e-4)


def test_common_directions_and_residuals(spark, data):
    _, prompt, _, x = data
    train = prompt % 5 != 0
    clean = x.copy()
    for layer in range(8):
        t = x[train, layer]
        v = np.linalg.svd(t - t.mean(0), full_matrices=False)[2][:3]
        clean[:, layer] -= x[:, layer] @ v.T @ v
    assert np.allclose(run(spark, "remove_common")["norm"], np.linalg.norm(clean.reshape(len(x), -1), axis=1), atol=1e-5)
    flat, base = x.reshape(len(x), -1), x[:, 0]
    a = np.column_stack([base, np.ones(len(x))])
    rest = flat - a @ np.linalg.lstsq(a[train], flat[train], rcond=None)[0]
    z = (rest - rest[train].mean(0)) / (rest[train].std(0) + 1e-8)
    got = run(spark, "residual_block")
    keep = rest[train].std(0) > 1e-9  # the base's own columns leave nothing
    want = np.sqrt((base**2).sum(1) + (z[:, keep] ** 2).sum(1))
    assert (got["n"] == 72).all() and np.allclose(got["norm"], want, atol=0.05)


def test_states_and_streams(spark, data):
    _, prompt, _, x = data
    flat = x.reshape(len(x), -1)
    e, v = np.linalg.eigh(flat.T @ flat)
    got = run(spark, "state_projection")
    assert np.allclose(got["inside"], np.linalg.norm(flat @ v[:, :8], axis=1), atol=1e-5) and np.allclose(got["rms"], np.sqrt((flat**2).mean(1)), atol=1e-5)
    invariants = run(spark, "spectral_invariants", "prompt_id")
    u_c = factors(x[prompt % 5 != 0])[1]
    terms = run(spark, "block_terms", "prompt_id")
    for k, p in enumerate(np.unique(prompt)[:10]):
        s = flat[prompt == p]
        n = len(s)
        w = np.linalg.eigvalsh(s @ s.T / n + 1e-3 * np.eye(n))
        slope = np.polyfit(np.arange(n), np.log(np.linalg.norm(s, axis=1)), 1)[0]
        assert np.allclose(invariants.loc[k, ["log_leading", "condition", "drift"]].astype(float), [np.log(w[-1]), -2 * np.log(w[-1] / w[0]), slope], atol=1e-4)
        inside = x[prompt == p] @ u_c @ u_c.T  # of rank four, so the factor leaves nothing
        assert terms.loc[k, "inside_rest"] < 1e-5 and 0 < terms.loc[k, "outside_rest"] < 1 and np.linalg.norm(inside) > 0
    assert (terms["n_inside"] == 12).all() and (terms["n_outside"] == 6).all()


def folds_of(prompt, k=5):
    return np.searchsorted(np.unique(prompt), prompt) % k


def test_detectors_out_of_fold(spark, data):
    _, prompt, y, x = data
    flat, fold, want = x.reshape(len(x), -1), folds_of(prompt), np.zeros(len(x))
    for i in range(5):
        want[fold == i] = logistic(flat[fold != i], y[fold != i])(flat[fold == i])
    got = run(spark, "lr_oof")
    assert (got["fold"] == fold).all() and np.allclose(got["score"], want, atol=2e-3)
    forest = run(spark, "rf_oof")
    assert (forest["fold"] == fold).all() and forest["score"].between(0, 1).all() and len(forest) == len(x)
    matrix = run(spark, "transfer_matrix", ["source", "target"])
    for r in matrix.itertuples():
        train = prompt % 3 == r.source
        c = cores(x, *factors(x[train]))
        m = prompt % 3 == r.target
        assert abs(r.auroc - auroc(y[m], logistic(c[train], y[train])(c[m]))) < 5e-3
    quad = run(spark, "quadratic_readout")
    train = prompt % 5 != 0
    mid = flat[train].mean(0)
    v = signed(np.linalg.svd(flat[train] - mid, full_matrices=False)[2][:6].T)
    z = (flat - mid) @ v
    i, j = np.triu_indices(6)
    z = np.concatenate([z, z[:, i] * z[:, j]], axis=1)
    assert np.allclose(quad["score"], logistic(z[train], y[train])(z), atol=5e-3)


def test_a_forest_finds_a_planted_signal(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(i, i // 10, int(y[i]), x[i].tolist()) for i in range(600)], "beam_id long, prompt_id long, y int, features array<double>")
    got = models.out_of_fold("forest", rows, splits.folds(rows), 5, trees=50).toPandas().sort_values("beam_id")
    assert auroc(y, got["score"].to_numpy()) > 0.85


def test_grouped_evaluation(spark, data):
    _, prompt, y, x = data
    got = run(spark, "grouped_cv", ["feature", "kind"]).set_index(["feature", "kind"])
    assert len(got) == 6 and got["pooled"].between(0, 1).all() and got["fold_mean"].between(0, 1).all()
    fold, scores = folds_of(prompt), {f: np.zeros(len(x)) for f in ("core", "centroid", "delta")}
    for i in range(5):
        train = fold != i
        z = mad(x, train)
        c = cores(z, *factors(z[train]))
        centroid = np.stack([c[prompt == p].mean(0) for p in prompt])
        for name, f in (("core", c), ("centroid", centroid), ("delta", c - centroid)):
            scores[name][~train] = logistic(f[train], y[train])(f[~train])
    for name, s in scores.items():
        r = got.loc[(name, "logistic")]
        by_fold = [auroc(y[fold == i], s[fold == i]) for i in range(5)]
        assert abs(r["pooled"] - auroc(y, s)) < 5e-3 and abs(r["fold_mean"] - np.mean(by_fold)) < 5e-3 and abs(r["fold_std"] - np.std(by_fold)) < 5e-3
        if name != "centroid":
            assert abs(r["within"] - within(prompt, y, s)) < 5e-3


def test_split_and_layer_evaluation(spark, data):
    beam, prompt, y, x = data
    found = run(spark, "split_protocol", ["protocol", "kind"]).set_index(["protocol", "kind"])
    parts = {"question": catalog.QUERIES["split_question"](spark, SF).toPandas().set_index("prompt_id")["part"].loc[prompt], "answer": catalog.QUERIES["split_answer"](spark, SF).toPandas().set_index("beam_id")["part"].loc[beam]}
    for name, part in parts.items():
        train = (part == "train").to_numpy()
        z = mad(x, train)
        c = cores(z, *factors(z[train]))
        r = found.loc[(name, "logistic")]
        assert abs(r["auroc"] - auroc(y[~train], logistic(c[train], y[train])(c[~train]))) < 5e-3
        assert r["lo"] <= r["mean"] <= r["hi"] and r["n_reps"] > 900
    seeds = run(spark, "seed_protocol", "seed")
    assert list(seeds["seed"]) == [42, 43, 44] and abs(seeds["auroc"][0] - found.loc[("question", "logistic")]["auroc"]) < 1e-6
    layers = run(spark, "layer_readout", "layer")
    fold, s = folds_of(prompt, 3), np.zeros(len(x))
    for i in range(3):
        train = fold != i
        z = mad(x[:, 2], train)
        v = signed(np.linalg.svd(z[train], full_matrices=False)[2][:4].T)
        s[~train] = logistic(z[train] @ v, y[train])(z[~train] @ v)
    assert list(layers["layer"]) == list(range(8)) and abs(layers["auroc"][2] - auroc(y, s)) < 5e-3


def fused(base, block, train):
    a = np.column_stack([base, np.ones(len(base))])
    left = block - a @ np.linalg.lstsq(a[train], block[train], rcond=None)[0]
    return np.column_stack([base, (left - left[train].mean(0)) / (left[train].std(0) + 1e-8)])


def contrast(c, prompt, fit, components):
    """Differences from the prompt's mean in their principal directions, then seven numbers of a prompt's spectrum."""
    delta, seven = c.copy(), np.zeros((len(c), 7))
    for p in np.unique(prompt):
        m = prompt == p
        d = delta[m] = c[m] - c[m].mean(0)
        squared = (d**2).sum(1)
        e, u = np.linalg.eigh(d @ d.T)
        e = np.clip(e[::-1], 0, None)
        share = e[e > 1e-12 * e.sum()] / e.sum()
        leading = np.abs(u[:, -1]) * np.sqrt(e[0]) if e[0] > 1e-10 else np.zeros(m.sum())
        row = [np.log(e[0] + 1e-8), -(share * np.log(share)).sum(), e.sum() ** 2 / ((e**2).sum() + 1e-12), np.log(e.sum() + 1e-8)]
        seven[m] = np.column_stack([np.sqrt(squared), squared / (e.sum() + 1e-12), np.tile(row, (m.sum(), 1)), leading])
    mid = delta[fit].mean(0)
    v = np.linalg.svd(delta[fit] - mid, full_matrices=False)[2][:components].T
    return np.column_stack([(delta - mid) @ signed(v), seven])


def clipped(v, train):
    lo, hi = np.percentile(v[train], [0.5, 99.5], axis=0)
    w = np.clip(v, lo, hi)
    q1, mid, q3 = np.percentile(w[train], [25, 50, 75], axis=0)
    return np.clip((w - mid) / ((q3 - q1) / 1.349 + 1e-8), -6, 6)


def test_stacking_reads_training_tokens_out_of_inner_folds(spark, data):
    _, prompt, y, x = data
    got = run(spark, "stacked_cv", "feature").iloc[0]
    fold, out = folds_of(prompt, 3), np.zeros(len(x))
    for i in range(3):
        train = fold != i
        z = mad(x, train)
        base = cores(z, *factors(z[train]))
        t = clipped(x.reshape(-1, 8), np.repeat(train, 8)).reshape(x.shape)
        s = np.zeros(x.shape[:2])
        on = lambda m: logistic(t[m].reshape(-1, 8), np.repeat(y[m], 8))
        s[~train] = on(train)(t[~train].reshape(-1, 8)).reshape(-1, 8)
        inner = np.full(len(x), -1)
        inner[train] = folds_of(prompt[train], 3)
        for j in range(3):
            s[inner == j] = on(train & (inner != j))(t[inner == j].reshape(-1, 8)).reshape(-1, 8)
        block = np.column_stack([s.max(1), np.percentile(s, 90, axis=1), s.mean(1), s[:, -1], (s > 0.5).mean(1), np.full(len(s), np.log(8))])
        f = fused(base, block, train)
        f[:, -1] = 0  # all answers have as many tokens
        keep = f[train].std(0) > 1e-6
        out[~train] = logistic(f[train][:, keep], y[train])(f[~train][:, keep])
    assert abs(got["pooled"] - auroc(y, out)) < 5e-3 and abs(got["within"] - within(prompt, y, out)) < 5e-3


def test_contrast_and_ladder(spark, data):
    _, prompt, y, x = data
    found = run(spark, "contrast_cv", "feature").set_index("feature")
    three, want = folds_of(prompt, 3), {"block": np.zeros(len(x)), "fused": np.zeros(len(x))}
    for i in range(3):
        fit = three != i
        z = mad(x, fit)
        c = cores(z, *factors(z[fit]))
        block = contrast(c, prompt, fit, 6)
        for name, z in (("block", block), ("fused", fused(c, block, fit))):
            want[name][~fit] = logistic(z[fit], y[fit])(z[~fit])
    for name, s in want.items():
        assert abs(found.loc[name]["pooled"] - auroc(y, s)) < 5e-3 and abs(found.loc[name]["within"] - within(prompt, y, s)) < 1e-2
    steps = run(spark, "hygiene_ladder", "feature").set_index("feature")
    fold, out = folds_of(prompt, 3), {s: np.zeros(len(x)) for s in ("mad", "clipped", "uncommon", "uncommon3")}

    def uncommon(z, train, k):
        z = z.copy()
        for layer in range(z.shape[1]):
            values, vectors = np.linalg.eigh(np.cov(z[train][:, layer].T, bias=True))
            v = vectors[:, np.argsort(-values)[:k]]
            z[:, layer] -= z[:, layer] @ v @ v.T
        return z

    for i in range(3):
        train = fold != i
        c = clipped(x, train)
        for name, z in (("mad", mad(x, train)), ("clipped", c), ("uncommon", uncommon(c, train, 1)), ("uncommon3", uncommon(c, train, 3))):
            c = cores(z, *factors(z[train]))
            out[name][~train] = logistic(c[train], y[train])(c[~train])
    for name, s in out.items():
        assert abs(steps.loc[name]["pooled"] - auroc(y, s)) < 5e-3
    assert np.isnan(steps.loc["mad"]["delta"])
    for name in ("clipped", "uncommon", "uncommon3"):  # a bootstrap's mean is near the difference itself
        assert abs(steps.loc[name]["pooled_delta"] - (auroc(y, out[name]) - auroc(y, out["mad"]))) < 0.02
        assert abs(steps.loc[name]["delta"] - (within(prompt, y, out[name]) - within(prompt, y, out["mad"]))) < 0.03


def dealt_by_hash(prompt, k, repeats, seed=42):
    """Folds of prompts in each repeat, in turn in hash order."""
    import hashlib

    prompts = np.unique(prompt)
    out = np.zeros((len(prompt), repeats), int)
    for r in range(repeats):
        order = sorted(prompts, key=lambda p: hashlib.sha256(f"{seed + r}:{p}".encode()).hexdigest())
        fold = {p: i % k for i, p in enumerate(order)}
        out[:, r] = [fold[p] for p in prompt]
    return out


def test_repeated_models_equal_the_one_by_one_route(spark, data):
    """repeated_cv: each model of the batch against factors and Newton's method on its own rows, on any layout."""
    from heddle.operators import repeated
    from heddle.sources import views

    beam, prompt, y, x = data
    folds = dealt_by_hash(prompt, 3, 2)
    b = views.beams(spark, SF)
    got = repeated.repeated_cv(b.repartition(5), k=3, repeats=2, shape=(8, 8), rank=RANKS).toPandas().sort_values(["repeat", "beam_id"])
    whole = repeated.repeated_cv(b, k=3, repeats=2).toPandas().sort_values(["repeat", "beam_id"])
    for r in range(2):
        for f in range(3):
            fit, rest = folds[:, r] != f, folds[:, r] == f
            u = factors(x[fit])
            core, flat = cores(x, *u), x.reshape(len(x), -1)
            for found, z in ((got, core), (whole, flat)):
                rows = found[(found["repeat"] == r) & (found["fold"] == f)]
                assert rows["beam_id"].tolist() == beam[rest].tolist()
                np.testing.assert_allclose(rows["score"], logistic(z[fit], y[fit])(z[rest]), atol=1e-6)


def test_repeated_summaries(spark, data):
    """repeated_cv and repeated_delta from scores."""
    from heddle.operators import repeated
    from heddle.sources import views

    _, prompt, y, _ = data
    row = run(spark, "repeated_cv", "pooled_mean").iloc[0]
    found = repeated.repeated_cv(views.beams(spark, SF), shape=(8, 8), rank=catalog_ranks()).toPandas().sort_values(["repeat", "beam_id"])
    pooled = [auroc(y, g["score"].to_numpy()) for _, g in found.groupby("repeat")]
    folds = [auroc(g["y"].to_numpy(), g["score"].to_numpy()) for _, g in found.groupby(["repeat", "fold"])]
    inside = [within(prompt, y, g["score"].to_numpy()) for _, g in found.groupby("repeat")]
    for name, values in (("pooled", pooled), ("fold", folds), ("within", inside)):
        np.testing.assert_allclose((row[f"{name}_mean"], row[f"{name}_std"]), (np.mean(values), np.std(values)), atol=2e-6)
    delta = run(spark, "repeated_delta", "metric")
    assert delta["metric"].tolist() == ["pooled", "within"] and (delta["lo"] <= delta["mean"]).all() and (delta["mean"] <= delta["hi"]).all()


def catalog_ranks():
    from heddle.plans.tensors import _RANKS

    return _RANKS


def test_stream_conditions(spark, data):
    """Each condition's scores by plain scaling, factors, residuals and Newton's method, fold by fold."""
    beam, prompt, y, x = data
    prompts = np.unique(prompt)
    fold = np.searchsorted(prompts, prompt) % 3
    steps, wide = x[:, 1:] - x[:, :-1], np.concatenate([x, np.abs(x)], 2)
    norm = np.linalg.norm(steps, axis=2)
    turn = 1 - np.einsum("nlc,nlc->nl", steps[:, 1:], steps[:, :-1]) / (norm[:, 1:] * norm[:, :-1] + 1e-12)
    kinematic = np.column_stack([norm, turn])
    want = {n: np.zeros(len(y)) for n in ("core", "velocity", "kinematic", "combined", "repooled")}
    for f in range(3):
        fit, own = fold != f, fold == f

        def core(t):
            t = mad(t, fit)
            return cores(t, *factors(t[fit]))

        base, velocity = core(x), core(steps)
        one, two = fused(base, velocity, fit), fused(base, kinematic, fit)
        features = {"core": base, "velocity": one, "kinematic": two, "combined": np.column_stack([one, two[:, base.shape[1] :]]), "repooled": core(wide)}
        for name, z in features.items():
            want[name][own] = logistic(z[fit], y[fit])(z[own])
    got = run(spark, "stream_conditions", "feature").set_index("feature")
    for name, s in want.items():
        assert abs(got.loc[name, "pooled"] - auroc(y, s)) < 2e-3 and abs(got.loc[name, "within"] - within(prompt, y, s)) < 5e-3, name
