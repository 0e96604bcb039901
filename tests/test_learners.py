"""QR trees, kernel machines and networks against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import catalog
from heddle.operators import factoring, kernels, networks, tensors

SF = "/root/testdata/sf0.001"


def table(spark, x, parts=1, **more):
    rows = [(i, v.tolist(), *(float(c[i]) if name == "w" else int(c[i]) for name, c in more.items())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "i int, x array<double>" + "".join(f", {n} int" for n in more)).repartition(parts)


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_small_singular_values_keep_their_digits(spark, parts):
    rng = np.random.default_rng(0)
    u, v = np.linalg.qr(rng.normal(size=(900, 6)))[0], np.linalg.qr(rng.normal(size=(6, 6)))[0]
    want = 10.0 ** np.array([5, 3, 1, -1, -3, -5])
    x = u * want @ v.T
    values, right = factoring.singular(table(spark, x, parts), 6)
    np.testing.assert_allclose(values, want, rtol=1e-5)
    np.testing.assert_allclose(np.abs(right.T @ v), np.eye(6), atol=1e-4)
    gram = np.sqrt(np.maximum(np.linalg.eigvalsh(x.T @ x)[::-1], 0))
    assert abs(gram[-1] / want[-1] - 1) > 0.1  # the squared condition loses it


def test_factors_equal_those_of_gram_matrices(spark):
    """svd_route: both routes, and singular values of the unfoldings."""
    x = np.random.default_rng(1).normal(size=(60, 4, 5))
    rows = table(spark, x.reshape(60, -1), 7)
    for a, b in zip(factoring.factors(rows, (4, 5), (2, 3)), tensors.tucker(rows, (4, 5), (2, 3)), strict=True):
        np.testing.assert_allclose(a, b, atol=1e-8)
    assert factoring.triangle(rows.where("i < 0"), 20).shape == (0, 20)
    got = {(r.mode, r.i): (r.value, r.share) for r in catalog.QUERIES["svd_route"](spark, SF).collect()}
    cells = np.array([r.x for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("floor(vec_id / 10) % 5 <> 0").select(F.col("embedding").alias("x")).collect()], float).reshape(-1, 8, 8)
    for mode in range(2):
        want = np.linalg.svd(np.moveaxis(cells, mode + 1, 0).reshape(8, -1), compute_uv=False)
        np.testing.assert_allclose([got[mode, i] for i in range(8)], np.column_stack([want, want**2 / (want**2).sum()]), atol=2e-6)


def auroc(y, s):
    a, b = s[y == 1][:, None], s[y == 0][None]
    return ((a > b) + (a == b) / 2).mean()


def ring(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, (np.linalg.norm(x, axis=1) > 1.18).astype(int)


def test_the_kernel_is_met_within_its_bound():
    x = np.random.default_rng(2).normal(size=(60, 5))
    f, p = kernels.waves(5, 0.3, 4096, 7)
    z = np.sqrt(2 / 4096) * np.cos(x @ f + p)
    kernel = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    pairs = 60 * 59 / 2
    assert np.abs(z @ z.T - kernel)[np.triu_indices(60, 1)].max() < np.sqrt(8 * np.log(2 * pairs / 0.001) / 4096)


def test_a_ring_needs_the_kernel(spark):
    """rbf_oof: on a ring the machine beats a linear one, and its loss is at most that of a long descent."""
    (x, y), (xt, yt) = ring(500, 3), ring(400, 4)
    train, rows = (table(spark, a, 3, y=b).withColumnRenamed("x", "features") for a, b in ((x, y), (xt, yt)))
    by = {}
    for linear in (False, True):
        found = kernels.machine(train, rows, width=128, linear=linear).orderBy("i").collect()
        by[linear] = auroc(np.array([r.y for r in found]), np.array([r.score for r in found]))
    assert by[False] > 0.97 > 0.7 > by[True]
    gamma = kernels.scale_gamma(train)
    np.testing.assert_allclose(gamma, 1 / (2 * x.var()), rtol=1e-9)
    f, p = kernels.waves(2, gamma, 128, 42)
    z = np.column_stack([np.sqrt(2 / 128) * np.cos(x @ f + p), np.ones(500)])
    s, w = 2 * y - 1, np.where(y == 1, 500 / (2 * y.sum()), 500 / (2 * (1 - y).sum()))
    loss = lambda b: (w * np.maximum(0, 1 - s * (z @ b))).mean() + (b[:-1] ** 2).sum() / 1000
    b, best = np.zeros(129), np.inf
    for t in range(4000):
        g = -(z * (w * s * (s * (z @ b) < 1))[:, None]).mean(0) + np.append(b[:-1], 0) / 500
        b -= 3 / np.sqrt(t + 1) * g
        best = min(best, loss(b))
    got = kernels.machine(train, train, width=128).orderBy("i").collect()
    margin = np.array([r.score for r in got])
    assert (w * np.maximum(0, 1 - s * margin)).mean() <= best * 1.02


def test_one_class_and_rbf_query(spark):
    one = table(spark, ring(20, 1)[0], y=np.zeros(20)).withColumnRenamed("x", "features")
    assert {r.score for r in kernels.machine(one, one).collect()} == {0.0}
    found = catalog.QUERIES["rbf_oof"](spark, SF).toPandas()
    assert len(found) == 500 and set(found["fold"]) == {0, 1, 2} and np.isfinite(found["score"]).all()


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 4)), rng.integers(0, 2, 30)
    net = networks.Network(x.mean(0), 1 / x.std(0), rng.normal(size=4 * 3 + 3 + 3 + 1), 3)
    found = networks.loss_and_gradient(net, x, y)
    for i in range(len(net.theta)):
        each = []
        for e in (1e-6, -1e-6):
            theta = net.theta.copy()
            theta[i] += e
            each.append(networks.loss_and_gradient(networks.Network(net.mean, net.scale, theta, 3), x, y)[0])
        assert abs((each[0] - each[1]) / 2e-6 - found[1 + i]) < 1e-4


def test_losses_do_not_follow_the_number_of_tasks(spark):
    x, y = ring(200, 6)
    runs = [networks.fitted(table(spark, x, parts, y=y, fold=np.arange(200) % 2), 2, hidden=8, steps=6) for parts in (1, 16)]
    np.testing.assert_allclose(runs[0][1], runs[1][1], rtol=1e-10)
    np.testing.assert_allclose(runs[0][0][1].theta, runs[1][0][1].theta, rtol=1e-7)
    assert runs[0][1][0][-1] < runs[0][1][0][0]


def test_a_network_learns_a_ring_and_equals_numpy(spark):
    """mlp_oof by the same steps in numpy."""
    x, y = ring(300, 8)
    fold = np.arange(300) % 3
    nets, losses = networks.fitted(table(spark, x, 2, y=y, fold=fold), 3, hidden=16, steps=40, rate=0.1)
    for i in range(3):
        own = fold == i
        assert auroc(y[own], nets[i].probability(x[own])) > 0.9
        np.testing.assert_allclose(nets[i].mean, x[~own].mean(0), atol=1e-12)
        first = networks.Network(nets[i].mean, nets[i].scale, start(2, 16), 16)
        np.testing.assert_allclose(losses[i][0], networks.loss_and_gradient(first, x[~own], y[~own])[0] / (~own).sum(), rtol=1e-9)
    found = catalog.QUERIES["mlp_oof"](spark, SF).toPandas()
    assert len(found) == 500 and found["score"].between(0, 1).all() and found["score"].std() > 0.01


def start(d, hidden, seed=42):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, d * hidden) / np.sqrt(d), rng.uniform(-1, 1, hidden) / np.sqrt(d), rng.uniform(-1, 1, hidden + 1) / np.sqrt(hidden)])
