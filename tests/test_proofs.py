"""Manifests, validation suites, states from elsewhere, rank probes and subspace verdicts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle import catalog
from heddle.operators import repeated, subspaces, tensors, validation
from heddle.sources import manifests, pairs, views

SF = "/root/testdata/sf0.001"


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, w string")


ROWS = [(i, f"v{i}", None if i % 7 == 0 else "w") for i in range(-40, 300)]


def made(d, **how):
    return manifests.tree(d, "k", ["v", "w"], span=8, fan=4, **how)


@pytest.mark.parametrize(
    ("change", "where"),
    [
        (lambda r: [(k, "other" if k == 123 else v, w) for k, v, w in r], (120, 127)),
        (lambda r: [x for x in r if x[0] != -1], (-8, -1)),
        (lambda r: [*r, (299, "v299", "w")], (296, 303)),  # the same row twice
        (lambda r: [(k, v, "" if k == 7 else w) for k, v, w in r], (0, 7)),  # null to empty
        (lambda r: [(k, "v1:w" if k == 1 else v, "" if k == 1 else w) for k, v, w in r], (0, 7)),
        (lambda r: [*r, (None, "keyless", None)], (None, None)),
    ],
)
def test_one_changed_row_is_found_by_its_range(spark, change, where):
    a = made(keyed(spark, ROWS).repartition(3))
    b = made(keyed(spark, change(ROWS)[::-1]), levels=a.agg(F.max("level")).first()[0])
    found = manifests.difference(a, b, span=8, fan=4).collect()
    assert [(r.first_key, r.last_key) for r in found] == [where]


def test_equal_tables_have_equal_roots_and_others_fail(spark):
    d = keyed(spark, [*ROWS, (None, "x", None), (None, "x", None), (5, "again", None)])
    a, b = made(d), made(d.repartition(5).orderBy(F.desc("v")))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    top = a.agg(F.max("level")).first()[0]
    assert [r.n for r in a.where(F.col("level") == top).collect()] == [d.count()]
    assert manifests.verified(a, d, "k", ["v", "w"], span=8, fan=4) is d
    with pytest.raises(ValueError, match="1 ranges of keys differ, among them 160 to 167"):
        manifests.verified(a, d.where("k IS NULL OR k <> 160"), "k", ["v", "w"], span=8, fan=4)
    assert made(d.limit(0)).count() == 0


def checks():
    return [
        validation.Check("text", F.coalesce(F.col("text"), F.lit("")) == "", least=0.9),
        validation.Check("label", ~F.col("y").isin(0, 1)),
        validation.Check("ten", F.col("n") != 10, group=True),
        validation.Check("mixed", (F.col("ones") == 0) | (F.col("ones") == F.col("n")), counts=F.col("n") > 1, least=0.5, group=True),
    ]


def answers(spark, faults=()):
    rows = [(f"{p}-{i}", p, i % 2, "some text") for p in range(20) for i in range(10)]
    for f in faults:
        rows = f(rows)
    return spark.createDataFrame(rows, "key string, prompt long, y int, text string").repartition(4)


@pytest.mark.parametrize(
    ("fault", "name", "n", "example"),
    [
        (lambda r: [(k, p, y, None if p < 3 else t) for k, p, y, t in r], "text", 30, None),
        (lambda r: [(k, p, None if k == "4-4" else 7 if k == "5-5" else y, t) for k, p, y, t in r], "label", 2, "4-4"),
        (lambda r: [x for x in r if x[0] != "6-0"], "ten", 1, "6"),
        (lambda r: [(k, p, 0 if p > 4 else y, t) for k, p, y, t in r], "mixed", 15, None),
    ],
)
def test_planted_faults_are_named(spark, fault, name, n, example):
    sums = {"ones": F.col("y").cast("long")}
    good = validation.report(answers(spark), "key", "prompt", checks(), sums)
    assert all(r.passed and r.n_failed == 0 and r.examples == [] for r in good.collect())
    assert validation.asserted(good) is good
    found = validation.report(answers(spark, [fault]), "key", "prompt", checks(), sums)
    by = {r.check: r for r in found.collect()}
    assert [c for c, r in by.items() if not r.passed] == [name] and by[name].n_failed == n
    assert 1 <= len(by[name].examples) <= validation.EXAMPLES and (example is None or example in by[name].examples)
    with pytest.raises(ValueError, match=f"^{name}: {n} of"):
        validation.asserted(found)


def test_one_scan_and_empty_tables(spark):
    found = validation.report(views.samples(spark, SF).withColumn("key", F.col("turn")), "key", "conv_id", [validation.Check("a", F.length("answer") == 0), validation.Check("b", F.col("n") > 99, group=True)])
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    empty = validation.report(answers(spark).limit(0), "key", "prompt", checks(), {"ones": F.col("y").cast("long")}).collect()
    assert [(r.n_checked, r.n_failed, r.share, r.passed) for r in empty] == [(0, 0, None, True)] * 4


def test_round_trips(spark):
    import public_tokenizers

    rows = spark.createDataFrame([(1, "Some text.  Ünï \n"), (2, ""), (3, None)], "i int, t string")
    exact = rows.select("i", validation.round_trips("t", public_tokenizers.path("byte_bpe_50k.json")).alias("ok"))
    assert {r.i: r.ok for r in exact.collect()} == {1: True, 2: True, 3: None}


def sides(spark, theirs):
    ours = spark.createDataFrame([(i, i // 3, i % 3, i % 2) for i in range(9)], "beam long, prompt long, idx int, y int")
    other = spark.createDataFrame(theirs, "p long, row int, flag int, state array<double>")
    return pairs.aligned(ours, other, prompt="prompt", order=["idx"], label="y", their_prompt="p", their_order=["row"], their_label="flag")


THEIRS = [(i // 3, 10 * i, i % 2, [float(i), 1.0]) for i in range(9)]


def test_pairs_stand_by_order_and_are_projected(spark):
    both = pairs.projected(sides(spark, THEIRS[::-1]), "state", np.array([[1.0, 2.0], [0.0, 10.0]]), "z")
    assert sorted((r.beam, r.row, tuple(r.z)) for r in both.collect()) == [(i, 10 * i, (float(i), 2.0 * i + 10)) for i in range(9)]


@pytest.mark.parametrize(
    ("theirs", "said"),
    [
        (THEIRS[:-1], "no state from elsewhere for prompt 2, place 2"),
        ([*THEIRS, (0, 99, 0, [0.0, 0.0])], "no answer for the state of prompt 0, place 3"),
        ([*THEIRS, (7, 1, 0, [0.0, 0.0])], "no answer for the state of prompt 7"),
        ([(p, r, 1 - f if r == 40 else f, s) for p, r, f, s in THEIRS], "labels differ at prompt 1, place 1"),
    ],
)
def test_misaligned_pairs_fail(spark, theirs, said):
    with pytest.raises(Exception, match=said):
        sides(spark, theirs).collect()


def test_projections_fail_where_they_do_not_fit(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "i int, v array<double>")
    assert pairs.projection(rows, "i", "v").tolist() == [[1.0, 2.0], [3.0, 4.0]]
    with pytest.raises(ValueError, match="numbered"):
        pairs.projection(rows.where("i = 1"), "i", "v")
    with pytest.raises(Exception, match="a state has 2 numbers, the projection takes 3"):
        pairs.projected(rows, "v", np.zeros((3, 1)), "z").collect()


def test_nested_ranks_equal_separate_runs(spark):
    """rank_probe: prefixes of one decomposition against decompositions of their own; the rule of adoption."""
    b = views.beams(spark, SF)
    dealt = repeated._dealt(b, 3, 1, 42)
    ranks = [(3, 2), (3, 5)]
    for rank, nested in zip(ranks, repeated.fitted_ranks(dealt, 3, 1, (8, 8), ranks), strict=True):
        alone = repeated.fitted(dealt, 3, 1, shape=(8, 8), rank=rank)
        np.testing.assert_allclose(nested.w, alone.w, atol=1e-8)
        for (a, c), (d, e) in zip(nested.factors, alone.factors, strict=True):
            assert np.allclose(a, d) and np.allclose(c, e)
    rows = [("a", "6", 0.1, True), ("b", "6", -0.1, False), ("a", "8", 0.2, True), ("b", "8", -0.2, True), ("a", "4", None, None), ("a", "9", 0.1, False), ("b", "9", 0.5, True)]
    probes = spark.createDataFrame([(d, r, m, s) for d, r, m, s in rows], "dataset string, rank string, mean double, excludes_zero boolean")
    assert {r["rank"]: r.adopt for r in repeated.ranks_adopted(probes, "a", "b").collect()} == {"6": True, "8": False, "9": False}
    found = catalog.QUERIES["rank_probe"](spark, SF).toPandas()
    assert len(found) == 6 and set(found["rank"]) == {"3x2", "3x4", "3x6"} and found[found["rank"] == "3x2"]["adopt"].isna().all()


def planted(spark, directions, seed, layers=2, size=24):
    """300 prompts whose states lie along some directions, nearly."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(300, layers, len(directions))) @ directions + 0.05 * rng.normal(size=(300, layers, size))
    return spark.createDataFrame([(p, v.ravel().tolist()) for p, v in enumerate(x)], "prompt_id long, x array<double>")


def test_planted_subspaces_get_their_verdicts(spark):
    """subspace_verdict: orthogonal, complementary and redundant streams; draws of chance repeat and are those of numpy."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(24, 24)))[0].T
    folds = spark.range(300).select(F.col("id").alias("prompt_id"), (F.col("id") % 3).cast("int").alias("fold"))
    one = planted(spark, q[:6], 1)
    halves = planted(spark, q[:6], 2), planted(spark, q[:6], 3)
    for start, said in ((6, "orthogonal"), (2, "complementary"), (0, "redundant")):
        found = subspaces.compared(one, planted(spark, q[start : start + 6], 4), halves, folds, 3, ((2, 24), (2, 24), (2, 24)), 6, draws=60, threshold=0.9)
        assert (found["verdict"], found["shared"], found["halves"]) == (said, 6.0 - start, 6.0)
    got = {r.draw: (r.shared, r.mean) for r in subspaces.random_pairs(spark, 12, 4, 40, seed=3).repartition(7).collect()}
    for draw in range(40):
        rng = np.random.default_rng([3, draw])
        cosines = tensors.principal_angles(rng.standard_normal((12, 4)), rng.standard_normal((12, 4)))
        assert got[draw] == ((cosines > 0.5).sum(), pytest.approx(cosines.mean()))
    assert subspaces.chance(spark, 12, 4, 40, seed=3)["hi"] == np.quantile([s for s, _ in got.values()], 0.975)
    row = catalog.QUERIES["subspace_verdict"](spark, SF).first()
    assert row.verdict in ("orthogonal", "complementary", "redundant") and row.null_lo <= row.null_mid <= row.null_hi
