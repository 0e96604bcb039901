"""Properties of the operators that SQL can't express, against numpy on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import ranks
from heddle.operators import audits, models, ranking, splits, tensors
from heddle.sources import records, results, texts

RNG = np.random.default_rng(5)
L, C = 4, 6


def tensors_of(spark, n=60):
    x = RNG.standard_normal((n, L, C))
    rows = [(i, i // 5, int(i % 3 == 0), x[i].ravel().tolist()) for i in range(n)]
    return x, spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, x array<double>").repartition(5)


def test_factors_are_orthonormal_and_do_not_depend_on_partitions(spark):
    x, df = tensors_of(spark)
    u_l, u_c = tensors.hosvd(df, L, C, 2, 3)
    again = tensors.hosvd(df.coalesce(1), L, C, 2, 3)
    for u, v, g in zip((u_l, u_c), again, (np.einsum("nlc,nmc->lm", x, x), np.einsum("nlc,nld->cd", x, x)), strict=True):
        assert np.allclose(u.T @ u, np.eye(u.shape[1])) and np.allclose(u, v)
        top = np.linalg.eigh(g)[1][:, ::-1][:, : u.shape[1]]
        assert np.allclose(u @ u.T, top @ top.T)


def test_core_and_residual(spark):
    x, df = tensors_of(spark)
    u_l, u_c = tensors.hosvd(df, L, C, 2, 3)
    core = {r.beam_id: np.array(r.core) for r in tensors.core(df, u_l, u_c).collect()}
    assert all(np.allclose(core[i].reshape(2, 3), u_l.T @ x[i] @ u_c) for i in core)
    q = {r.beam_id: r.q for r in tensors.q_statistic(df, u_l, u_c).collect()}
    assert all(np.isclose(q[i], (x[i] ** 2).sum() - (core[i] ** 2).sum()) for i in q)


def test_auroc_with_ties(spark):
    rows = [(i, i % 4, int(y), float(s)) for i, (y, s) in enumerate(zip(RNG.integers(0, 2, 300), RNG.integers(0, 12, 300), strict=True))]
    df = spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, score double")
    pairs = lambda some: [(a[3] > b[3]) + (a[3] == b[3]) / 2 for a in some for b in some if a[2] == 1 and b[2] == 0]
    assert np.isclose(ranking.auroc(df, []).first().auroc, np.mean(pairs(rows)))
    within = [v for p in range(4) for v in pairs([r for r in rows if r[1] == p])]
    got = ranking.within_prompt(df, []).first()
    assert np.isclose(got.auroc, np.mean(within)) and got.n_pairs == len(within)


def test_ranks_equal_sorting(spark):
    values = RNG.choice(10**9, 500, replace=False).tolist() + [10**15]
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(7)
    got = {r.v: r.rank for r in ranks.value_rank(df, "v").collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda p: p[1])] == sorted(values) and set(got.values()) == set(range(1, 502))
    key = F.sha2(F.col("v").cast("string"), 256)
    hashed = ranks.hash_rank(df.withColumn("h", key), key).orderBy("rank").collect()
    assert [r.h for r in hashed] == sorted(r.h for r in hashed) and [r.rank for r in hashed] == list(range(1, 502))
    assert ranks.value_rank(df.limit(0), "v").count() == 0


def test_question_split_never_straddles(spark):
    _, df = tensors_of(spark)
    prompts = splits.known_prompts(df)
    known = prompts.where("is_known").count()
    parts = splits.by_question(prompts)
    assert parts.where("part = 'train'").count() == int(0.75 * known)
    assert parts.where("NOT is_known AND part = 'train'").count() == 0
    folds = splits.folds(df, 5, seed=3).collect()
    assert len({r.prompt_id for r in folds}) == len(folds) and {r.fold for r in folds} == set(range(5))


def test_quantiles_do_not_depend_on_their_route(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(v)) for k in range(3) for v in [*rng.normal(0, 1e6 if k else 1, 300), *([0.25] * 200), 1e12]] + [(7, 1.5), (8, None)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = {"a": 0.0, "b": 0.005, "c": 0.5, "d": 0.995, "e": 1.0}
    one = {r.k: r for r in ranks.quantiles(df, ["k"], F.col("v"), shares).collect()}
    two = {r.k: r for r in ranks._binned_quantiles(df, ["k"], F.col("v"), shares).collect()}
    assert set(one) == set(two) == {0, 1, 2, 7}
    for k in one:
        want = np.quantile([v for i, v in rows if i == k], list(shares.values()))
        assert np.allclose(one[k][1:], want) and np.allclose(two[k][1:], want)


def test_folds_by_size_and_budget(spark):
    rng = np.random.default_rng(5)
    sizes = {p: int(rng.choice([1, 2, 3, 7, 40])) for p in range(60)}
    rows = spark.createDataFrame([(p, i) for p, n in sizes.items() for i in range(n)], "prompt_id long, i int")
    loads, want = [0] * 4, {}
    for p in sorted(sizes, key=lambda p: (-sizes[p], p)):
        want[p] = loads.index(min(loads))
        loads[want[p]] += sizes[p]
    assert {r.prompt_id: r.fold for r in splits.folds_by_size(rows, 4).collect()} == want


def test_checks_and_records(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, True), (1, 11, False), (2, 20, True)], "prompt_id long, beam_id long, ours boolean")
    assert audits.asserted_count(rows, 3).count() == 3
    with pytest.raises(Exception, match="expected 4 rows, found 3"):
        audits.asserted_count(rows, 4).collect()
    nested = records.nested(rows, "ours")
    records.write(nested, str(tmp_path / "records"))
    back = records.flattened(records.read(spark, str(tmp_path / "records")))
    assert sorted(map(tuple, back.select("ind", "beam_id", "is_correct").collect())) == [(1, 10, True), (1, 11, False), (2, 20, True)]


def test_planted_signal_is_found(spark):
    y = RNG.integers(0, 2, 200)
    x = RNG.standard_normal((200, 5)) + y[:, None] * np.array([2, 0, 0, 0, 0])
    rows = [(i, i // 5, int(y[i]), x[i].tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, features array<double>")
    scored = models.out_of_fold("logistic", df, splits.folds(df, 3), 3)
    assert scored.count() == 200 and ranking.auroc(scored, []).first().auroc > 0.85


def test_scans_and_files_fail_where_they_must(spark, tmp_path):
    rows = spark.createDataFrame([(i, i // 2, i % 2) for i in range(5)], "beam_id long, prompt_id long, y int")
    assert audits.asserted_each(rows.where("prompt_id < 2"), "prompt_id", 2).count() == 4
    with pytest.raises(Exception, match="found 1 of 2"):
        audits.asserted_each(rows, "prompt_id", 2).count()
    with pytest.raises(ValueError, match="score"):
        results.required(rows, ["beam_id", "score"])
    other = rows.select(F.col("beam_id").alias("id"), "y", F.lit(1.0).alias("v"))
    assert results.aligned(rows, other, "beam_id", ["y"], {"id": "beam_id"}).where("v = 1").count() == 5
    for wrong in (other.where("id > 0"), other.withColumn("y", 1 - F.col("y"))):
        with pytest.raises(Exception, match="sides differ"):
            results.aligned(rows, wrong, "beam_id", ["y"], {"id": "beam_id"}).collect()
    lines = {"whole": ['{"answer": "x"}', '{"text": "y"}'], "broken": ['{"answer": "x"}', "{"], "none": ['{"n": 1}', '{"text": ""}'], "long": ['{"text": "y"}'] * 3}
    for name, some in lines.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.jsonl").write_text("\n".join(some))
    found = {r.folder: r.verdict for r in texts.inventory(spark, str(tmp_path), 2).collect()}
    assert found == {"whole": "COMPLETE", "broken": "PARTIAL", "none": "NONE", "long": "PARTIAL"}


def test_inventory_of_arrays_tables_and_strings(spark, tmp_path):
    files = {
        "array/a.json": '[\n {"text": "x"},\n {"completion": "y"}\n]\n', "oneline/a.json": '[{"text": "x"}, {"gen_text": "y"}]', "object/a.json": '{\n "text": "x"\n}',
        "number/a.jsonl": '{"text": 5, "answer": "y"}\n{"text": 5}\n', "strings/a.json": '["x", "5"]', "csv/a.csv": 'id,answer\n1,x\n2,"y, and ""z"""\n', "empty/a.csv": "text,answer\n,1\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    found = {r.folder: (r.n_rows, r.n_texts, r.verdict) for r in texts.inventory(spark, str(tmp_path), 2).collect()}
    whole = (2, 2, "COMPLETE")
    assert found == {"array": whole, "oneline": whole, "strings": whole, "csv": whole, "object": (1, 1, "PARTIAL"), "number": (2, 1, "PARTIAL"), "empty": (1, 0, "NONE")}


def test_the_last_key_may_be_short(spark):
    rows = spark.createDataFrame([(i, i // 2) for i in range(5)], "beam_id long, prompt_id long")
    check = lambda d: audits.asserted_each(d, "prompt_id", 2, open_end=True).count()
    assert check(rows) == 5 and check(rows.where("beam_id < 4")) == 4 and check(rows.limit(0)) == 0
    more = spark.createDataFrame([(9, 2), (8, 2)], rows.schema)
    for wrong, said in ((rows.where("beam_id <> 1"), "found 1 of 0"), (rows.union(more), "found 3 of 2"), (rows.union(spark.createDataFrame([(7, None)], rows.schema)), "found 1 of null")):
        with pytest.raises(Exception, match=said):
            check(wrong)


def test_inventory_of_tables_of_many_widths_or_none(spark, tmp_path):
    for name, text in {"narrow/a.csv": "text\nx\n", "wide/a.csv": '\nid,a,b,c,d,answer\n1,,,,,"x, y, z"\n2,,,,,\n', "void/a.csv": "", "lines/a.jsonl": '{"text": "x"}\n'}.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    found = {r.folder: (r.n_rows, r.n_texts, r.verdict) for r in texts.inventory(spark, str(tmp_path), 1).collect()}
    assert found == {"narrow": (1, 1, "COMPLETE"), "wide": (2, 1, "PARTIAL"), "lines": (1, 1, "COMPLETE")}
    assert [tuple(r) for r in texts.inventory(spark, str(tmp_path / "lines"), 1).collect()] == [("lines", 1, 1, "COMPLETE")]


def test_results_replace_and_pick(spark):
    board = spark.createDataFrame([("a", "1", 0.5), ("b", "2", 0.6)], "condition string, version string, auroc double")
    new = spark.createDataFrame([("c", "2", 0.7, "x")], "condition string, version string, auroc double, note string")
    assert sorted(tuple(r) for r in results.replaced(board, new).select("condition", "version").collect()) == [("a", "1"), ("c", "2")]
    found = spark.createDataFrame([(1, "b", "lr", 0.7), (1, "a", "rf", 0.7), (1, "c", "lr", None), (2, "c", "lr", None)], "dataset long, condition string, kind string, auroc double")
    got = results.best(found, ["dataset"], ["condition", "kind"], "auroc").collect()
    assert [tuple(r) for r in got] == [(1, "a", "rf", 0.7)]


def test_slots_of_draws_are_dealt_over_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        _, slots = ranking._slots(spark.range(2_000).withColumnRenamed("id", "prompt_id"), 10, 42)
        sizes = [r["count"] for r in slots.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(sizes) == 20_000 and max(sizes) < 3_000
