"""16-bit floats and the store of raw states, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions import halves
from heddle.sources import states

BOUND = {"float16": (2.0**-11, 2.0**-25), "bfloat16": (2.0**-8, 2.0**-134)}


@pytest.mark.parametrize("kind", ["float16", "bfloat16"])
def test_every_pattern_comes_back_and_others_within_the_bound(kind):
    bits = np.arange(1 << 16, dtype=np.uint32).astype(np.uint16)
    v = halves.decoded(bits, kind).astype(float)
    assert np.array_equal(halves.decoded(halves.encoded(v[~np.isnan(v)], kind), kind), v[~np.isnan(v)])
    assert np.isnan(halves.decoded(halves.encoded(np.array([np.nan]), kind), kind)).all()
    rng = np.random.default_rng(1)
    x = rng.normal(size=200_000) * 10.0 ** rng.uniform(-12, 4 if kind == "float16" else 30, 200_000)
    back = halves.decoded(halves.encoded(x, kind), kind).astype(float)
    share, least = BOUND[kind]
    assert (np.abs(back - x) <= np.maximum(share * np.abs(x), least)).all()
    some = np.sort(v[np.isfinite(v)])
    at = np.searchsorted(some, x)
    nearest = np.minimum(np.abs(x - some[at - 1]), np.abs(x - some[np.minimum(at, len(some) - 1)]))
    assert np.allclose(np.abs(back - x), nearest, rtol=0, atol=0)


def test_ties_go_to_even_and_are_rounded_once():
    one = 1.0 + 2.0**-8  # half way between two bfloat16
    assert halves.decoded(halves.encoded(np.array([one, one + 2.0**-40, 1 + 3 * 2.0**-8])))[:3].tolist() == [1.0, 1 + 2.0**-7, 1 + 2.0**-6]


@pytest.mark.parametrize("kind", ["float16", "bfloat16"])
def test_overflow(kind):
    big = np.array([halves.LARGEST[kind] * 1.01, -halves.LARGEST[kind] * 1.01])
    with pytest.raises(ValueError, match="too large"):
        halves.encoded(big, kind)
    assert halves.decoded(halves.encoded(big, kind, "clip"), kind).tolist() == [halves.LARGEST[kind], -halves.LARGEST[kind]]
    assert halves.decoded(halves.encoded(np.array([np.inf, -np.inf]), kind), kind).tolist() == [np.inf, -np.inf]


def test_columns_halve_their_bytes(spark):
    rows = spark.createDataFrame([(1, [1.5, -2.0, 65504.0]), (2, []), (3, None), (4, [None, 1.0])], "i int, x array<double>")
    got = {r["i"]: (r["h"], r["x"]) for r in rows.select("i", halves.packed("x").alias("h")).withColumn("x", halves.unpacked("h")).collect()}
    assert got[1][1] == [1.5, -2.0, 65504.0] and len(got[1][0]) == 6 and got[2][1] == [] and got[3] == (None, None)
    assert np.isnan(got[4][1][0]) and got[4][1][1] == 1.0


def planted(seed=0):
    """30 answers of 0 to 7 tokens, 10 layers of 24 channels, all of numbers that 16 bits hold."""
    rng = np.random.default_rng(seed)
    return {b: halves.decoded(halves.encoded(rng.normal(size=(rng.integers(0, 8), 10, 24)))).astype(float) for b in range(30)}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(b, b // 5, b % 2, t, x.ravel().tolist()) for b, xs in planted().items() for t, x in enumerate(xs)]
    rows += [(b, b // 5, b % 2, None, None) for b, xs in planted().items() if not len(xs)]
    path = str(tmp_path_factory.mktemp("states") / "store")
    states.write(spark.createDataFrame(rows, "beam_id long, prompt_id long, y int, pos int, x array<double>"), path, 10, 24, block_bytes=2000)
    return states.read(spark, path)


def test_blocks_are_bounded_and_hold_all(store):
    assert store.count() > 8 and store.agg(F.max(F.length("states"))).first()[0] < 2000 + 7 * 480
    got = {(r.beam_id, r.pos): np.array(r.x) for r in states.unpacked(store).collect()}
    want = {(b, t): x.ravel() for b, xs in planted().items() for t, x in enumerate(xs)}
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)


@pytest.mark.parametrize("cut", [None, 3])
def test_streams_of_one_pass(spark, store, cut):
    lengths = None if cut is None else spark.createDataFrame([(b, cut) for b in range(0, 30, 2)], "beam_id long, canonical int")
    found = states.streams(store, lengths).collect()
    assert len(found) == 30
    for r in found:
        x = planted()[r.beam_id]
        x = x[:cut] if cut is not None and r.beam_id % 2 == 0 else x
        assert (r.n, r.prompt_id, r.y) == (len(x), r.beam_id // 5, r.beam_id % 2)
        steps = x[:, 1:] - x[:, :-1]
        zero = np.zeros((10, 24))
        want = {"v_max": x.max(0) if len(x) else zero, "s95": np.quantile(x, 0.95, axis=0) if len(x) else zero, "v05": np.quantile(steps, 0.05, axis=0) if len(x) else zero[1:]}
        for name, value in want.items():
            np.testing.assert_allclose(r[name], value.ravel(), atol=1e-12)
        assert all(a >= b for a, b in zip(r.v95, r.v05, strict=True))
        norm = np.linalg.norm(steps, axis=2)
        np.testing.assert_allclose(r.speed_mean, norm.mean(0) if len(x) else np.zeros(9), atol=1e-12)
        cosine = np.einsum("tlc,tlc->tl", steps[:, 1:], steps[:, :-1]) / (norm[:, 1:] * norm[:, :-1] + 1e-12)
        np.testing.assert_allclose(r.turn_q90, np.quantile(1 - cosine, 0.9, axis=0) if len(x) else np.zeros(8), atol=1e-12)
        assert r["at"] == ([float(v) for v in x.argmax(0).ravel()] if len(x) else [-1.0] * 240)


def test_one_read_of_the_store(store):
    plan = states.streams(store)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan


def test_a_state_of_another_width_fails(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 0, 0, [1.0, 2.0]), (1, 1, 0, 1, [1.0])], "beam_id long, prompt_id long, y int, pos int, x array<double>")
    with pytest.raises(Exception, match="has 1 numbers"):
        states.write(rows, str(tmp_path / "s"), 1, 2)


@pytest.mark.parametrize("n", [1, 2, 10, 37])
def test_quantiles_of_halves_are_those_of_sql_to_the_last_bit(n):
    import duckdb
    import pandas as pd

    x = np.round(np.random.default_rng(n).standard_normal((n, 40, 25)) * 64) / 256
    rows = pd.DataFrame({"k": np.tile(np.arange(1000), n), "v": x.ravel()})  # noqa: F841
    for share in (0.05, 0.9, 0.95):
        want = duckdb.sql(f"SELECT quantile_cont(v, {share}) AS q FROM rows GROUP BY k ORDER BY k").fetchnumpy()["q"]
        assert np.array_equal(states._between(x, share).ravel(), want)


def test_quantiles_of_odd_states():
    x = np.array([[[np.nan, np.inf, -np.inf, 1.0]], [[1.0, np.inf, 2.0, 2.0]], [[1.0, 0.0, 2.0, 4.0]]])
    assert np.array_equal(states._between(x, 0.5), [[np.nan, np.inf, 2.0, 2.0]], equal_nan=True)
    assert np.array_equal(states._between(x[:0], 0.5), np.zeros((1, 4)))
