import math
import random

import numpy as np

from heddle.llm import knn

SCHEMA = "vec_id long, embedding array<float>, v string, rank int"


def brute(rows, queries, k):
    def ints(v):
        return [math.floor(256 * x) for x in v] if v is not None and all(x is not None and math.isfinite(x) for x in v) else None

    data = sorted({(i, tuple(ints(v))) for i, v in rows if i is not None and ints(v) is not None})
    out = []
    for q, v in sorted({(i, tuple(ints(v))) for i, v in queries if i is not None and ints(v) is not None}):
        scored = sorted((-max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, x, strict=False)))), i) for i, x in data if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, **options):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    got = knn.top_k(df, df.where("vec_id % 3 = 0"), k=k, **options).collect()
    assert sorted(map(tuple, got)) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 3 == 0], k)


def vector(rng, n=8, scale=1.0):
    return [float(round(rng.gauss(0, scale) * 64) / 64) for _ in range(n)]


def test_blocks_and_ties(spark):
    rng = random.Random(5)
    hot = vector(rng)
    rows = [(i, hot if i % 3 < 2 and i % 2 else vector(rng)) for i in range(400)]
    check(spark, rows, pivots=9, block=16)
    centers = [vector(rng, scale=8) for _ in range(6)]
    check(spark, [(i, [c + x / 16 for c, x in zip(centers[i % 6], vector(rng), strict=True)]) for i in range(300)], k=3, pivots=6, block=20)


def test_odd_rows(spark):
    rng = random.Random(6)
    bad = [(100, None), (102, [1.0, None]), (105, [float("nan")] * 8), (108, [float("inf")] * 8), (None, vector(rng))]
    rows = [(i, vector(rng)) for i in range(4)] + bad + [(6, [1.0]), (9, []), (0, [0.5] * 8), (2, [3e7] * 8)]
    rows += [rows[0], (12, [0.0] * 8)]
    check(spark, rows, pivots=3)
    check(spark, [(3, [1.0, 2.0])])
    empty = spark.createDataFrame([], SCHEMA)
    assert knn.top_k(empty, empty).count() == 0


def test_components_of_any_size(spark):
    rng = random.Random(8)
    rows = [(i, vector(rng, scale=2.0 ** rng.choice([0, 20, 50, 60, 120]))) for i in range(60)]
    rows += [(60, [3e38] * 8), (61, [-3e38] * 8), (62, [3e38, -3e38, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (63, [0.0] * 8), (66, [1e30] * 8)]
    check(spark, rows, pivots=5, block=7)
    df = spark.createDataFrame([(i, [1e308, float(i)]) for i in range(4)], "vec_id long, embedding array<double>")
    assert knn.top_k(df, df).count() == 0
    df = spark.createDataFrame([(i, [1e250 * (i - 2), float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in knn.top_k(df, df, k=2, pivots=2).collect()}
    assert got[4, 1] == (3, 2**63 - 1) and got[0, 1] == (1, 2**63 - 1) and got[2, 1][0] == 4


def test_rings_rule_out_groups(spark):
    rng = random.Random(3)
    centers = [vector(rng, scale=40) for _ in range(8)]
    rows = [(i, [c + x / 64 for c, x in zip(centers[i % 8], vector(rng), strict=True)]) for i in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    data = knn.quantised(df, "vec_id", "embedding")
    known = knn._matrix([r.v for r in data.where("vec_id < 8").orderBy("vec_id").collect()])
    queries = data.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    norms = [float((known[i].astype(float) ** 2).sum()) for i in range(8)]
    asked = queries.selectExpr("query_id", "v", f"cast({max(norms) * 0.9} as double) as least")
    layout = knn.Layout(np.full(8 * knn.RINGS, 100.0), np.full(8 * knn.RINGS, 10), 16, 16)
    sent = knn._sent(asked, known, layout, first=False)
    assert sum(len(r.groups) for r in sent.collect()) < 0.5 * queries.count() * 8 * knn.RINGS


def test_a_query_travels_once_to_a_part(spark):
    """On vectors without structure, where no group is ruled out, rows grow with queries times parts, not groups; many pivots need bounded memory."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(600, 8)).tolist())], "vec_id long, embedding array<float>")
    queries = knn.quantised(df.where("vec_id % 20 = 0"), "vec_id", "embedding").selectExpr("vec_id as query_id", "v", "cast('-Infinity' as double) as least")
    known = knn._in_order(rng.integers(-900, 900, (16_384, 8)))
    sizes = np.full(16_384 * knn.RINGS, 10)
    layout = knn.Layout(np.full(len(sizes), 1e6), sizes, 4096, 65_536)
    parts = -(-int(sizes.sum()) // 65_536)
    found = knn._sent(queries, known, layout, first=False).select("query_id", "part").collect()
    assert len(found) == len(set(found)) == 30 * parts
    check(spark, [(i, v) for i, v in enumerate(rng.normal(size=(300, 8)).astype(np.float32).astype(float).tolist())], pivots=20, block=8, part=30)


def test_blocks_of_a_group_lie_in_several_parts():
    layout = knn.Layout(np.zeros(3), np.array([10, 1000, 5]), 100, 256)
    assert layout.blocks.tolist() == [1, 10, 1] and layout.start.tolist() == [0, 10, 1010]
    assert layout.parts(np.array([0, 1])) == [(0, [0, 1]), (1, [1]), (2, [1]), (3, [1])]
    assert layout.parts(np.array([2])) == [(3, [2])] and layout.parts(np.array([], int)) == []
