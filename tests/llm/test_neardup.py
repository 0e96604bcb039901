import random
import re
from collections import Counter, defaultdict

import numpy as np

from heddle.llm import neardup
from heddle.llm.graph import components

SCHEMA = "doc_id long, text string, component_id string, node int"


def brute(docs, percent):
    def sets(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    found = {d: sets(t) for d, t in docs}
    at, up = defaultdict(list), {d: d for d in found}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sorted(found):
        common = Counter(e for x in found[d] for e in at[x])
        for e, n in common.items():
            if 100 * n >= percent * (len(found[d]) + len(found[e]) - n):
                a, b = top(d), top(e)
                up[max(a, b)] = min(a, b)
        for x in found[d]:
            at[x].append(d)
    return {d: (len(found[d]), top(d)) for d in found}


def check(spark, docs, percent):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, percent=percent).collect()}
    assert got == brute(docs, percent)


def test_tables_match_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, 85)


def test_chains_and_a_large_group(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    docs, text = [], [word() for _ in range(120)]
    for i in range(60):  # each differs from the one before by a word
        docs.append((i * 7 + 3, " ".join(text)))
        text[rng.randrange(120)] = word()
    center = [word() for _ in range(100)]
    for i in range(300):  # each differs from a centre by its own word
        own = list(center)
        own[rng.randrange(100)] = word()
        docs.append((1000 + i, " ".join(own)))
    check(spark, docs, 80)


def test_a_hub_of_variants_that_are_not_linked_to_one_another(spark):
    rng = random.Random(11)
    hub = [f"h{i}" for i in range(200)]
    docs, held = [(7, " ".join(hub))], np.ones((5000, 196), np.float32)  # which shingles of the hub a variant has
    for i in range(5000):
        own = list(hub)
        for part in range(3):
            at = 4 + part * 66 + rng.randrange(60)
            own[at] = f"v{i}x{part}"
            held[i, at - 4 : at + 1] = 0
        docs.append((1000 + i, " ".join(own)))
    kept = held.sum(1)
    common = held @ held.T
    linked = common >= 0.8 * (2 * 196 - common)
    assert (kept >= 0.85 * (2 * 196 - kept)).all() and linked.sum() < 0.2 * linked.size
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, percent=85).collect()}
    assert len(got) == 5001 and set(got.values()) == {7}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one  two"), (None, "one two"), (5, "ONE\ttwo"), (7, "a\x1cb c d"), (8, "z " * 50_000), (9, "z " * 40_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (6, 1, 4, False), (0, 1, None, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False)], key=str
    )
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 7


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (5000, 1000), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(501)) and got[5000] == got[1001] == got[1000] == 1000
    assert components(edges.limit(0)).count() == 0


def test_components_by_rounds_and_by_tasks_are_the_same(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300)] + [(9_000, 8_000 + i) for i in range(300)] + [(rng.randrange(20_000, 21_000), rng.randrange(20_000, 21_000)) for _ in range(600)]
    pairs += [(b, a) for a, b in pairs[::7]] + pairs[::5] + [(3, 3), (None, 4), (10**12, -5)]
    rng.shuffle(pairs)
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            p, q = top(a), top(b)
            up[max(p, q)] = min(p, q)
    right = sorted((x, top(x)) for x in up)
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    for local in (40, 100_000):
        assert sorted(map(tuple, components(edges, local=local).collect())) == right


def test_components_of_few_edges_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long").repartition(4)
    sc = spark.sparkContext
    sc.setJobGroup("few-edges", "few-edges")
    try:
        assert components(edges).count() == 501
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = {k for j in track.getJobIdsForGroup("few-edges") for k in track.getJobInfo(j).stageIds}
    assert len(stages) <= 16  # rounds over all tasks took eight each
