import heapq
import random
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from heddle.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def dealt(weights, most, seats):
    """Seats one by one to the highest quotient."""
    got = [0] * len(weights)
    heap = [(-Fraction(w), i) for i, w in enumerate(weights) if w > 0 and most[i] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-Fraction(weights[i]) / (2 * got[i] + 1), i))
    return got


def targets(words):
    """Source to target by the words of each, by repeated resharing."""
    order = sorted((s for s in words if s is not None)) + [s for s in words if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(words.values())
    while True:
        rest = total - sum(3 * words[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        now = {s: 3.0 * words[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in capped and now[s] > 3 * words[s]}
        if not over:
            return order, now
        capped |= over


def cases(seed):
    r = random.Random(seed)
    weights = [r.choice([0, 1, 1, 3, 7, 1000, r.randint(1, 10**6)]) for _ in range(r.randint(1, 30))]
    most = [r.randint(0, 60) for _ in weights]
    return weights, most, r.randint(0, sum(m for m, w in zip(most, weights, strict=True) if w))


@pytest.mark.parametrize("seed", range(40))
def test_highest_quotients_one_by_one(seed):
    weights, most, seats = cases(seed)
    assert mixing.highest(np.array(weights, float), np.array(most), seats).tolist() == dealt(weights, most, seats)


@pytest.mark.parametrize("seed", range(3))
def test_distributed_quotients_one_by_one(spark, seed):
    weights, most, seats = cases(seed + 5)
    rows = spark.createDataFrame([(i, float(w), m) for i, (w, m) in enumerate(zip(weights, most, strict=True))], "place long, weight double, most long")
    got = mixing.apportioned(rows, seats).orderBy("place").collect()
    assert [r["seats"] for r in got] == dealt(weights, most, seats)


def corpus(seed):
    r = random.Random(seed)
    rows = [(i, " \t".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["é", "Z", "a", "hot", "hot", "hot", "ab", ""])) for i in range(300)]
    return [*rows, (None, "a b c", "tiny"), (5, None, "null text"), (6, "x " * 500, None), (7, "y", None), (8, "long " * 20_000, "a"), (9, "r r", "Z"), (9, "r r", "Z")]


def mixed(spark, rows, parts=3, **how):
    return mixing.mix(spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, source string, target string").repartition(parts), **how).collect()


@pytest.mark.parametrize("block", [64, 1])
def test_targets_sizes_and_bounds(spark, block):
    rows = corpus(1)
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += len(WORDS.findall(t or ""))
    order, want = targets(words)
    got = mixed(spark, rows, block=block)
    assert sorted((str(r["doc_id"]), str(r["source"]), r["size"]) for r in got) == sorted((str(i), str(s), len(WORDS.findall(t or ""))) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == words[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    seats = dealt([want[s] for s in order], [-(-3 * words[s] // block) for s in order], round(sum(words.values()) / block))
    assert {s: taken[s] for s in order} == {s: min(n * block, 3 * words[s]) for s, n in zip(order, seats, strict=True)}
    assert all(abs(taken[s] - want[s]) <= block for s in order)


def test_reruns_agree_on_any_layout(spark):
    rows = corpus(2)
    a, b = (sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixed(spark, x, parts)) for x, parts in ((rows, 1), (rows[::-1], 7)))
    assert a == b != sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixed(spark, rows, seed="1"))


def test_whole_documents_and_shards_take_part(spark):
    rows = [(i, "w " * 100, "ab"[i % 2]) for i in range(400)]
    got = mixed(spark, rows)
    parts = [sum(r["taken"] for r in got if r["source"] == s) for s in "ab"]
    assert abs(parts[0] - 40_000 / 3) <= 64 and abs(parts[1] - 80_000 / 3) <= 64
    assert sum(r["taken"] > 0 for r in got if r["source"] == "a") > 150 and all(r["taken"] in range(100, 201) for r in got if r["source"] == "b")


def test_no_words_and_no_rows(spark):
    assert mixed(spark, []) == []
    assert [(r["taken"], r["target"]) for r in mixed(spark, [(1, None, None), (2, "", "a"), (None, " ", "a")])] == [(0, 0.0)] * 3
