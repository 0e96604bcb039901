import math
import random
import re
from collections import Counter

from heddle.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    documents, words = len(found), sum(n for _, n, _ in found)
    holding = Counter(t for _, _, c in found for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, n, c in found:
            m = 100 - 75 + 75 * n * documents // words
            s = 0
            for t in terms(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(spark, docs, items, k=10, **how):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, rank int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    blocks = {"block_pairs": how.pop("block_pairs")} if "block_pairs" in how else {}
    return sorted(map(tuple, lexical.search(lexical.build(d, **how), q, k, **blocks).collect()), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "Ä", "ä", "x1", "日本", "the", "THE", "of", " wide ", "z\x00y"]
    return [(i, " -".join(r.choices(words, [9, 5, 3, 2, 2, 2, 1, 20, 5, 20, 1, 1], k=r.randint(0, 40)))) for i in range(n)]


def test_equals_brute_force_over_shards_and_blocks(spark):
    docs = corpus(1, 300) + [(None, "alpha beta"), (None, None), (7, "alpha beta"), (7, "alpha beta"), (400, ""), (401, "--")]
    items = corpus(2, 12) + [(3, "alpha"), (3, "alpha"), (3, "beta"), (50, None), (51, "unknown"), (None, "gämma"), (52, "the the alpha")]
    want = brute(docs, items, 10)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, shard_terms=100, block_pairs=5) == want
    assert got(spark, docs, items, long_bytes=40) == want


def test_ties_go_to_the_smallest_ids_across_shards(spark):
    docs = [(i, "same words here") for i in range(200, 0, -1)] + [(0, "others")]
    found = got(spark, docs, [(1, "words")], 5, shard_terms=20)
    assert [(r, i) for _, r, i, _ in found] == [(n, n) for n in range(1, 6)]


def test_a_text_longer_than_a_piece(spark):
    long = "alpha beta,gamma " * 200_000
    docs = [(1, long), (2, "alpha"), (3, long + "delta")]
    assert len(long) > 3 * lexical.PIECE
    items = [(1, "delta alpha"), (2, "gamma")]
    assert got(spark, docs, items) == got(spark, docs, items, long_bytes=1 << 30) == brute(docs, items, 10)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []
