import hashlib
import random
from collections import Counter

import pytest

from heddle.llm import suffixes

SCHEMA = "doc_id long, text string, d string, h string, kept int"


def brute(docs, length):
    data = [(t or "").encode() for _, t in docs]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(docs, data, strict=True):
        gone = [False] * len(t)
        end = 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                for k in range(max(i, end), i + length):
                    gone[k] = True
                end = i + length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, length):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], SCHEMA)
    got = suffixes.digest(suffixes.dedup_substrings(df, length=length))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, length)


@pytest.mark.parametrize(("seed", "length"), [(1, 32), (2, 40), (3, 100)])
def test_planted_overlaps(spark, seed, length):
    rng = random.Random(seed)
    letters = lambda n, k=4: "".join(rng.choice("abcdé"[:k]) for _ in range(n))
    shared = [letters(rng.randint(length - 5, 4 * length), 5) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, "a" * 300), (3, "ab" * 200), (4, letters(length - 1)), (None, shared[0])]
    for i in range(5, 60):
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s) + 1)))
            parts += [letters(rng.randint(0, 2 * length), 5), s[a:b] if rng.random() < 0.7 else s]
        docs.append((i, "".join(parts)))
    docs += [docs[10], docs[11], (99, docs[12][1])]
    check(spark, docs, length)


def test_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs, 400)


def test_empty_table_and_short_length(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert suffixes.dedup_substrings(df).count() == 0
    with pytest.raises(ValueError):
        suffixes.dedup_substrings(df, length=10)
