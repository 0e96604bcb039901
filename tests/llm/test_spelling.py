import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from heddle.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    out, forms = [], {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 2 * n else None
        out.append((w, forms[w], n, len(found)))
    rows = set()
    for w, form, n, n_near in out:
        root = w
        while forms[root] is not None:
            root = forms[root]
        rows.add((w, form, root, n, n_near, words[form] if form is not None else None))
    return rows


def brute(docs):
    counts = Counter()
    for i, t in docs:
        for run in RUN.findall(t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return grouped({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


def corpus(seed, n):
    r = random.Random(seed)
    base = ["letter", "lettre", "Straße", "straßen", "ÀÉÎaa", "àéîaa", "banana", "bananas", "aaaaaa", "aaaaaaa", "aaaaa"]

    def typo(w):
        i, c = r.randrange(len(w)), r.choice("aeißÿ")
        return r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])

    return [(i, r.choice([" ", "-", "1"]).join(typo(w) if r.random() < 0.3 else w for w in r.choices(base, range(11, 0, -1), k=60))) for i in range(n)]


def test_equals_brute_force(spark):
    docs = corpus(1, 150) + [(None, "letter lettters " * 9), (None, None), (7, ""), (8, "1 2"), (9, "x×÷y " * 4), (10, "banana " * 30_000)] + corpus(1, 5)
    table = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, n long").repartition(3)
    got = spelling.variants(spelling.counted(table, damage=97))
    want = brute(docs)
    assert got.count() == len(want) and rows_of(got) == want
    assert len(want) > 100 and any(f and r != f for _, f, r, *_ in want)


@pytest.mark.parametrize("seed", range(2))
def test_links_of_a_dense_vocabulary(spark, seed):
    r = random.Random(seed)
    words = {"".join(r.choices("abc", k=r.randint(1, 6))): r.randint(1, 50) for _ in range(300)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = [tuple(x) for x in spelling.links(table).select("word", "near").collect()]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a in words for b in words if near(a, b)}
    assert rows_of(spelling.variants(table.withColumn("root", F.lit(1)))) == grouped(words)


def test_long_chains_end_at_their_root(spark):
    words = {"a" * (40 - i): 3 * 2**i for i in range(30)}
    got = {w: (f, root) for w, f, root, *_ in rows_of(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert all(root == "a" * 11 for _, root in got.values()) and got["a" * 11] == (None, "a" * 11)


def test_empty_and_null(spark):
    for docs in ([], [(1, None)], [(None, "ab cd")]):
        assert spelling.variants(spelling.counted(spark.createDataFrame(docs, "doc_id long, text string"), damage=97)).collect() == []


def test_no_join_sends_the_words_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(spelling, "stored", lambda df, name: plans.append(df) or stored(df, name=name))
    plans, stored = [], spelling.discard.__globals__["stored"]
    plans.append(spelling.variants(spark.createDataFrame([("letter", 9), ("lettre", 2), ("lettres", 1)], "word string, n long")))
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert sum("SortMergeJoin" in t for t in texts) >= 3 and not [t for t in texts if "Broadcast" in t]
