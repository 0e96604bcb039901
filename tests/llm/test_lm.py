import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heddle.llm import lm

SCHEMA = "doc_id long, text string, row string, key int"


def words(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())] + [None]


def check(docs, got):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    c = Counter(w for d, t in docs if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in docs:
        w = words(t)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want.append((d, held(d), len(w), sum(c[x] > 0 for x in w), n, base))
    order = lambda r: (r[0] is None, r[0] or 0)
    for a, r in zip(sorted(want, key=order), sorted(got, key=order), strict=True):
        assert a[:5] == tuple(r)[:5] and math.isclose(a[5], r.base_score, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 1e-9


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = lm.held_out_query(docs).collect()
    check([tuple(r) for r in docs.select("doc_id", "text").collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "c c d a", "b a", "d d d e e"] * 5
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)
    model, counts = lm.fit(docs)
    known = [r.key for r in counts.collect()]
    assert len(known) == model.distinct == 6 and model.tokens == sum(len(words(t)) for t in texts)
    x = np.full((lm.CLASSES, lm.CONTEXT), 2)
    p = 10 ** lm.log_classes(model.parameters, x, np.arange(lm.CLASSES))
    assert math.isclose(p.sum(), 1, rel_tol=1e-6)
    shares = np.bincount(model.classes, 10**model.share, minlength=lm.CLASSES)
    assert np.allclose(shares[np.bincount(model.classes, minlength=lm.CLASSES) > 0], 1)


def test_every_position_is_a_target_once():
    for n in (0, 1, 7, 1000):
        assert np.array_equal(np.sort(np.concatenate([lm.targets(n, r) for r in range(lm.ROUNDS)])), np.arange(n))


def test_classes_come_from_all_documents(spark):
    texts = [f"f{i % 50} f{i % 47} f{i % 43}" for i in range(6000)] + [f"f1 rare{i} f2" for i in range(40)]
    docs = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts)], SCHEMA)
    model, _ = lm.fit(docs)
    keys = [lm.key_of(f"rare{i}".encode()) for i in range(40)]
    symbols = model.head_symbol[np.searchsorted(model.head, keys)]
    assert len(set(symbols.tolist())) == 40 and len(set(model.classes[symbols].tolist())) == 1  # the same company


def test_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(0)
    p = lm.Parameters.start(np.full(lm.CLASSES, 1 / lm.CLASSES))
    x, y = rng.integers(0, 50, (4000, lm.CONTEXT)), None
    y = x[:, 0] % lm.CLASSES  # the class follows from the word before
    before = lm.log_classes(p, x, y).mean()
    state = {}
    for _ in range(15):
        lm.train(p, x, y, np.full(lm.CLASSES, 1 / lm.CLASSES), rng, np.zeros(lm.SYMBOLS), state, batch=128)
    assert lm.log_classes(p, x, y).mean() > before + 0.8

def test_symbols_of_a_class_sum_to_one_and_are_drawn_by_their_shares(spark):
    docs = spark.createDataFrame([(i, f"the {a} {b} .", "", 1) for i, (a, b) in enumerate([("red", "fox"), ("old", "dog"), ("red", "dog")] * 40)], SCHEMA)
    model, _ = lm.fit(docs)
    p, members = model.parameters, lm.Members(model.classes, model.share)
    assert np.abs(p.u).max() > 0  # the symbols' vectors have moved
    every = np.arange(lm.SYMBOLS)
    h = lm.predicted(lm.tables(p), np.full((lm.SYMBOLS, lm.CONTEXT), 1))
    inside = np.bincount(model.classes, 10 ** lm.log_members(p, h, every, members), minlength=lm.CLASSES)
    assert np.allclose(inside[members.size > 0], 1, atol=1e-4)
    largest = int(np.argmax(members.size))
    drawn = members.draw(np.full(200_000, largest), np.random.default_rng(0)).ravel()
    assert np.abs(np.bincount(drawn, minlength=lm.SYMBOLS) / len(drawn) - np.where(model.classes == largest, 10**model.share, 0)).max() < 5e-3


def test_vectors_of_symbols_learn_what_follows():
    rng = np.random.default_rng(0)
    classes = np.arange(lm.SYMBOLS) % lm.CLASSES
    share = -np.log10(np.bincount(classes)[classes])
    members, p, state, moved = lm.Members(classes, share), lm.Parameters.start(np.full(lm.CLASSES, 1 / lm.CLASSES)), {}, np.zeros(lm.SYMBOLS)
    x = rng.integers(0, 4, (4000, lm.CONTEXT))
    s = x[:, 0] * lm.CLASSES  # all of class 0, told apart by the word before
    score = lambda: lm.log_members(p, lm.predicted(lm.tables(p), x), s, members).mean()
    before = score()
    for _ in range(15):
        lm.train(p, x, classes[s], np.full(lm.CLASSES, 1 / lm.CLASSES), rng, np.zeros(lm.SYMBOLS), state, batch=128, words=(s, members, moved))
    assert score() > before + 0.8 and set(np.flatnonzero(moved)) <= set(np.flatnonzero(classes == 0))


def test_keys():
    words = [b"", b"a", b"the", bytes(range(33, 256))]
    assert lm.keys_of(words).tolist() == [lm.key_of(w) for w in words]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "A a\x1ca É"), (3, "A a\x1ca É"), (None, "a b"), (4, "w " * 60_000), (5, "x" * 100_000)]
    docs = spark.createDataFrame([(d, t, "", 1) for d, t in rows], SCHEMA)
    got = lm.held_out_query(docs).collect()
    check(rows, got)
    assert lm.held_out_query(docs.limit(0)).count() == 0
    model, counts = lm.fit(docs.limit(0))
    assert {r.score for r in lm.score(docs, model, counts).collect()} == {0.0}
    assert pytest.approx(0) == model.base(0)


def test_scores_do_not_follow_tasks_or_pieces(spark):
    """The same model on any layout; texts longer than a piece train alike wherever they are cut."""
    import random

    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "ends."]
    docs = [(i, " ".join(r.choices(words, range(1, 8), k=r.randint(0, 60)))) for i in range(120)] + [(500, "the alpha of " * 30_000), (None, "the the"), (501, None)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    runs = []
    for parts in (1, 4, 32):
        model, counts = lm.fit(table.repartition(parts))
        runs.append({(x["doc_id"], x["n_tokens"]): x["score"] for x in lm.score(table, model, counts).collect()})
    for other in runs[1:]:
        assert other.keys() == runs[0].keys() and all(abs(other[k] - v) <= 1e-6 * max(1, abs(v)) for k, v in runs[0].items())


def test_groups_hold_every_training_symbol_once(spark):
    symbols = {i: np.arange(n) % 5000 for i, n in ((1, 3), (2, lm.PIECE_TOKENS), (3, 2 * lm.PIECE_TOKENS + 7), (4, 1))}
    rows = spark.createDataFrame([(i, bytearray(v.astype("<u2").tobytes())) for i, v in symbols.items()], "id long, symbols binary")
    seen = []
    for row in lm._groups(rows, 3).collect():
        for parts, leads in lm._texts(row.asDict()):
            for part, lead in zip(parts, leads, strict=True):
                found = np.frombuffer(part, "<u2")
                seen += found[lead:].tolist()
                assert lead == 0 or (np.diff(found[: lead + 1].astype(int)) % 5000 == 1).all()
    assert sorted(seen) == sorted(np.concatenate(list(symbols.values())).tolist())
