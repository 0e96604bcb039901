import random

import numpy as np

from heddle.llm import decontaminate as D

SCHEMA = "doc_id long, text string, item_id string, cosine int"
ITEMS = "item_id long, text string, doc_id long"


def lcs(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(-1, 6, rng.integers(1, 90)), rng.integers(-1, 6, rng.integers(0, 120))
        assert D.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def test_windows_cover_every_word():
    for sizes in ([0, 1, 5, 31, 32, 33, 48, 49, 500],):
        bounds = np.cumsum([0, *sizes])
        starts, ends = D.windows(bounds, 32)
        seen = np.zeros(bounds[-1], int)
        for a, e in zip(starts, ends, strict=True):
            assert np.searchsorted(bounds, a, side="right") == np.searchsorted(bounds, e - 1, side="right") and e - a <= 32
            seen[a:e] += 1
        assert seen.min() >= 1


def test_planted_items_and_paraphrases(spark):
    rng = random.Random(4)
    common = ["the", "of", "and", "to", "in", "is", "was"]
    rare = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rare() for _ in range(n))
    items = [(i, prose(rng.randint(15, 70)) + ".") for i in range(30)]
    docs, want = [], set()
    for i in range(150):
        text = prose(rng.randint(5, 400))
        if i % 5 == 0:
            j = rng.randrange(30)
            words = items[j][1].split()
            if i % 10 == 0:  # some words changed and left out
                words = [w if rng.random() < 0.85 else rare() for w in words if rng.random() < 0.95]
            text = text + ". " + " ".join(words).title() + " " + prose(rng.randint(0, 100))
            want.add((i, j))
        docs.append((i, text, "x", 1))
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(*x, 1) for x in items], ITEMS)
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert {(i, j) for i, j in want if i % 10} <= got
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i in range(150)} - {i for i, _ in got}


def test_items_of_very_different_lengths_in_one_block(spark):
    rng = random.Random(6)
    rare = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(4))
    prose = lambda n: [rare() for _ in range(n)]
    lengths = [8, 8, 31, 32, 120, 400, 1000, 1000]
    items = [prose(n) for n in lengths]
    docs, want = [], set()
    for i in range(96):
        words = prose(rng.randint(20, 300))
        if i % 3 < 2:
            j = i // 3 % len(items)
            # every fourth word is another one in the paraphrases
            copy = [rare() if i % 3 and k % 4 == 1 else w for k, w in enumerate(items[j])]
            words = words + copy + prose(rng.randint(0, 50))
            want.add((i, j))
        docs.append((i, " ".join(words), "x", 1))
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(j, " ".join(x), 1) for j, x in enumerate(items)], ITEMS)
    assert {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()} == want


def test_every_exact_passage_of_the_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = docs.collect(), bench.collect()
    want = {(r.doc_id, b.item_id) for r in texts for b in items if b.text in r.text}
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    assert want <= got and len(got) <= 1.1 * len(want)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta", 1), (2, None, 1), (3, " .. ", 1), (None, "alpha", 1)], ITEMS)
    rows = [(1, None), (2, ""), (3, "x " * 60_000 + "alpha beta gamma delta epsilon zeta eta theta"), (None, "Alpha beta gamma delta epsilon zeta, eta theta!"), (4, "other words")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows + rows[2:3]], SCHEMA)
    assert sorted((r.doc_id or 0, r.item_id) for r in D.leaks(df, bench).collect()) == [(0, 1), (3, 1), (3, 1)]
    assert D.leaks(df, bench.limit(0)).count() == 0 and D.leaks(df.limit(0), bench).count() == 0


def test_blocks_share_an_encoding_and_a_pass(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(23)]
    docs = [(i, " ".join(word() for _ in range(200)) + " " + items[i % 23][1] + " " + " ".join(word() for _ in range(100))) for i in range(46)]
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(20)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    encoded = []
    plain = D._encoded
    monkeypatch.setattr(D, "_encoded", lambda *a: encoded.append(1) or plain(*a))
    for name, n in (("BLOCK", 4), ("BLOCKS", 3), ("ENCODED", 15)):
        monkeypatch.setattr(D, name, n)
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench).collect()}
    assert got == {(i, i % 23) for i in range(46)} and len(encoded) == 2


def test_diluted_copies_are_found(spark):
    """Copies that lose words and have others between those kept: nine in ten of what exhaustive checks of the planted places find, for each mixture."""
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").where("text is not null").orderBy("doc_id").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    pool, rng, rows, want = [w for t in docs[:80] for w in t.split()], random.Random(7), [], {}
    mixtures = [(0, 0.8), (0, 0.6), (1, 0.8), (1, 0.7), (1.5, 0.9), (2, 0.9)]
    for s, (filler, keep) in enumerate(mixtures):
        for k in range(60):
            item, host = rng.choice(list(items)), rng.choice(docs).split()
            out = [x for w in items[item].split() if rng.random() < keep for x in (w, *rng.choices(pool, k=int(filler) + (rng.random() < filler % 1)))]
            at, i = rng.randint(0, len(host)), 1000 * (s + 1) + k
            rows.append((i, " ".join(host[:at] + out + host[at:])))
            want[i] = (s, item, D._words(items[item]), D._words(" ".join(out)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    other = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = {(r.doc_id, r.item_id) for r in D.leaks(table.union(other), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect()}
    clear = len(docs)
    for s in range(len(mixtures)):
        due = []
        for i, (mixture, item, words, place) in want.items():
            if mixture == s:
                number: dict[str, int] = {}
                a, b = (np.array([number.setdefault(w, len(number)) for w in x], int) for x in (words, place))
                rare = sorted(set(words), key=lambda w: sum(w in D._words(t) for t in docs))[: (len(set(words)) + 1) // 2]
                if D.common_subsequence(a, b) >= 0.5 * len(a) and len(set(rare) & set(place)) >= 0.5 * len(rare):
                    due.append((i, item))
        assert len(due) > 40 and sum(d in found for d in due) >= 0.9 * len(due), (mixtures[s], len(due), sum(d in found for d in due))
    assert len({i for i, _ in found if i < 1000}) < 0.2 * clear


def test_latent_space_is_fitted_on_every_window(spark, monkeypatch):
    """The Gram matrix is that of all windows of each size of more documents than the former sample of 2,000 had."""
    rng = np.random.default_rng(3)
    vocabulary, idf = {f"w{i}": i for i in range(40)}, rng.uniform(0.1, 5, 40)
    rows = [(i, " ".join(f"w{w}" if w < 40 else "other" for w in rng.integers(0, 60, rng.integers(0, 70)))) for i in range(3_000)]
    encoder = D.Space([], [], vocabulary, np.empty(0))
    encoded = D._encoded(spark.createDataFrame(rows, "doc_id long, text string"), encoder)
    space = D.Space([0], [np.arange(40, dtype=np.int32)], vocabulary, idf, local=np.append(np.arange(40), -1).astype(np.int32), classes={8: [0], 32: [0]})
    want, n = np.zeros((40, 40)), 0
    ids, bounds = encoder.batch(t for _, t in rows)
    for size in space.classes:
        for a, e in zip(*D.windows(bounds, size), strict=True):
            known = ids[a:e][ids[a:e] >= 0]
            if len(known):
                count = np.bincount(known, minlength=40)
                want += np.outer(count, count) / (idf[known] ** 2).sum()
                n += 1
    for cells in (D.CELLS, 100):  # in one pass and in several
        monkeypatch.setattr(D, "CELLS", cells)
        tables, cuts = D._products(encoded, space, spark.sparkContext.broadcast(space))
        assert (len(tables) > 1) == (cells == 100)
        got, found = np.zeros((40, 40)), [r for t in tables for r in t.collect()]
        for r in found:
            rows_, columns = np.triu_indices(cuts[r.block + 1] - cuts[r.block], 0, 40 - cuts[r.block])
            got[rows_ + cuts[r.block], columns + cuts[r.block]] = np.frombuffer(r.part, np.float32)
        assert {r.n for r in found} == {n} and {r.block for r in found} == set(range(len(cuts) - 1))
        assert np.allclose(np.triu(got), np.triu(want), rtol=1e-4)
    items = np.where(np.arange(40) >= 0, idf, 0) / np.linalg.norm(idf)
    whole = want * np.outer(idf, idf) / n + D.ITEM_WEIGHT * np.outer(items, items)
    basis = D._basis(encoded, space, 2)
    values, vectors = np.linalg.eigh(whole)
    assert abs(basis[:, 0] @ vectors[:, -1]) > 0.999
