import random

from heddle.llm import sentences as S

SCHEMA = "doc_id long, text string, d string, runs int"


def brute(docs):
    """By comparing every run with every other, as words."""
    cut = {d: S.units(t or "") for d, t in docs}
    words = {d: [tuple(p.lower().split()) for p in c] for d, c in cut.items()}
    found = {}
    for d, w in words.items():
        full = [i for i, x in enumerate(w) if x]
        for k in range(len(full)):
            for e in range(k + S.SENTENCES, len(full) + 1):
                if sum(len(w[i]) for i in full[k:e]) >= S.WORDS:
                    found.setdefault(tuple(w[i] for i in full[k:e]), []).append((d, full[k], full[e - 1] + 1))
                    break
    gone = {d: [False] * len(c) for d, c in cut.items()}
    for places in found.values():
        for d, a, b in sorted(places)[1:]:
            gone[d][a:b] = [True] * (b - a)
    return {d: (sum(gone[d]), "".join(p for p, g in zip(cut[d], gone[d], strict=True) if not g)) for d in cut}


def check(spark, docs):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_removed, r.text) for r in S.dedup_spans(df).collect()}
    assert got == brute(docs)
    return got


def test_units_cover_the_text():
    for t in ["", " a. b", "x! y?\n\n z", "w " * 100, "no end", "  lead " + "q " * 40 + ".\n"]:
        assert "".join(S.units(t)) == t


def test_planted_passages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    prose = lambda n: "".join(word() + rng.choice([" ", " ", " ", ". ", ",  "]) for _ in range(n))
    passage, one = prose(60), " ".join(word() for _ in range(70))
    docs = [(i, prose(rng.randint(5, 200))) for i in range(30)]
    docs += [(i, prose(40) + ".\n" + passage + ".\n" + prose(30)) for i in range(30, 36)]
    docs += [(i, prose(40) + one + prose(30)) for i in range(40, 44)]
    docs += [(50, docs[3][1]), (51, passage.upper()), (52, "In. " * 400), (53, None), (54, ""), (55, "z " * 60_000)]
    got = check(spark, docs)
    assert all(got[i][0] == 0 for i in range(30)) and all(got[i][0] > 0 for i in (*range(31, 36), *range(41, 44), 50, 51))
    assert all(len(set(one.split()) & set(got[i][1].split())) < 30 for i in range(41, 44))


def test_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])


def test_odd_rows(spark):
    rows = [(1, "a b c d e f. g h i j k. l m n o p."), (1, "a b c d e f. g h i j k. l m n o p."), (None, "a b c d e f. g h i j k. l m n o p.")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    assert sorted(r.n_removed for r in S.dedup_spans(df).collect()) == [0, 3, 3]
    assert S.dedup_spans(df.limit(0)).count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    passage = "a b c d e f. g h i j k. l m n o p."
    rows = [(-1, "one two. " + passage), (None, passage + " three four."), (None, passage), (7, passage), (7, "q. " + passage), (8, "so what. no."), (8, "so what. no.")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_repeated, r.n_removed) for r in S.dedup_spans(df).collect()]
    assert sorted(x[1] for x in got) == [0, 0, 3, 3, 3, 3, 3] and sorted(x[2] for x in got) == [0, 0, 0, 3, 3, 3, 3]
    assert [x[2] for x in got if x[0] is None].count(0) == 1
    alike = spark.createDataFrame([(None, passage, "x", 1)] * 2, SCHEMA)
    assert [(r.n_repeated, r.n_removed) for r in S.dedup_spans(alike).collect()] == [(3, 0)] * 2
    alike = spark.createDataFrame([(d, passage, "x", 1) for d in (-1, None)], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_removed) for r in S.dedup_spans(alike).collect()) == [(-1, 3), (0, 0)]


def test_scripts_without_spaces(spark):
    rng = random.Random(9)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) + ("。" if rng.random() < 0.1 else "") for _ in range(n))
    passage = text(80)
    docs = [(i, text(60) + passage + text(60)) for i in range(4)] + [(i, text(150)) for i in range(4, 8)] + [(9, "ดีมาก" * 3 + passage)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA)
    got = {r.doc_id: r for r in S.dedup_spans(df).collect()}
    assert all("".join(S.units(t)) == t for _, t in docs)
    assert all(got[i].n_removed == 0 for i in (0, 4, 5, 6, 7)) and all(len(got[i].text) < len(t) - 45 for i, t in docs if i in (1, 2, 3, 9))
