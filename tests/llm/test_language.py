import itertools

import numpy as np

from heddle.llm import language

SCHEMA = "doc_id long, text string, lang string, score string"


def test_forward_sums_all_segmentations():
    known = language.pieces(language.default_vocabulary_path())
    rng = np.random.default_rng(0)
    p = rng.random((known.size, 2)) / 50
    p[known.none] = 0
    for word in ["the", "other", "ßaß", "x日y"]:
        s, want = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(s)]
            parts = [s[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            ids = [known.ids.get(x, known.unknown if len(x) == 1 else known.none) for x in parts]
            want += np.prod([p[i] for i in ids], axis=0)
        got = language.forward(known.lattice([word]), p)[0, -1]
        assert np.allclose(got, want)


def test_expected_counts_match_enumeration():
    known = language.pieces(language.default_vocabulary_path())
    p = np.full((known.size, 1), 0.01)
    p[known.none] = 0
    counts = np.zeros(known.size)
    language.expected(known.lattice(["on"]), p, np.array([2.0]), counts)
    assert abs(sum(counts[known.ids[x]] * len(x) for x in known.ids if counts[known.ids[x]]) - 2 * 3) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.held_out_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "12 ²  --", "en", None), (4, "the " * 50, "en", None)]
    rows += [(5, "der die das " * 30, "de", None), (5, "der die das " * 30, "de", None), (6, "q" * 100_000, None, None), (None, "the", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(docs, language.fit(docs)).collect())
    assert got[1:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")] and len(got) == 8
    empty = spark.createDataFrame([], SCHEMA)
    assert language.held_out_query(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}


def test_predictions_match_a_plain_forward_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 600")
    model = language.fit(docs)
    known = language.pieces(language.default_vocabulary_path())

    def forward(word, k):
        s, f = "▁" + word, [1.0]
        for end in range(1, len(s) + 1):
            parts = ((f[a], s[a:end]) for a in range(end))
            f.append(sum(w * model.p[known.ids.get(x, known.unknown if len(x) == 1 else known.none), k] for w, x in parts))
        return np.log(f[-1])

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = language.identify(docs, model).collect()
    assert len(got) > 10
    for r in got[:40]:
        words = language.words_of(texts[r.doc_id])
        s = np.array([model.prior[k] + sum(forward(w, k) for w in words) for k in range(len(model.languages))])
        assert r.lang_pred == model.languages[s.argmax()] and abs(r.score - 1 / np.exp(s - s.max()).sum()) < 1e-6


def test_the_sample_of_rows_without_ids_is_bounded(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "concat('only', id, ' word') as text", "'en' as lang")
    read = []
    monkeypatch.setattr(language, "stored", lambda df, name: read.append(df.cache()) or df)
    assert language.fit(docs, docs_per_language=300, iterations=1).languages == ["en"]
    assert 200 < read[0].where("word = 'word'").first().n < 400
