import itertools
import random

from heddle.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic string, score string"


def distance(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
        if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_is_edit_distance_to_the_terms():
    rng = random.Random(1)
    terms, stems = ["abcab", "bbaac", "abcabcabc", "cc"], ["cab"]
    machine = T.Automaton(terms, stems)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        if w.startswith("cab"):
            assert machine.match(w) == T.STEM
            continue
        near = [distance(w, t) for t in terms if distance(w, t) <= T.errors_allowed(t)]
        want = None if not near else T.MISSPELLED if min(near) else T.TERM
        assert machine.match(w) == want, w


def test_quotation_and_address():
    lexicon = T.Lexicon(["idiot"], [])
    direct = lexicon.features("you are an idiot and more")
    quoted = lexicon.features('they wrote “an idiot” and more')
    assert direct[0] == 1 and quoted[0] == 0 and quoted[5] > 0 and direct[7] > 0
    assert lexicon.features("an idoit")[4] > 0 and lexicon.features("a id1ot")[4] > 0


def test_quotations_are_pairs_within_a_distance():
    lexicon = T.Lexicon(["idiot"], [])
    free = ['he said " and left. later: you are an idiot', "“never closed and so an idiot", 'a 12" board, you idiot', "„ging“ du idiot", "he’s an idiot, isn’t he", "«oui» idiot"]
    free += ['" ' + "word " * 100 + 'idiot "', "idiot “no”", "rock ’n roll idiot ’"]
    cited = ['"you idiot"', "“we don’t call him an idiot”", "„du idiot“", "»du idiot«", "« un idiot »", "‘an idiot’", '("idiot")', '“he said ‘so’ to the idiot”', 'x " idiot " y']
    for t in free:
        assert lexicon.features(t)[0] == 1 and lexicon.features(t)[5] == 0, t
    for t in cited:
        assert lexicon.features(t)[0] == 0 and lexicon.features(t)[5] > 0, t
    assert lexicon.features("“no” idiot")[6] > 0 and lexicon.features("“no” " + "x " * 9 + "idiot")[6] == 0


def test_terms_left_out_of_the_stems_stay_words(spark):
    rng = random.Random(2)
    plain = [f"plain{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=20)) + (f" {rng.choice(['zzbad', 'aabad'])}{i % 9}x" if i % 2 else ""), None, None) for i in range(800)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")
    few = T.fit(docs, labels, most_terms=1).lexicon
    assert len(few.stems) == 1 and few.terms != sorted(T.SEED_TERMS)


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = T.held_out_query(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in got)
    caught = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    assert hit >= 0.97 * len(got) and caught >= 0.8


def test_odd_rows(spark):
    rows = [(1, None, "a", None), (2, "", None, None), (3, "idiot " * 30_000, None, None), (None, "you stupid idiot, you scum", None, None), (4, "a b", None, None), (4, "a b", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic long")
    got = sorted(((r.doc_id or 0, r.predicted) for r in T.held_out_query(docs, none).collect()))
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (4, 0), (4, 0)]
    assert T.held_out_query(docs.limit(0), none).count() == 0
    kept = T.reject(docs, none)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 4]
