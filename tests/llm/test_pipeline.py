import corpus_pipeline as P
from heddle.llm import decontaminate, neardup, secrets, toxicity
from heddle.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = read(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        was = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if name == "toxicity":
            model = toxicity.fit(before, read(spark, SF, "labels").where(toxicity.fold() != 0))
            assert ids == {r.doc_id for r in toxicity.score(before, model).where("predicted = 0").collect()}
        elif name == "near_duplicates":
            assert ids == {r.doc_id for r in neardup.near_duplicates(before).where("kept").collect()}
            assert neardup.near_duplicates(docs).where("not kept").count() == 0
        elif name == "decontamination":
            bench = [r.text for r in read(spark, SF, "benchmark").collect()]
            assert not [r for r in docs.collect() if any(b in r.text for b in bench)]
            assert was - ids == {r.doc_id for r in decontaminate.leaks(before, read(spark, SF, "benchmark")).collect()}
        else:
            assert ids == was
            strong = secrets.digest(secrets.spans(docs))
            assert strong.where("n_assign + n_access + n_hex > 0").count() == 0
        kept[name] = len(ids)
    rows = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == ids and len(set(kept.values())) > 1


def test_run_is_the_stages_in_turn(spark):
    rows = P.run(spark, SF).collect()
    assert rows and {"doc_id", "sequence_id", "length"} <= set(rows[0].asDict())


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    rows = [(1, None, None, None, None, "x"), (None, "some words here", "en", "s", 3, None), (2, "", "en", None, 0, None)]
    rows += [(3, "token=abcdefgh1 " + "w " * 30_000, "en", "s", 1, None)] * 2
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in P.STAGES:
            last, docs = docs, stage(spark, docs, SF)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert last.count() == len({r.doc_id for r in docs.select("doc_id").collect()}) or last.count() >= docs.select("doc_id").distinct().count()


def test_stages_keep_columns_of_any_name(spark):
    names = ["_key", "_k1", "_k2", "_gone", "gone", "_found", "bad", "start", "end", "node", "component_id", "kept", "score", "predicted", "_ID", "spans", "h", "i"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    rows = [(i, f"some clean words number {i} here", "en", "s", 3, *range(len(names))) for i in (1, 2, None)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert P.STAGES[-1][1](spark, docs, SF).count() >= 3
