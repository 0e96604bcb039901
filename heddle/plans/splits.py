"""Queries on splits and their audits."""

from heddle.operators import splits
from heddle.plans.registry import query
from heddle.sources import views

_KNOWN = "known AS (SELECT prompt_id, bool_or(y = 0) AS is_known FROM beams GROUP BY prompt_id)"
_QUESTION = f"""{_KNOWN}, ranked AS (SELECT prompt_id, row_number() OVER (ORDER BY sha256('42:' || prompt_id)) AS r, count(*) OVER () AS n FROM known WHERE is_known),
question AS (SELECT k.prompt_id, is_known, CASE WHEN r <= floor(0.75 * n) THEN 'train' ELSE 'valid' END AS part FROM known k LEFT JOIN ranked USING (prompt_id))"""
_ANSWER = f"""{_KNOWN}, ranked AS (SELECT beam_id, row_number() OVER (ORDER BY sha256('42:' || beam_id)) AS r, count(*) OVER () AS n FROM beams JOIN known USING (prompt_id) WHERE is_known),
answer AS (SELECT b.beam_id, prompt_id, CASE WHEN r <= floor(0.75 * n) THEN 'train' ELSE 'valid' END AS part FROM beams b LEFT JOIN ranked USING (beam_id))"""


def _rows(spark, sf):
    return views.beams(spark, sf).drop("x")


def split_answer_rows(spark, sf):
    return splits.by_answer(_rows(spark, sf))


@query(f"WITH {_KNOWN} SELECT prompt_id, is_known FROM known")
def is_known(spark, sf):
    return splits.known_prompts(_rows(spark, sf))


@query(f"WITH {_QUESTION} SELECT prompt_id, is_known, part FROM question")
def split_question(spark, sf):
    return splits.by_question(splits.known_prompts(_rows(spark, sf)))


@query(f"WITH {_ANSWER} SELECT beam_id, prompt_id, part FROM answer")
def split_answer(spark, sf):
    return split_answer_rows(spark, sf)


@query(
    """SELECT beam_id, y, CASE WHEN row_number() OVER (PARTITION BY y ORDER BY sha256('42:' || beam_id)) <= floor(0.8 * count(*) OVER (PARTITION BY y)) THEN 'train' ELSE 'valid' END AS part FROM beams"""
)
def split_stratified(spark, sf):
    return splits.stratified(_rows(spark, sf), "y").select("beam_id", "y", "part")


@query("""SELECT beam_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || beam_id)) <= floor(0.75 * count(*) OVER ()) THEN 'train' ELSE 'valid' END AS part FROM beams WHERE y = 0""")
def split_anomaly(spark, sf):
    return splits.stratified(_rows(spark, sf).where("y = 0"), "y", share=0.75).select("beam_id", "part")


@query("SELECT prompt_id, CAST((row_number() OVER (ORDER BY prompt_id) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT prompt_id FROM beams)")
def group_folds(spark, sf):
    return splits.folds(_rows(spark, sf))


@query("SELECT prompt_id, CAST((row_number() OVER (ORDER BY sha256('7:' || prompt_id)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT prompt_id FROM beams)")
def shuffled_folds(spark, sf):
    return splits.folds(_rows(spark, sf), seed=7)


@query(
    """SELECT prompt_id, CAST((row_number() OVER (ORDER BY prompt_id) - 1) % 3 AS INTEGER) AS fold FROM (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i
FROM (SELECT DISTINCT prompt_id FROM beams)) WHERE i % 5 <> 0"""
)
def inner_folds(spark, sf):
    outer = splits.folds(_rows(spark, sf)).where("fold <> 0").drop("fold")
    return splits.folds(outer, 3)


def _audit(name: str) -> str:
    return f"""SELECT CAST(sum(t) AS BIGINT) AS train_rows, CAST(sum(v) AS BIGINT) AS valid_rows, count(*) FILTER (t > 0) AS train_prompts, count(*) FILTER (v > 0) AS valid_prompts,
count(*) FILTER (t > 0 AND v > 0) AS "both", count(*) FILTER (t > 0 AND v > 0 AND is_known) AS known_both, count(*) FILTER (t > 0 AND NOT is_known) AS unknown_in_train FROM
(SELECT prompt_id, count(*) FILTER (part = 'train') AS t, count(*) FILTER (part = 'valid') AS v FROM {name} GROUP BY prompt_id) JOIN known USING (prompt_id)"""


@query(f"WITH {_ANSWER} {_audit('answer')}")
def leak_audit_answer(spark, sf):
    rows = _rows(spark, sf)
    return splits.audit(splits.by_answer(rows), splits.known_prompts(rows))


@query(f"WITH {_QUESTION} {_audit('(SELECT b.beam_id, prompt_id, part FROM beams b JOIN question USING (prompt_id))')}")
def leak_audit_question(spark, sf):
    rows = _rows(spark, sf)
    known = splits.known_prompts(rows)
    return splits.audit(rows.join(splits.by_question(known), "prompt_id"), known)


@query(
    """SELECT prompt_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || prompt_id)) <= floor(0.75 * count(*) OVER ()) THEN 'train' ELSE 'valid' END AS part FROM (SELECT DISTINCT prompt_id FROM beams)"""
)
def split_any_question(spark, sf):
    return splits.by_any_question(_rows(spark, sf))
