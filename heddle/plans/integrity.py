"""Queries that prove tables: manifests, validation suites, states from elsewhere."""

from pyspark.sql import functions as F

from heddle.operators import validation
from heddle.plans.registry import query
from heddle.sources import manifests, pairs, views

_SPAN, _FAN, _LEVELS = 16, 4, 4


def _text(column: str) -> str:
    return f"coalesce(length({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


def _tree(rows: str) -> str:
    h = f"sha256({_text('doc_id')} || ',' || {_text('text')} || ',' || {_text('lang')})"
    leaves = f"""SELECT 0 AS level, node, sum(c)::BIGINT AS n, sha256(string_agg(h || 'x' || c, ',' ORDER BY h || 'x' || c)) AS digest
FROM (SELECT doc_id // {_SPAN} AS node, {h} AS h, count(*) AS c FROM {rows} GROUP BY ALL) GROUP BY node"""
    out, names = f"l0 AS ({leaves})", ["l0"]
    for i in range(1, _LEVELS + 1):
        above = f"node // {_FAN}" if i < _LEVELS else "0::BIGINT"
        item = "(node || ':' || digest)"
        out += f", l{i} AS (SELECT {i} AS level, {above} AS node, sum(n)::BIGINT AS n, sha256(string_agg({item}, ',' ORDER BY {item})) AS digest FROM l{i - 1} GROUP BY ALL)"
        names.append(f"l{i}")
    return f"WITH {out} " + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)


def _made(rows):
    return manifests.tree(rows, "doc_id", ["text", "lang"], span=_SPAN, fan=_FAN, levels=_LEVELS)


@query(_tree("documents"), views=False)
def manifest_tree(spark, sf):
    return _made(views.table(spark, sf, "documents"))


@query(
    f"""SELECT doc_id // {_SPAN} * {_SPAN} AS first_key, doc_id // {_SPAN} * {_SPAN} + {_SPAN - 1} AS last_key, count(*) AS n_one, count(*) FILTER (doc_id % 89 <> 7) AS n_two
FROM documents GROUP BY 1, 2 HAVING bool_or(doc_id % 89 = 7 OR doc_id % 97 = 5 AND lang = 'en')""",
    views=False,
)
def manifest_changes(spark, sf):
    """Key ranges that differ from a version in which some rows are gone and others have another language."""
    d = views.table(spark, sf, "documents")
    other = d.where("doc_id % 89 <> 7").withColumn("lang", F.when((F.col("doc_id") % 97 == 5) & (F.col("lang") == "en"), "xx").otherwise(F.col("lang")))
    return manifests.difference(_made(d), _made(other), span=_SPAN, fan=_FAN)


_CHECKED = f"""WITH rows AS (SELECT *, conv_id || ':' || turn AS key FROM samples), convs AS (SELECT conv_id, count(*) AS n, count(*) FILTER (length(answer) > 200) AS long FROM rows GROUP BY conv_id)
SELECT name AS "check", n_checked, n_failed, CASE WHEN n_checked > 0 THEN (n_checked - n_failed) / n_checked END AS share, coalesce((n_checked - n_failed) / nullif(n_checked, 0) >= least, true) AS passed FROM (
SELECT 'answered' AS name, count(*) AS n_checked, count(*) FILTER (coalesce(trim(answer), '') = '') AS n_failed, 0.995 AS least FROM rows
UNION ALL SELECT 'not repeated', count(*), count(*) FILTER (question = answer), 1.0 FROM rows
UNION ALL SELECT 'round trip', count(*) FILTER (answer <> ''), 0, 0.9 FROM rows
UNION ALL SELECT 'turns', count(*), count(*) FILTER (n > 3), 1.0 FROM convs
UNION ALL SELECT 'long answers', count(*) FILTER (n >= 2), count(*) FILTER (n >= 2 AND long > 1), 0.5 FROM convs)"""


@query(_CHECKED, "share")
def validation_suite(spark, sf):
    """Answers of conversations: there, not the question again, the same ids after decoding; turns and long answers of a conversation."""
    import public_tokenizers

    rows = views.samples(spark, sf).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    checks = [
        validation.Check("answered", F.coalesce(F.trim("answer"), F.lit("")) == "", least=0.995),
        validation.Check("not repeated", F.coalesce(F.col("question") == F.col("answer"), F.lit(False))),
        validation.Check("round trip", ~validation.round_trips("answer", public_tokenizers.path("byte_bpe_50k.json")), counts=F.col("answer") != "", least=0.9),
        validation.Check("turns", F.col("n") > 3, group=True),
        validation.Check("long answers", F.col("long") > 1, counts=F.col("n") >= 2, least=0.5, group=True),
    ]
    return validation.report(rows, "key", "conv_id", checks, {"long": (F.length("answer") > 200).cast("long")}).drop("examples")


@query("SELECT beam_id, 'p' || prompt_id || '/' || (9 - beam_idx) AS state_key, ch AS i, sum(v) AS z FROM cells GROUP BY beam_id, prompt_id, beam_idx, ch", "z")
def external_pairs(spark, sf):
    """States of another run, under its own keys and in falling order, beside our answers, then projected: their sum over layers."""
    ours = views.beams(spark, sf).select("beam_id", "prompt_id", "beam_idx", "y")
    theirs = views.beams(spark, sf).select(
        F.concat(F.lit("p"), F.col("prompt_id")).alias("ind"), (9 - F.col("beam_idx")).alias("row"), (F.col("y") == 1).alias("flag"), F.col("x").alias("state")
    )
    theirs = theirs.withColumn("state_key", F.concat_ws("/", "ind", "row")).withColumn("prompt", F.substring("ind", 2, 20).cast("long")).drop("ind")
    both = pairs.aligned(
        ours.withColumn("label", F.col("y") == 1), theirs, prompt="prompt_id", order=["beam_idx"], label="label", their_prompt="prompt", their_order=[F.desc("row")], their_label="flag"
    )
    cells = views.LAYERS * views.CHANNELS
    matrix = spark.range(cells).select(F.col("id").cast("int").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(views.CHANNELS - 1)), lambda c: (c == F.col("id") % views.CHANNELS).cast("double")).alias("v"))
    found = pairs.projected(both, "state", pairs.projection(matrix, "i", "v"), "z")
    return found.select("beam_id", "state_key", F.posexplode("z").alias("i", "z"))
