"""Queries on stores and reports of results."""

from pyspark.sql import functions as F

from heddle.operators import audits, conditions, ranking
from heddle.plans.ranking import _PAIRS, _REPS, _SEED, _replicates, _with_draws
from heddle.plans.registry import query
from heddle.sources import packed, results, scratch, texts, views

_BYTES = 2048


def _token_store(by: str, limit: int) -> str:
    return f"""SELECT beam_id, CAST(CASE WHEN b * 4 <= {limit} THEN 0 ELSE floor((i - 1) / greatest(1, floor(m * {limit} / (b * 4)))) END AS INTEGER) AS shard, n, total FROM
(SELECT *, row_number() OVER (ORDER BY beam_id) AS i, count(*) OVER () AS m, sum(n) OVER () AS b FROM (SELECT beam_id, count(*) AS n, sum(CAST(CAST(score AS FLOAT) AS DOUBLE)) AS total
FROM tokens WHERE {by} GROUP BY beam_id))"""


@query(f"SELECT beam_id, shard, n, CAST(sum(n) OVER (ORDER BY beam_id) - n AS BIGINT) AS start, total FROM ({_token_store('true', _BYTES)})", "total")
def packed_tokens(spark, sf):
    """Token streams written in shards and read back."""
    path = scratch.folder(spark, name="packed")
    packed.write(views.tokens(spark, sf), path, ["score"], most_bytes=_BYTES)
    return _totals(*packed.read(spark, path))


def _totals(beams, tokens):
    total = tokens.groupBy("beam_id").agg(F.sum(F.col("score").cast("double")).alias("total"))
    return beams.join(total, "beam_id").select("beam_id", "shard", "n", "start", "total")


@query(
    f"""SELECT beam_id, CAST(dense_rank() OVER (ORDER BY store, shard) - 1 AS INTEGER) AS shard, n, CAST(sum(n) OVER (ORDER BY store, beam_id) - n AS BIGINT) AS start, total FROM
(SELECT 0 AS store, * FROM ({_token_store('y = 0', _BYTES)}) UNION ALL SELECT 1, * FROM ({_token_store('y = 1', _BYTES)}))""",
    "total",
)
def merged_tokens(spark, sf):
    """Two stores, of answers with either label, read as one."""
    paths = []
    for y in (0, 1):
        paths.append(scratch.folder(spark, name="packed"))
        packed.write(views.tokens(spark, sf).where(F.col("y") == y), paths[y], ["score"], most_bytes=_BYTES)
    return _totals(*packed.read(spark, *paths))


@query(
    """SELECT folder, n_rows, n_texts, CASE WHEN n_texts = 0 THEN 'NONE' WHEN n_texts = m AND n_rows = m THEN 'COMPLETE' ELSE 'PARTIAL' END AS verdict FROM (SELECT count(*) AS m FROM samples),
(SELECT 'answers' AS folder, count(*) AS n_rows, count(*) FILTER (answer <> '') AS n_texts FROM samples UNION ALL SELECT 'first', count(*), count(*) FILTER (question <> '' AND turn = 0) FROM samples
UNION ALL SELECT 'ids', count(*), 0 FROM samples) WHERE n_rows > 0"""
)
def text_inventory(spark, sf):
    """Folders of JSON lines with the answers, with the first questions alone, and with no text."""
    root, s = scratch.folder(spark, name="texts"), views.samples(spark, sf)
    s.select("conv_id", F.col("answer").alias("completion")).write.json(f"{root}/answers")
    s.select("conv_id", F.when(F.col("turn") == 0, F.col("question")).alias("text")).write.json(f"{root}/first")
    s.select("conv_id", F.lit("x").alias("note")).write.json(f"{root}/ids")
    return texts.inventory(spark, root, s.count())


_CONDITIONS = "SELECT beam_id, prompt_id, y, dataset, 'core' AS condition, score FROM scored UNION ALL SELECT beam_id, prompt_id, y, dataset, 'velocity', other FROM scored"


def _conditions(spark, sf):
    s, ids = views.scored(spark, sf), ["beam_id", "prompt_id", "y", "dataset"]
    one = s.select(*ids, F.lit("core").alias("condition"), "score")
    return one.unionByName(s.select(*ids, F.lit("velocity").alias("condition"), F.col("other").alias("score")))


@query(
    """SELECT condition, count(*) AS n, sum(score) AS total, 2 * sum(score) AS twice FROM (SELECT 'core' AS condition, score FROM scored UNION ALL SELECT 'velocity', -other FROM scored) GROUP BY condition""",
    "total twice",
)
def result_store(spark, sf):
    """Results of two conditions; those of one are written again with other scores, the other's in the older form."""
    path, rows = scratch.folder(spark, name="results"), _conditions(spark, sf)
    metric = lambda d: d.groupBy("condition").agg(F.lit("twice").alias("name"), (2 * F.sum("score")).alias("value"))
    each = rows.where("condition = 'core'").groupBy("condition", "prompt_id").agg(F.collect_list(F.struct("beam_id", "score")).alias("s"))  # ten answers a prompt
    core = results.split_inline(each.select("condition", F.col("s.beam_id").alias("beam_ids"), F.col("s.score").alias("scores")))
    velocity = rows.where("condition = 'velocity'").select("condition", "beam_id", "score")
    for part in (core, velocity, velocity.withColumn("score", -F.col("score"))):
        results.write(metric(part), part, path)
    metrics, scores = results.read(spark, path)
    found = scores.groupBy("condition").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    return found.join(metrics.select("condition", F.col("value").alias("twice")), "condition").select("condition", "n", "total", "twice")


_BY_CONDITION = f"SELECT a.dataset, a.condition, {_PAIRS} / count(*) AS auroc FROM c a JOIN c b ON a.dataset = b.dataset AND a.condition = b.condition AND a.y = 1 AND b.y = 0"


@query(
    f"""WITH c AS ({_CONDITIONS}), now AS ({_BY_CONDITION} GROUP BY ALL)
SELECT dataset, condition, 'two' AS version, auroc FROM now UNION ALL SELECT dataset, condition, 'one', auroc - 0.1 FROM now""",
    "auroc",
)
def leaderboard(spark, sf):
    """Entries of an older version stay, those of the same version go."""
    now = ranking.auroc(_conditions(spark, sf), ["dataset", "condition"])
    entry = lambda version, less: now.select("dataset", "condition", F.lit(version).alias("version"), (F.col("auroc") - less).alias("auroc"))
    return results.replaced(entry("one", 0.1).unionByName(entry("two", 0.2)), entry("two", 0.0))


_TOP = """SELECT dataset, first(condition ORDER BY auroc DESC, condition) AS condition, round(100 * max(auroc), 2) AS best FROM {} GROUP BY dataset"""


@query(
    f"""WITH c AS ({_CONDITIONS}), q AS ({_BY_CONDITION} GROUP BY ALL), w AS ({_BY_CONDITION} AND a.prompt_id = b.prompt_id GROUP BY ALL)
SELECT d.dataset, q.condition AS question_condition, CASE WHEN q.best IS NOT NULL THEN 'direct' END AS question_kind, q.best AS question_best, w.condition AS answer_condition,
CASE WHEN w.best IS NOT NULL THEN 'direct' END AS answer_kind, w.best AS answer_best, CASE WHEN j.dataset IS NULL THEN 'missing' ELSE 'present' END AS judged, round(w.best - q.best, 2) AS leakage
FROM (SELECT CAST(unnest(range(5)) AS BIGINT) AS dataset) d LEFT JOIN ({_TOP.format('q')}) q USING (dataset) LEFT JOIN ({_TOP.format('w')}) w USING (dataset)
LEFT JOIN (SELECT DISTINCT prompt_id % 2 AS dataset FROM judges) j USING (dataset)""",
    "question_best answer_best leakage",
)
def report_roll_up(spark, sf):
    """Five datasets, two of them without results; quality within prompts stands for the split by answer."""
    rows = _conditions(spark, sf)
    keys = ["dataset", "condition"]
    found = [d.select(*keys, F.lit("direct").alias("kind"), "auroc") for d in (ranking.auroc(rows, keys), ranking.within_prompt(rows, keys))]
    judged = views.judges(spark, sf).select((F.col("prompt_id") % 2).alias("dataset"))
    return results.roll_up(spark.range(5).withColumnRenamed("id", "dataset"), *found, {"judged": judged})


@query(
    f"""WITH c AS ({_CONDITIONS}), now AS ({_BY_CONDITION} GROUP BY ALL), f AS (SELECT dataset * 2 + CASE condition WHEN 'core' THEN 0 ELSE 1 END AS id, auroc FROM now),
k AS (SELECT id + 1 AS id, auroc FROM f)
SELECT id, f.auroc AS found, k.auroc AS known, f.auroc - k.auroc AS difference, CASE WHEN k.id IS NULL THEN 'new' WHEN f.id IS NULL THEN 'missing' WHEN abs(f.auroc - k.auroc) <= 0.01 THEN 'matched' ELSE 'differs' END AS state
FROM f FULL JOIN k USING (id)""",
    "found known difference",
)
def report_difference(spark, sf):
    """Each condition's quality beside the next one's."""
    now = ranking.auroc(_conditions(spark, sf), ["dataset", "condition"])
    f = now.select((F.col("dataset") * 2 + F.when(F.col("condition") == "core", 0).otherwise(1)).alias("id"), "auroc")
    return results.compared(f, f.withColumn("id", F.col("id") + 1), "id", "auroc")


@query("SELECT s.beam_id, s.y, s.score AS core, s.other AS velocity FROM scored s", "core velocity")
def aligned_files(spark, sf):
    """Two files of the same answers under other names, checked and put side by side."""
    s = results.required(views.scored(spark, sf), ["beam_id", "y", "score", "other"])
    two = s.select(F.col("beam_id").alias("id"), F.col("y").alias("is_false"), F.col("other").alias("velocity"))
    return results.aligned(s.select("beam_id", "y", F.col("score").alias("core")), two, "beam_id", ["y"], {"id": "beam_id", "is_false": "y"})


@query("SELECT beam_id, prompt_id, y FROM beams")
def checked_scan(spark, sf):
    """Answers of prompts that must have ten each, but for the last, inside which the table may end."""
    rows = results.required(views.beams(spark, sf), ["beam_id", "prompt_id", "y"]).select("beam_id", "prompt_id", "y")
    return audits.asserted_each(rows, "prompt_id", 10, open_end=True)


def _compared_scores(table: str, pairs: list[tuple[str, str]]) -> str:
    """Paired differences of columns of a table, as SQL."""
    here = lambda s, w: _replicates(s, w).replace("FROM scored a", f"FROM {table} a").replace("JOIN scored b", f"JOIN {table} b")
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS condition, '{b}' AS baseline, '{"within" if w else "pooled"}' AS metric, avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi,
quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM (SELECT p.auroc - q.auroc AS d FROM ({here(a, w)}) p JOIN ({here(b, w)}) q USING (rep))"""
        for a, b in pairs
        for w in (False, True)
    )


@query(
    _with_draws(
        f"""SELECT * FROM (WITH three AS (SELECT *, round(score + 3 * other, 3) AS blend FROM scored) {_compared_scores('three', [('blend', 'score'), ('blend', 'other')])})"""
    ),
    "mean lo hi",
)
def combined_deltas(spark, sf):
    """A new condition against two baselines, pooled and within prompts."""
    rows = views.scored(spark, sf).withColumn("blend", F.round(F.col("score") + 3 * F.col("other"), 3))
    return conditions.against(rows, ["blend"], ["score", "other"], reps=_REPS, seed=_SEED)


@query(
    _with_draws(
        f"""SELECT * FROM (WITH w AS (SELECT beam_id, prompt_id, y, round(avg(score) FILTER (pos < 4), 3) AS short, round(avg(score) FILTER (pos < 8), 3) AS middle, round(avg(score), 3) AS whole FROM tokens GROUP BY ALL)
{_compared_scores('w', [('short', 'middle'), ('short', 'whole'), ('middle', 'whole')])})"""
    ).replace("FROM scored)", "FROM tokens)"),
    "mean lo hi",
)
def window_replay(spark, sf):
    """Mean token scores over three windows, compared two by two on the same draws."""
    mean = lambda n: F.round(F.avg(F.when(F.col("pos") < n, F.col("score")) if n else F.col("score")), 3)
    rows = views.tokens(spark, sf).groupBy("beam_id", "prompt_id", "y").agg(mean(4).alias("short"), mean(8).alias("middle"), mean(None).alias("whole"))
    return conditions.replayed(rows, ["short", "middle", "whole"], reps=_REPS, seed=_SEED)
