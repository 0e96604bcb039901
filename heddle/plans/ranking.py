"""Queries on ranking quality and its uncertainty."""

from pyspark.sql import functions as F

from heddle.operators import ranking
from heddle.plans.registry import query
from heddle.sources import views

_PAIRS = "sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)"
_REPS, _SEED = 1000, 42
_DRAWS = f"""listed AS (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i FROM (SELECT DISTINCT prompt_id FROM scored)),
size AS (SELECT count(*) AS n FROM listed),
draws AS (SELECT rep, prompt_id, count(*) AS k FROM (SELECT rep, CAST('0x' || substr(sha256('{_SEED}:' || rep || ':' || l.i), 1, 8) AS BIGINT) % n AS i
  FROM listed l, size, range({_REPS}) r(rep)) JOIN listed USING (i) GROUP BY ALL)"""


def _replicates(score: str, within: bool) -> str:
    weight, on = ("d.k * d.k", "a.prompt_id = b.prompt_id") if within else ("d.k * e.k", "true")
    second = "JOIN draws e ON e.rep = d.rep AND e.prompt_id = b.prompt_id"
    return f"""SELECT d.rep, sum({weight} * CASE WHEN a.{score} > b.{score} THEN 1.0 WHEN a.{score} = b.{score} THEN 0.5 ELSE 0.0 END) / sum({weight}) AS auroc
FROM scored a JOIN draws d ON d.prompt_id = a.prompt_id JOIN scored b ON {on} {second} WHERE a.y = 1 AND b.y = 0 GROUP BY d.rep"""


@query(f"SELECT a.dataset, {_PAIRS} / count(*) AS auroc FROM scored a JOIN scored b ON a.dataset = b.dataset AND a.y = 1 AND b.y = 0 GROUP BY a.dataset", "auroc")
def auroc_pooled(spark, sf):
    return ranking.auroc(views.scored(spark, sf), ["dataset"])


@query(
    f"""SELECT a.dataset, {_PAIRS} / count(*) AS auroc, count(*) AS n_pairs, count(DISTINCT a.prompt_id) AS n_mixed
FROM scored a JOIN scored b ON a.prompt_id = b.prompt_id AND a.y = 1 AND b.y = 0 GROUP BY a.dataset""",
    "auroc",
)
def auroc_within(spark, sf):
    return ranking.within_prompt(views.scored(spark, sf), ["dataset"])


_INTERVAL = "SELECT count(*) AS n_reps, avg(auroc) AS mean, quantile_cont(auroc, 0.025) AS lo, quantile_cont(auroc, 0.975) AS hi FROM"


def _with_draws(sql: str) -> str:
    return f"WITH {_DRAWS} {sql}"


@query(_with_draws(f"{_INTERVAL} ({_replicates('score', False)})"), "mean lo hi")
def bootstrap_ci(spark, sf):
    return ranking.bootstrap(views.scored(spark, sf), reps=_REPS, seed=_SEED)


@query(_with_draws(f"{_INTERVAL} ({_replicates('score', True)})"), "mean lo hi")
def bootstrap_ci_within(spark, sf):
    return ranking.bootstrap(views.scored(spark, sf), reps=_REPS, seed=_SEED, within=True)


def _paired(within: bool) -> str:
    return _with_draws(
        f"""SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM
(SELECT p.auroc - q.auroc AS d FROM ({_replicates('score', within)}) p JOIN ({_replicates('other', within)}) q USING (rep))"""
    )


@query(_paired(False), "mean lo hi")
def paired_delta(spark, sf):
    return ranking.paired_delta(views.scored(spark, sf), "score", "other", reps=_REPS, seed=_SEED)


@query(_paired(True), "mean lo hi")
def paired_delta_within(spark, sf):
    return ranking.paired_delta(views.scored(spark, sf), "score", "other", reps=_REPS, seed=_SEED, within=True)


@query(_with_draws("SELECT rep, prompt_id, k FROM draws"))
def prompt_draws(spark, sf):
    return ranking.draws(views.scored(spark, sf), _REPS, _SEED)


@query(
    """SELECT dataset, avg(a) AS mean, stddev_pop(a) AS std, min(a) AS least, max(a) AS most FROM (SELECT a.dataset, a.prompt_id,
sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) / count(*) AS a
FROM scored a JOIN scored b ON a.prompt_id = b.prompt_id AND a.y = 1 AND b.y = 0 GROUP BY ALL) GROUP BY dataset""",
    "mean std least most",
)
def fold_summary(spark, sf):
    each = ranking.auroc(views.scored(spark, sf), ["dataset", "prompt_id"]).where("auroc IS NOT NULL")
    a = F.col("auroc")
    return each.groupBy("dataset").agg(F.avg(a).alias("mean"), F.stddev_pop(a).alias("std"), F.min(a).alias("least"), F.max(a).alias("most"))


_REPEATS = """twice AS (SELECT prompt_id, y, score, other FROM scored UNION ALL SELECT prompt_id, y, round(score * 2, 2), round(other * 2, 3) FROM scored)"""


@query(
    f"""WITH {_DRAWS}, {_REPEATS}, each AS (SELECT a.prompt_id, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS p,
sum(CASE WHEN a.other > b.other THEN 1.0 WHEN a.other = b.other THEN 0.5 ELSE 0.0 END) AS q, count(*) AS n FROM twice a JOIN twice b ON a.prompt_id = b.prompt_id AND a.y = 1 AND b.y = 0 GROUP BY ALL),
d AS (SELECT rep, sum(k * k * (p - q)) / sum(k * k * n) AS d FROM draws JOIN each USING (prompt_id) GROUP BY rep)
SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM d""",
    "mean lo hi",
)
def paired_delta_repeats(spark, sf):
    """Two repeats of each answer's scores, the second of them doubled, in one within-prompt bootstrap."""
    one = views.scored(spark, sf).withColumn("repeat", F.lit(0))
    two = one.select("beam_id", "prompt_id", "y", "dataset", F.round(F.col("score") * 2, 2).alias("score"), F.round(F.col("other") * 2, 3).alias("other"), F.lit(1).alias("repeat"))
    return ranking.paired_delta_over_repeats(one.unionByName(two), "score", "other", reps=_REPS, seed=_SEED, within=True)
