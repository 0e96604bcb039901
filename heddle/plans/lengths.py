"""Queries on token sequences, windows and texts."""

from pyspark.sql import functions as F

from heddle.functions import columns, ranks
from heddle.operators import audits, pooling, splits
from heddle.plans.registry import query
from heddle.sources import views

_STOP = "error"
_LENGTHS = f"lengths AS (SELECT beam_id, count(*) AS n, coalesce(min(CASE WHEN tok = '{_STOP}' THEN pos END) + 1, count(*)) AS canonical FROM tokens GROUP BY beam_id)"


def _lengths(spark, sf):
    return pooling.canonical_length(views.tokens(spark, sf), F.col("tok") == _STOP)


@query(f"WITH {_LENGTHS} SELECT beam_id, n, canonical FROM lengths")
def canonical_len(spark, sf):
    return _lengths(spark, sf)


@query(f"WITH {_LENGTHS} SELECT beam_id, count(*) AS n, max(score) AS s_max, avg(score) AS s_mean FROM tokens JOIN lengths l USING (beam_id) WHERE pos < canonical GROUP BY beam_id", "s_max s_mean")
def window_truncated(spark, sf):
    kept = pooling.truncated(views.tokens(spark, sf), _lengths(spark, sf))
    return kept.groupBy("beam_id").agg(F.count("*").alias("n"), F.max("score").alias("s_max"), F.avg("score").alias("s_mean"))


@query(
    f"""WITH {_LENGTHS} SELECT count(*) AS n_beams, avg(n) AS mean, stddev_pop(n) AS std, min(n) AS least, max(n) AS most, quantile_cont(n, 0.5) AS median,
count(*) FILTER (n <> canonical) AS violations FROM lengths""",
    "mean std median",
)
def window_violations(spark, sf):
    return audits.length_stats(_lengths(spark, sf))


@query(
    f"""WITH {_LENGTHS} SELECT CASE WHEN tok = 'click' THEN 'eos_or_pad' WHEN tok = '{_STOP}' THEN 'custom_stop' WHEN pos < canonical THEN 'content' ELSE 'post_stop_extra' END AS kind,
count(*) AS n, avg(pos) AS mean_pos FROM tokens JOIN lengths USING (beam_id) GROUP BY kind""",
    "mean_pos",
)
def token_classes(spark, sf):
    return audits.token_classes(views.tokens(spark, sf), _lengths(spark, sf), _STOP, ["click"])


@query(f"WITH {_LENGTHS} SELECT n - canonical AS delta, count(*) AS beams FROM lengths GROUP BY delta")
def length_hist(spark, sf):
    return _lengths(spark, sf).groupBy((F.col("n") - F.col("canonical")).alias("delta")).agg(F.count("*").alias("beams"))


@query(
    f"""WITH {_LENGTHS}, s AS (SELECT kind, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM (SELECT CASE WHEN tok IN ('click') THEN 'pad' ELSE 'text' END AS kind FROM tokens JOIN lengths USING (beam_id)
WHERE pos >= canonical) GROUP BY kind) SELECT max(CASE WHEN kind = 'text' THEN share END) AS text_share, CASE WHEN max(CASE WHEN kind = 'text' THEN share END) > 0.5 THEN 'content' ELSE 'padding' END AS verdict FROM s""",
    "text_share",
)
def window_verdict(spark, sf):
    after = views.tokens(spark, sf).join(_lengths(spark, sf), "beam_id").where("pos >= canonical")
    share = after.agg(F.avg((F.col("tok") != "click").cast("double")).alias("text_share"))
    return share.withColumn("verdict", F.when(F.col("text_share") > 0.5, "content").otherwise("padding"))


@query("SELECT beam_id, n, CAST(sum(n) OVER (ORDER BY beam_id) - n AS BIGINT) AS first FROM (SELECT beam_id, count(*) AS n FROM tokens GROUP BY beam_id)")
def csr_offsets(spark, sf):
    n = views.tokens(spark, sf).groupBy("beam_id").agg(F.count("*").alias("n"))
    rows, bin_ = ranks.by_range(n, "beam_id")
    return ranks.running_total(rows, [], "beam_id", bin_, F.col("n"), "first")


@query("SELECT t.beam_id, pos, t.y FROM tokens t WHERE beam_id IN (SELECT beam_id FROM tokens GROUP BY beam_id HAVING count(*) > 60)")
def token_slice(spark, sf):
    t = views.tokens(spark, sf)
    chosen = t.groupBy("beam_id").agg(F.count("*").alias("n")).where("n > 60")
    return t.join(chosen, "beam_id", "left_semi").select("beam_id", "pos", "y")


@query("SELECT beam_id, regr_slope(ln(1 + score), pos) AS slope FROM tokens GROUP BY beam_id HAVING count(*) > 2", "slope")
def drift_slope(spark, sf):
    t = views.tokens(spark, sf)
    return t.groupBy("beam_id").agg(F.regr_slope(F.log(1 + F.col("score")), F.col("pos")).alias("slope"), F.count("*").alias("n")).where("n > 2").drop("n")


@query(
    """SELECT beam_id, avg(m / (t + 1e-9)) AS ratio FROM (SELECT beam_id, floor(pos / 8) AS step, sum(CASE WHEN pos % 8 < 3 THEN score ELSE 0 END) AS m, sum(score) AS t FROM tokens GROUP BY ALL) GROUP BY beam_id""",
    "ratio",
)
def lookback_ratio(spark, sf):
    """Share of a step's attention on its context, here the first three of eight sources, averaged over steps."""
    t = views.tokens(spark, sf).groupBy("beam_id", F.floor(F.col("pos") / 8).alias("step"))
    mass = t.agg(F.sum(F.when(F.col("pos") % 8 < 3, F.col("score")).otherwise(0.0)).alias("m"), F.sum("score").alias("t"))
    return mass.groupBy("beam_id").agg(F.avg(F.col("m") / (F.col("t") + 1e-9)).alias("ratio"))


@query("SELECT conv_id, turn, sha256(question) AS question, sha256(answer) AS answer FROM samples")
def sample_pairs(spark, sf):
    return views.samples(spark, sf).select("conv_id", "turn", F.sha2("question", 256).alias("question"), F.sha2("answer", 256).alias("answer"))


@query(
    """SELECT conv_id, turn, question_hash FROM (SELECT conv_id, turn, sha256(question) AS question_hash, row_number() OVER (PARTITION BY question ORDER BY conv_id, turn) AS n FROM samples) WHERE n = 1"""
)
def dedup_first(spark, sf):
    first = audits.first_of(views.samples(spark, sf), "question", ["conv_id", "turn"])
    return first.select("conv_id", "turn", F.sha2("question", 256).alias("question_hash"))


@query(
    """WITH RECURSIVE p AS (SELECT conv_id, turn, regexp_extract_all(lower(answer), '[a-z0-9]+') AS c, regexp_extract_all(lower(question), '[a-z0-9]+') AS r FROM samples),
l AS (SELECT conv_id, turn, c, r, 0 AS i, list_transform(range(len(r) + 1), lambda x: 0) AS row FROM p UNION ALL SELECT conv_id, turn, c, r, i + 1, list_prepend(0, list_transform(range(1, len(r) + 1),
lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda k: r[k] = c[i + 1]), lambda k: row[k] + 1)), 0)))) FROM l WHERE i < len(c))
SELECT conv_id, turn, CASE WHEN len(c) = 0 OR len(r) = 0 THEN 0.0 ELSE CAST(2 * row[-1] AS DOUBLE) / (len(c) + len(r)) END AS rouge_l FROM l WHERE i = len(c)""",
    "rouge_l",
)
def rouge_l(spark, sf):
    """ROUGE-L of each answer against its question, of all their words."""
    s = views.samples(spark, sf)
    return s.select("conv_id", "turn", columns.rouge_l(columns.words(F.col("answer")), columns.words(F.col("question"))).alias("rouge_l"))


@query("SELECT prompt_id, count(*) AS n FROM judges GROUP BY prompt_id HAVING count(*) <> 10")
def structure_check(spark, sf):
    return audits.structure(views.judges(spark, sf), "prompt_id", 10)


@query(
    f"""WITH {_LENGTHS} SELECT count(*) AS n, count(*) FILTER (a.n = b.canonical) AS equal, avg(CASE WHEN a.n = b.canonical THEN 1.0 ELSE 0.0 END) AS share FROM
(SELECT beam_id, count(*) AS n FROM tokens GROUP BY beam_id) a JOIN lengths b USING (beam_id)""",
    "share",
)
def length_matches(spark, sf):
    counted = views.tokens(spark, sf).groupBy("beam_id").agg(F.count("*").alias("n"))
    return audits.count_matches(counted, _lengths(spark, sf).select("beam_id", F.col("canonical").alias("n")), "beam_id", "n")


@query("SELECT beam_id FROM (SELECT DISTINCT beam_id FROM tokens) ORDER BY sha256('42:' || beam_id) LIMIT 100")
def row_subsample(spark, sf):
    return splits.subsample(views.tokens(spark, sf).select("beam_id").distinct(), "beam_id", 100)


@query(
    """WITH RECURSIVE o AS (SELECT beam_id, n, row_number() OVER (ORDER BY sha256('42:' || beam_id)) AS i FROM (SELECT beam_id, count(*) AS n FROM tokens GROUP BY beam_id)),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS beam_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, false AS taken UNION ALL
SELECT o.i, o.beam_id, o.n, CASE WHEN used + o.n <= 1000 OR used = 0 THEN used + o.n ELSE used END, used < 1000 AND (used + o.n <= 1000 OR used = 0) FROM g JOIN o ON o.i = g.i + 1)
SELECT beam_id, n FROM g WHERE taken"""
)
def token_budget(spark, sf):
    """Whole answers in hash order up to a thousand tokens."""
    n = views.tokens(spark, sf).groupBy("beam_id").agg(F.count("*").alias("n"))
    return splits.within_budget(n, "beam_id", "n", 1000)


@query(
    """WITH RECURSIVE o AS (SELECT prompt_id, n, row_number() OVER (ORDER BY n DESC, prompt_id) AS i FROM (SELECT prompt_id, count(*) AS n FROM tokens GROUP BY prompt_id)),
g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS prompt_id, CAST(0 AS BIGINT) AS size, 0 AS fold, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS loads UNION ALL
SELECT o.i, o.prompt_id, o.n, list_position(loads, list_min(loads)) - 1, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
FROM g JOIN o ON o.i = g.i + 1) SELECT prompt_id, size, CAST(fold AS INTEGER) AS fold FROM g WHERE i > 0"""
)
def size_folds(spark, sf):
    return splits.folds_by_size(views.tokens(spark, sf))
