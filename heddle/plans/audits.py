"""Queries on composition, agreement, alignment, energy and reports."""

from pyspark.sql import functions as F

from heddle.functions import ranks
from heddle.operators import audits, ranking
from heddle.plans.ranking import _DRAWS, _REPS, _SEED
from heddle.plans.registry import query
from heddle.sources import views

_GAP = """gaps AS (SELECT layer, avg(norm) FILTER (y = 1) - avg(norm) FILTER (y = 0) AS gap, sqrt((var_samp(norm) FILTER (y = 1) + var_samp(norm) FILTER (y = 0)) / 2) AS dev
FROM (SELECT beam_id, y, layer, sqrt(sum(v * v)) AS norm FROM cells GROUP BY ALL) GROUP BY layer)"""


def _cells(spark, sf):
    return views.unpacked(views.beams(spark, sf))


@query(
    """SELECT prompt_id % 3 AS dataset, count(*) AS n_prompts, count(*) FILTER (h > 0 AND t > 0) AS n_mixed, count(*) FILTER (h = 0) AS n_all_true, count(*) FILTER (t = 0) AS n_all_false,
CAST(sum(h * t) AS BIGINT) AS n_pairs, sum(h) / sum(h + t) AS rate FROM (SELECT prompt_id, sum(y) AS h, sum(1 - y) AS t FROM beams GROUP BY prompt_id) GROUP BY dataset""",
    "rate",
)
def composition(spark, sf):
    return audits.composition(views.scored(spark, sf), ["dataset"])


@query(
    """SELECT count(*) FILTER (ours AND theirs) AS "both", count(*) FILTER (ours AND NOT theirs) AS only_a, count(*) FILTER (NOT ours AND theirs) AS only_b,
count(*) FILTER (NOT ours AND NOT theirs) AS neither, avg(CASE WHEN ours = theirs THEN 1.0 ELSE 0.0 END) AS agreement FROM judges""",
    "agreement",
)
def confusion(spark, sf):
    return audits.confusion(views.judges(spark, sf), "ours", "theirs")


@query(
    """SELECT count(*) AS n_prompts, count(*) FILTER (a) AS known_a, count(*) FILTER (b) AS known_b, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b AND NOT a) AS gained
FROM (SELECT prompt_id, bool_or(ours) AS a, bool_or(theirs) AS b FROM judges GROUP BY prompt_id)"""
)
def partition_delta(spark, sf):
    return audits.status_flips(views.judges(spark, sf), "ours", "theirs")


@query(
    """SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched, count(*) FILTER (b.doc_id IS NULL) AS left_only, count(*) FILTER (a.doc_id IS NULL) AS right_only,
count(*) FILTER (a.y <> b.quality) AS differing FROM (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS y FROM documents) a FULL JOIN labels b ON a.doc_id = b.doc_id""",
    views=False,
)
def align_check(spark, sf):
    """Documents called good by their length, against those labelled good."""
    by_length = views.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("y"))
    labelled = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return audits.alignment(by_length, labelled, "doc_id", "y")


@query(
    """SELECT coalesce(a.key, b.key) AS key, a.n AS "left", b.n AS "right" FROM (SELECT source AS key, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source) a
FULL JOIN (SELECT source AS key, count(*) AS n FROM documents WHERE lang = 'de' GROUP BY source) b ON a.key = b.key WHERE a.n IS DISTINCT FROM b.n""",
)
def config_diff(spark, sf):
    d = views.table(spark, sf, "documents")
    side = lambda g: d.where(F.col("lang") == g).groupBy(F.col("source").alias("key")).agg(F.count("*").alias("value"))
    return audits.config_diff(side("en"), side("de"))


@query(
    """SELECT layer, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_nan, CAST(sum(i) AS BIGINT) AS n_inf, CAST(sum(z) AS BIGINT) AS n_zero, count(*) FILTER (m = 0) AS n_empty FROM
(SELECT layer, beam_id, max(abs(v)) AS m, count(*) FILTER (isnan(v)) AS n, count(*) FILTER (isinf(v)) AS i, count(*) FILTER (v = 0) AS z FROM cells GROUP BY ALL) GROUP BY layer"""
)
def integrity_audit(spark, sf):
    return audits.integrity(_cells(spark, sf), ["layer"])


@query(f"WITH {_GAP} SELECT layer, gap, gap / CASE WHEN dev > 0 THEN dev END AS standard_gap FROM gaps", "gap standard_gap")
def layer_divergence(spark, sf):
    return audits.energy_gap(_cells(spark, sf), [])


def _window(size: str) -> str:
    return f"""WITH {_GAP}, p AS (SELECT arg_max(layer, (s, -layer)) AS peak FROM (SELECT layer, {size} AS s FROM gaps) WHERE layer BETWEEN 1 AND 6 AND s IS NOT NULL)
SELECT peak, CAST(least(greatest(peak - 1, 0), 5) AS INTEGER) AS first, CAST(least(greatest(peak - 1, 0), 5) + 2 AS INTEGER) AS last FROM p"""


@query(_window("abs(gap)"))
def energy_window(spark, sf):
    return audits.peak_window(audits.energy_gap(_cells(spark, sf), []), views.LAYERS)


@query(_window("abs(gap) - lag(abs(gap)) OVER (ORDER BY layer)"))
def gradient_window(spark, sf):
    return audits.peak_window(audits.energy_gap(_cells(spark, sf), []), views.LAYERS, gradient=True)


@query(
    f"""WITH {_GAP}, s AS (SELECT max(gap) - min(gap) AS span, avg(gap) AS mean, arg_max(layer, (gap, -layer)) AS peak, arg_max(gap, layer) AS fin, arg_min(gap, layer) AS ini, max(gap) AS top FROM gaps)
SELECT peak, CASE WHEN span < 1e-3 OR span < 0.02 * (abs(mean) + 1e-9) THEN 'flat' WHEN peak = 0 THEN 'falling' WHEN peak = 7 THEN 'rising' WHEN top > ini AND top > fin THEN 'peaked' ELSE 'mixed' END AS shape FROM s"""
)
def profile_shape(spark, sf):
    return audits.profile_shape(audits.energy_gap(_cells(spark, sf), []), "gap")


@query(
    f"""WITH {_DRAWS}, norms AS (SELECT beam_id, prompt_id, y, layer, sqrt(sum(v * v)) AS norm FROM cells GROUP BY ALL), sums AS (SELECT rep, layer, y, sum(k) AS n, sum(k * norm) AS s,
sum(k * norm * norm) AS q FROM norms JOIN draws USING (prompt_id) GROUP BY ALL), both_ AS (SELECT rep, layer, max(n) FILTER (y = 1) AS n1, max(s) FILTER (y = 1) AS s1, max(q) FILTER (y = 1) AS q1,
max(n) FILTER (y = 0) AS n0, max(s) FILTER (y = 0) AS s0, max(q) FILTER (y = 0) AS q0 FROM sums GROUP BY ALL), gap AS (SELECT layer, (s1 / n1 - s0 / n0) / sqrt(((q1 - s1 * s1 / n1) / (n1 - 1) +
(q0 - s0 * s0 / n0) / (n0 - 1)) / 2) AS g FROM both_ WHERE n0 >= 2 AND n1 >= 2)
SELECT layer, count(*) AS n_reps, avg(g) AS mean, quantile_cont(g, 0.025) AS lo, quantile_cont(g, 0.975) AS hi FROM gap GROUP BY layer""",
    "mean lo hi",
)
def layer_divergence_ci(spark, sf):
    return audits.energy_gap_interval(_cells(spark, sf), ranking.draws(views.scored(spark, sf), _REPS, _SEED))


@query(
    """SELECT a.layer, count(*) AS n, count(*) FILTER (a.v <> b.v) AS differing, max(abs(a.v - b.v)) AS most, avg(abs(a.v - b.v)) AS mean, corr(a.v, b.v) AS corr
FROM cells a JOIN cells b ON a.prompt_id = b.prompt_id AND b.beam_idx = 0 AND a.layer = b.layer AND a.ch = b.ch GROUP BY a.layer""",
    "most mean corr",
)
def version_difference(spark, sf):
    """Every answer's cells against those of its prompt's first answer."""
    c = _cells(spark, sf)
    first = c.where("beam_idx = 0").select("prompt_id", "layer", "ch", F.col("v").alias("w"))
    return audits.version_difference(c.join(first, ["prompt_id", "layer", "ch"]), "v", "w", ["layer"])


@query("SELECT layer, ch, share FROM (SELECT layer, ch, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS share FROM cells WHERE prompt_id % 5 <> 0 GROUP BY ALL) WHERE share BETWEEN 0.4 AND 0.5", "share")
def bandpass(spark, sf):
    return audits.bandpass(_cells(spark, sf).where("prompt_id % 5 <> 0"), 0.4, 0.5)


@query(
    """SELECT min(t) AS least, max(t) AS most, avg(t) AS mean, quantile_cont(t, 0.01) AS q01, quantile_cont(t, 0.05) AS q05, quantile_cont(t, 0.25) AS q25, quantile_cont(t, 0.5) AS q50, quantile_cont(t, 0.75) AS q75, quantile_cont(t, 0.95) AS q95, quantile_cont(t, 0.99) AS q99,
count(*) FILTER (t < 0.01) AS below_2, count(*) FILTER (t < 0.0001) AS below_4, count(*) FILTER (t < 0.000001) AS below_6 FROM (SELECT prompt_id, sum(d * d) AS t FROM (SELECT prompt_id, v - avg(v) OVER (PARTITION BY prompt_id, layer, ch) AS d FROM cells) GROUP BY prompt_id)""",
    "least most mean q01 q05 q25 q50 q75 q95 q99",
)
def trace_distribution(spark, sf):
    from heddle.operators import scaling

    t = scaling.centred(_cells(spark, sf), ["prompt_id", "layer", "ch"]).groupBy("prompt_id").agg(F.sum(F.col("delta") ** 2).alias("t"))
    q = {f"q{int(100 * p):02d}": p for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)}
    all_ = t.withColumn("all", F.lit(0))
    ends = t.agg(F.min("t").alias("least"), F.max("t").alias("most"), F.avg("t").alias("mean"), *[F.sum((F.col("t") < 10.0**-n).cast("long")).alias(f"below_{n}") for n in (2, 4, 6)])
    return ends.join(F.broadcast(ranks.quantiles(all_, ["all"], F.col("t"), q).drop("all")))  # one row


@query("SELECT y, layer, avg(norm) AS mean_norm, avg(norm * norm) AS energy FROM (SELECT beam_id, y, layer, sqrt(sum(v * v)) AS norm FROM cells GROUP BY ALL) GROUP BY y, layer", "mean_norm energy")
def score_report(spark, sf):
    norms = _cells(spark, sf).groupBy("beam_id", "y", "layer").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    return norms.groupBy("y", "layer").agg(F.avg("norm").alias("mean_norm"), F.avg(F.col("norm") ** 2).alias("energy"))


@query("SELECT prompt_id, string_agg(CAST(beam_id AS VARCHAR), ',' ORDER BY beam_idx) AS beams FROM beams GROUP BY prompt_id")
def group_beams(spark, sf):
    g = views.beams(spark, sf).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("beam_idx", "beam_id"))).alias("b"))
    return g.select("prompt_id", F.array_join(F.transform("b", lambda x: x["beam_id"].cast("string")), ",").alias("beams"))


@query(
    """SELECT dataset, arg_max(name, (auroc, name)) AS best, max(auroc) AS auroc FROM (SELECT a.dataset, 'score' AS name, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc
FROM scored a JOIN scored b ON a.dataset = b.dataset AND a.y = 1 AND b.y = 0 GROUP BY ALL UNION ALL SELECT a.dataset, 'other', sum(CASE WHEN a.other > b.other THEN 1.0 WHEN a.other = b.other THEN 0.5 ELSE 0 END) / count(*)
FROM scored a JOIN scored b ON a.dataset = b.dataset AND a.y = 1 AND b.y = 0 GROUP BY ALL) GROUP BY dataset""",
    "auroc",
)
def best_condition(spark, sf):
    s = views.scored(spark, sf)
    one = ranking.auroc(s, ["dataset"]).withColumn("name", F.lit("score"))
    two = ranking.auroc(s.drop("score").withColumnRenamed("other", "score"), ["dataset"]).withColumn("name", F.lit("other"))
    return one.union(two).groupBy("dataset").agg(F.max_by("name", F.struct("auroc", "name")).alias("best"), F.max("auroc").alias("auroc"))


_PIECES = " || ':' || ".join(f"coalesce(bit_xor(CAST('0x' || substr(h, {at}, 15) AS BIGINT)), 0)" for at in (1, 16, 31, 46))


@query(
    f"""SELECT lang, source, count(*) AS n, sha256(count(*) || ':' || {_PIECES} || ':' || CAST(sum(CAST('0x' || substr(h, 59, 6) AS BIGINT)) AS BIGINT)) AS digest
FROM (SELECT lang, source, sha256(doc_id || ':' || coalesce(text, '')) AS h FROM documents) GROUP BY lang, source""",
    views=False,
)
def manifest_hash(spark, sf):
    """A digest of each part of a table that any change of an id or a text changes, whatever the order of its rows: the rows'
    hashes are combined bit by bit and by a sum, so no task holds a part's rows."""
    hashed = F.sha2(F.concat_ws(":", "doc_id", F.coalesce("text", F.lit(""))), 256)
    d = views.table(spark, sf, "documents").select("lang", "source", hashed.alias("h"))
    number = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("long")
    g = d.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.bit_xor(number(at, 15)).alias(f"x{at}") for at in (1, 16, 31, 46)], F.sum(number(59, 6)).alias("s"))
    return g.select("lang", "source", "n", F.sha2(F.concat_ws(":", "n", "x1", "x16", "x31", "x46", "s"), 256).alias("digest"))


@query("SELECT split_part(source || '-' || lang, '-', 2) AS prefix, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY prefix", views=False)
def lang_filter(spark, sf):
    d = views.table(spark, sf, "documents").where(F.col("lang").isin("en", "de"))
    return d.groupBy(F.split_part(F.concat_ws("-", "source", "lang"), F.lit("-"), F.lit(2)).alias("prefix")).agg(F.count("*").alias("n"))


@query("SELECT beam_id, CAST(('0x' || substr(sha256('0:' || beam_id), 57, 8)) AS BIGINT) % 2147483648 AS seed FROM beams")
def prompt_seed(spark, sf):
    low = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(0), "beam_id"), 256), 57, 8), 16, 10).cast("long")
    return views.beams(spark, sf).select("beam_id", (low % (1 << 31)).alias("seed"))


@query(
    "SELECT prompt_id, count(*) AS n, count(*) FILTER (score > m) AS above FROM (SELECT *, avg(score) OVER (PARTITION BY dataset) AS m FROM scored) GROUP BY prompt_id ORDER BY above DESC, prompt_id LIMIT 25"
)
def worst_prompts(spark, sf):
    rows = views.scored(spark, sf)
    s = rows.join(rows.groupBy("dataset").agg(F.avg("score").alias("m")), "dataset")
    return s.groupBy("prompt_id").agg(F.count("*").alias("n"), F.sum((F.col("score") > F.col("m")).cast("long")).alias("above")).orderBy(F.desc("above"), "prompt_id").limit(25)
