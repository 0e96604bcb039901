"""Queries on nested records and the token stream."""

from pyspark.sql import functions as F

from heddle.plans.registry import query
from heddle.sources import records, views
from heddle.streaming import tokens


@query("SELECT j.prompt_id AS ind, beam_id, ours AS is_correct FROM judges j")
def record_round_trip(spark, sf):
    """Rows nested by prompt and flattened again."""
    return records.flattened(records.nested(views.judges(spark, sf), "ours"))


@query("SELECT prompt_id AS ind, count(*) AS n, bool_or(ours) AS known FROM judges GROUP BY prompt_id")
def record_routes(spark, sf):
    return records.nested(views.judges(spark, sf), "ours").select("ind", F.size("result").cast("long").alias("n"), F.exists("result", lambda r: r["is_correct"]).alias("known"))


@query(
    """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, avg(value / (value + 50)) AS s_mean, max(value / (value + 50)) AS s_max FROM events GROUP BY ALL""",
    "s_mean s_max",
    views=False,
)
def windowed_tokens(spark, sf):
    return tokens.windowed_summary(views.table(spark, sf, "events"))
