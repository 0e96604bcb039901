"""Views of the tables as answers ("beams") to prompts, their tokens and their judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LAYERS = CHANNELS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """beam_id, prompt_id, beam_idx, y and the packed tensor x, layer-major."""
    e = table(spark, sf_dir, "embeddings")
    prompt = F.floor(F.col("vec_id") / 10)
    return e.select(
        F.col("vec_id").alias("beam_id"),
        prompt.alias("prompt_id"),
        (F.col("vec_id") % 10).alias("beam_idx"),
        (F.col("label") >= prompt % 11).cast("int").alias("y"),
        F.col("embedding").alias("x"),
    )


def unpacked(packed: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """One row per cell: layer, ch and v beside the other columns."""
    rest = [c for c in packed.columns if c != "x"]
    cells = packed.select(*rest, F.posexplode("x").alias("i", "v"))
    return cells.select(*rest, F.floor(F.col("i") / channels).cast("int").alias("layer"), (F.col("i") % channels).alias("ch"), F.col("v").cast("double").alias("v"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams with two scores: the tensor's maximum and its mean, and a dataset."""
    x = F.transform("x", lambda v: v.cast("double"))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return beams(spark, sf_dir).select(
        "beam_id", "prompt_id", "y", (F.col("prompt_id") % 3).alias("dataset"), F.round(F.array_max(x), 2).alias("score"), F.round(mean, 3).alias("other")
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tokens of a user's answer, in order of time."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(
        F.col("user_id").alias("beam_id"),
        F.floor(F.col("user_id") / 10).alias("prompt_id"),
        (F.col("user_id") % 2).cast("int").alias("y"),
        pos.alias("pos"),
        (F.col("value") / (F.col("value") + 50)).alias("score"),
        F.col("event_type").alias("tok"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn of a conversation with the assistant's turn after it."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judgements of each labelled document, ten documents to a prompt."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("beam_id"), F.floor(F.col("doc_id") / 10).alias("prompt_id"), (F.col("quality") == 1).alias("ours"), (F.col("toxic") == 0).alias("theirs")
    )


#: The same views for DuckDB, as common table expressions.
SQL = """beams AS (SELECT vec_id AS beam_id, vec_id // 10 AS prompt_id, vec_id % 10 AS beam_idx, CAST(label >= (vec_id // 10) % 11 AS INTEGER) AS y, embedding AS x FROM embeddings),
cells AS (SELECT beam_id, prompt_id, beam_idx, y, CAST((i - 1) // 8 AS INTEGER) AS layer, CAST((i - 1) % 8 AS INTEGER) AS ch, CAST(x[i] AS DOUBLE) AS v
  FROM (SELECT *, unnest(range(1, 65)) AS i FROM beams)),
scored AS (SELECT beam_id, prompt_id, y, prompt_id % 3 AS dataset, round(max(v), 2) AS score, round(sum(v) / 64, 3) AS other FROM cells GROUP BY ALL),
tokens AS (SELECT user_id AS beam_id, user_id // 10 AS prompt_id, CAST(user_id % 2 AS INTEGER) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  value / (value + 50) AS score, event_type AS tok FROM events),
turns AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
samples AS (SELECT conv_id, turn, text AS question, answer FROM turns WHERE role = 'user' AND next_role = 'assistant'),
judges AS (SELECT doc_id AS beam_id, doc_id // 10 AS prompt_id, quality = 1 AS ours, toxic = 0 AS theirs FROM labels)"""
