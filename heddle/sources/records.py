"""Nested records of a prompt's judged answers, as JSON lines or rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ind long, result array<struct<beam_id:long,is_correct:boolean>>"


def nested(judged: DataFrame, correct: str) -> DataFrame:
    """One record a prompt, its answers in order of beam."""
    answer = F.struct("beam_id", F.col(correct).alias("is_correct"))
    return judged.groupBy(F.col("prompt_id").alias("ind")).agg(F.array_sort(F.collect_list(answer)).alias("result"))


def flattened(records: DataFrame) -> DataFrame:
    return records.select("ind", F.explode("result").alias("r")).select("ind", "r.beam_id", "r.is_correct")


def write(records: DataFrame, path: str) -> None:
    """Known prompts (with a correct answer) and unknown ones, in two folders of JSON lines."""
    known = F.exists("result", lambda r: r["is_correct"])
    records.where(known).write.mode("overwrite").json(f"{path}/known")
    records.where(~known).write.mode("overwrite").json(f"{path}/unknown")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json([f"{path}/known", f"{path}/unknown"])
