"""Stores of results by condition, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write(metrics: DataFrame, scores: DataFrame, path: str) -> None:
    """Metrics (condition, name, value) and scores (condition, beam_id, ...) in two tables by condition; conditions that are
    there already are replaced, the others stay."""
    for name, rows in (("metrics", metrics), ("scores", scores)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/metrics"), spark.read.parquet(f"{path}/scores")


def split_inline(old: DataFrame) -> DataFrame:
    """Scores of results in the older form, which holds a condition's in one array (condition, beam_ids, scores), a row each."""
    return old.select("condition", F.explode(F.arrays_zip("beam_ids", "scores")).alias("s")).select("condition", F.col("s.beam_ids").alias("beam_id"), F.col("s.scores").alias("score"))


def replaced(board: DataFrame, entries: DataFrame, version: str = "version") -> DataFrame:
    """A leaderboard where the entries take the place of all entries of their versions."""
    return board.join(F.broadcast(entries.select(version).distinct()), version, "left_anti").unionByName(entries, allowMissingColumns=True)  # a row a version


def best(metrics: DataFrame, keys: list[str], names: list[str], value: str) -> DataFrame:
    """By keys: the row of the highest value, ties to the first by name; nulls don't count."""
    top = metrics.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*names)).alias("_who"))
    return top.groupBy(*keys).agg(F.max_by("_who", value).alias("_who"), F.max(value).alias(value)).select(*keys, *[F.col(f"_who.{n}").alias(n) for n in names], value)


def roll_up(datasets: DataFrame, question: DataFrame, answer: DataFrame, stages: dict[str, DataFrame]) -> DataFrame:
    """A row a dataset: its best condition and detector by question and by answer, in percent, what the split by answer leaks
    (their difference), and whether each stage's table has it.  ``question`` and ``answer`` are dataset, condition, kind and auroc."""
    percent: Column = F.round(100 * F.col("auroc"), 2)
    out = datasets
    for name, found in (("question", question), ("answer", answer)):
        top = best(found, ["dataset"], ["condition", "kind"], "auroc")
        out = out.join(top.select("dataset", F.col("condition").alias(f"{name}_condition"), F.col("kind").alias(f"{name}_kind"), percent.alias(f"{name}_best")), "dataset", "left")
    for name, table in stages.items():
        out = out.join(table.select("dataset").distinct().withColumn(name, F.lit("present")), "dataset", "left").fillna("missing", [name])
    return out.withColumn("leakage", F.round(F.col("answer_best") - F.col("question_best"), 2))


def compared(found: DataFrame, known: DataFrame, key: str, value: str, *, tolerance: float = 0.01) -> DataFrame:
    """Values beside those of an earlier report: both, their difference, and matched, missing on one side, or differing by more than the tolerance."""
    both = found.select(key, F.col(value).alias("found")).join(known.select(key, F.col(value).alias("known")), key, "full")
    d = F.col("found") - F.col("known")
    state = F.when(F.col("known").isNull(), "new").when(F.col("found").isNull(), "missing").when(F.abs(d) <= tolerance, "matched").otherwise("differs")
    return both.select(key, "found", "known", d.alias("difference"), state.alias("state"))


def aligned(one: DataFrame, two: DataFrame, key: str, same: list[str], renamed: dict[str, str] | None = None) -> DataFrame:
    """Two files of the same rows put side by side by key, the second's columns renamed first.  The query fails where a column
    that both hold differs, or where a key stands on one side alone."""
    two = two.withColumnsRenamed(renamed or {})
    right = two.select(key, F.lit(True).alias("_two"), *[F.col(c).alias(f"_{c}") for c in same], *[c for c in two.columns if c != key and c not in same])
    both = one.withColumn("_one", F.lit(True)).join(right, key, "full")
    agree = F.coalesce(F.col("_one") & F.col("_two"), F.lit(False))
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.col(f"_{c}"))
    failed = F.raise_error(F.concat(F.lit(f"the sides differ at {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return both.where(F.when(agree, True).otherwise(failed.cast("boolean"))).drop("_one", "_two", *[f"_{c}" for c in same])


def required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; fails at once where a column is missing."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows
