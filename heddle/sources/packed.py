"""Stores of token streams: answers in order of id, cut into shards of a stated size.

A store holds two tables in order of shard, as ranges of Parquet whose statistics lead to a shard: ``beams``, with each answer's number
of tokens and where they start in the shard, and ``tokens``.  So small shards don't become a file each.  A reader adds up the shards before, so the starts hold over the whole store, or over several stores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.functions import ranks

#: Bytes of a shard.
SHARD_BYTES = 1_800_000_000


def write(tokens: DataFrame, path: str, values: list[str], *, most_bytes: int = SHARD_BYTES) -> None:
    """Stores beam_id, prompt_id, y, pos and the values as floats.  All answers are in one shard where they fit; else each
    shard has the number of answers that would have the stated bytes on average.  A null answer is in no store."""
    tokens = tokens.where("beam_id IS NOT NULL").select("beam_id", "prompt_id", "y", "pos", *[F.col(v).cast("float").alias(v) for v in values])
    counted = tokens.groupBy("beam_id", "prompt_id", "y").agg(F.count("*").alias("n"))
    placed = ranks.value_rank(counted, "beam_id")
    total = counted.agg(F.count("*").alias("_beams"), (F.sum("n") * 4 * len(values)).alias("_bytes"))
    each = F.greatest(F.lit(1), F.floor(F.col("_beams") * most_bytes / F.col("_bytes")))
    shard = F.when(F.col("_bytes") <= most_bytes, F.lit(0)).otherwise(F.floor((F.col("rank") - 1) / each)).cast("int")
    beams = placed.join(F.broadcast(total)).withColumn("shard", shard).drop("rank", "_beams", "_bytes")  # one row
    first = Window.partitionBy("shard").orderBy("beam_id").rowsBetween(Window.unboundedPreceding, -1)
    beams = beams.withColumn("start", F.coalesce(F.sum("n").over(first), F.lit(0)))
    beams.repartitionByRange("shard", "beam_id").sortWithinPartitions("shard", "beam_id").write.parquet(f"{path}/beams")
    dealt = tokens.join(tokens.sparkSession.read.parquet(f"{path}/beams").select("beam_id", "shard"), "beam_id").drop("prompt_id", "y")
    dealt.repartitionByRange("shard", "beam_id", "pos").sortWithinPartitions("shard", "beam_id", "pos").write.parquet(f"{path}/tokens")


def read(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Answers, with ``start`` counted over all the stores in the order given and the shards numbered on, and their tokens."""
    beams = reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/beams").withColumn("store", F.lit(i)) for i, p in enumerate(paths)])
    tokens = reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/tokens").withColumn("store", F.lit(i)) for i, p in enumerate(paths)])
    order = Window.orderBy("store", "shard")  # a row a shard
    shards = beams.groupBy("store", "shard").agg(F.sum("n").alias("size"))
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("store", "shard", before.alias("before"), (F.row_number().over(order) - 1).alias("number"))
    join = lambda d: d.join(F.broadcast(shards), ["store", "shard"])
    beams = join(beams).withColumn("start", F.col("start") + F.col("before")).withColumn("shard", F.col("number")).drop("before", "number", "store")
    return beams, join(tokens).withColumn("shard", F.col("number")).drop("before", "number", "store")
