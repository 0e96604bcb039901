"""Leak-audited splits: by prompt, by answer, grouped folds.  Order is by hash, so a split is a pure function of ids and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import ranks


def hashed(seed: int, *ids: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *ids), 256)


def known_prompts(rows: DataFrame) -> DataFrame:
    """Whether any answer of the prompt is truthful (y = 0)."""
    return rows.groupBy("prompt_id").agg(F.max(F.col("y") == 0).alias("is_known"))


def by_question(prompts: DataFrame, *, share: float = 0.75, seed: int = 42) -> DataFrame:
    """The first ``share`` of the known prompts in hash order train; other known and all unknown prompts validate."""
    known = prompts.where("is_known")
    n = known.agg(F.count("*").alias("n"))
    train = ranks.hash_rank(known, hashed(seed, "prompt_id")).join(F.broadcast(n)).where(F.col("rank") <= F.floor(share * F.col("n"))).select("prompt_id", F.lit("train").alias("part"))
    return prompts.join(train, "prompt_id", "left").select("prompt_id", "is_known", F.coalesce("part", F.lit("valid")).alias("part"))


def by_answer(rows: DataFrame, *, share: float = 0.75, seed: int = 42) -> DataFrame:
    """The same over the answers of known prompts, which lets a prompt stand on both sides."""
    known = rows.join(known_prompts(rows).where("is_known"), "prompt_id", "left_semi")
    n = known.agg(F.count("*").alias("n"))
    train = ranks.hash_rank(known, hashed(seed, "beam_id")).join(F.broadcast(n)).where(F.col("rank") <= F.floor(share * F.col("n"))).select("beam_id", F.lit("train").alias("part"))
    return rows.join(train, "beam_id", "left").select("beam_id", "prompt_id", F.coalesce("part", F.lit("valid")).alias("part"))


def stratified(rows: DataFrame, label: str, *, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``share`` of each class in hash order."""
    keyed = rows.withColumn("_key", hashed(seed, "beam_id"))
    placed = ranks.running_total(keyed, [label], "_key", ranks.by_hash(F.col("_key")), F.lit(1), "_before_it").drop("_key")
    sizes = rows.groupBy(label).agg(F.count("*").alias("_n"))
    part = F.when(F.col("_before_it") < F.floor(share * F.col("_n")), "train").otherwise("valid")
    return placed.join(sizes, label).withColumn("part", part).select(*rows.columns, "part")


def by_any_question(rows: DataFrame, *, share: float = 0.75, seed: int = 42) -> DataFrame:
    """The first ``share`` of all prompts in hash order train, known or not."""
    return by_question(rows.select("prompt_id").distinct().withColumn("is_known", F.lit(True)), share=share, seed=seed).select("prompt_id", "part")


def folds_by_size(rows: DataFrame, k: int = 5) -> DataFrame:
    """Prompts dealt to k folds by falling number of rows, ties by id, each to the lightest fold.

    Prompts of one size are dealt alike: unequal folds are levelled and then take turns.  So the driver needs the number
    of prompts of each size alone, and each prompt finds its fold by its place among those of its size.
    """
    prompts = rows.groupBy("prompt_id").agg(F.count("*").alias("size"))
    sizes = prompts.groupBy("size").agg(F.count("*").alias("m")).orderBy(F.desc("size")).collect()  # at most the largest prompt's rows
    loads, turns = [0] * k, []
    for r in sizes:
        first: list[int] = []
        while len(first) < r.m and max(loads) - min(loads) >= r.size:
            first.append(loads.index(min(loads)))
            loads[first[-1]] += r.size
        cycle = sorted(range(k), key=lambda i: (loads[i], i))
        left = r.m - len(first)
        for i, f in enumerate(cycle):
            loads[f] += r.size * (left // k + (i < left % k))
        turns.append((r.size, first, cycle))
    turn = rows.sparkSession.createDataFrame(turns, "size long, first array<int>, cycle array<int>")
    dealt, bin_ = ranks.by_range(prompts, "prompt_id")
    placed = ranks.running_total(dealt, ["size"], "prompt_id", bin_, F.lit(1), "place").join(F.broadcast(turn), "size")  # a row a size
    n = F.size("first")
    fold = F.when(F.col("place") < n, F.get("first", F.col("place").cast("int"))).otherwise(F.get("cycle", ((F.col("place") - n) % k).cast("int")))
    return placed.select("prompt_id", "size", fold.alias("fold"))


def folds(rows: DataFrame, k: int = 5, *, seed: int | None = None) -> DataFrame:
    """Prompts dealt to k folds in turn, in order of id or of hash."""
    prompts = rows.select("prompt_id").distinct()
    placed = ranks.value_rank(prompts, "prompt_id") if seed is None else ranks.hash_rank(prompts, hashed(seed, "prompt_id"))
    return placed.select("prompt_id", ((F.col("rank") - 1) % k).cast("int").alias("fold"))


def audit(split: DataFrame, prompts: DataFrame) -> DataFrame:
    """Rows and prompts of each side, prompts on both, and known prompts that straddle."""
    sides = split.groupBy("prompt_id").agg(F.sum((F.col("part") == "train").cast("int")).alias("t"), F.sum((F.col("part") == "valid").cast("int")).alias("v"))
    both = (F.col("t") > 0) & (F.col("v") > 0)
    return sides.join(prompts, "prompt_id").agg(
        F.sum("t").alias("train_rows"),
        F.sum("v").alias("valid_rows"),
        F.sum((F.col("t") > 0).cast("int")).alias("train_prompts"),
        F.sum((F.col("v") > 0).cast("int")).alias("valid_prompts"),
        F.sum(both.cast("int")).alias("both"),
        F.sum((both & F.col("is_known")).cast("int")).alias("known_both"),
        F.sum(((F.col("t") > 0) & ~F.col("is_known")).cast("int")).alias("unknown_in_train"),
    )


def subsample(rows: DataFrame, key: str, most: int, *, seed: int = 42) -> DataFrame:
    """``most`` rows at most, the first in hash order of the key; the limit is what is asked for."""
    return rows.orderBy(hashed(seed, key), key).limit(most)


def within_budget(sizes: DataFrame, key: str, size: str, budget: int, *, seed: int = 42) -> DataFrame:
    """Keys taken whole in hash order while their sizes fit a budget; one that overflows is passed over, save the very first.

    Each pass places all keys that could still fit and takes those up to the next overflow, so a pass ends with a smaller rest.
    """
    left, after, taken = budget, "", None
    keyed = sizes.select(key, F.col(size).alias("_size"), hashed(seed, key).alias("_hash"))
    while left > 0:
        fits = keyed.where((F.col("_hash") > after) & ((F.col("_size") <= left) if taken is not None else F.lit(True)))
        placed = ranks.running_total(fits, [], "_hash", ranks.by_hash(F.col("_hash")), F.col("_size"), "_past")
        over = placed.where(F.col("_past") + F.col("_size") > left).agg(F.min("_hash").alias("h")).first().h
        first = (F.col("_past") == 0) if taken is None else F.lit(False)
        some = placed.where((F.col("_past") + F.col("_size") <= left) & (F.col("_hash") < over if over else F.lit(True)) | first)
        used = some.agg(F.sum("_size").alias("n"), F.max("_hash").alias("h")).first()
        part = some.select(key, F.col("_size").alias(size))
        taken = part if taken is None else taken.union(part)
        left -= used.n or 0
        if over is None:
            break
        after = max(over, used.h or "")
    return taken if taken is not None else sizes.select(key, size).limit(0)
