"""Ranking quality from counts per distinct score, and its cluster bootstrap.

Scores are first counted by value, so the work after is on distinct scores.  A prompt's multiplicities in all bootstrap draws are one
array; counts are put in order once, inside bins of scores, and added up array by array.  What meets in the end is
an array for each bin, as wide as there are draws; rows are never repeated.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import ranks, sums
from heddle.sources.scratch import stored

#: Rows whose draws a task holds at once, and groups that rows of one score are split into.
AT_ONCE, SPLIT = 500, 64


def _auroc(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Numerator and denominator from n1 and n0 by (keys, score), where the keys have few scores."""
    below = F.coalesce(F.sum("n0").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = counts.withColumn("won", F.col("n1") * (below + F.col("n0") / 2))
    return parts.groupBy(*keys).agg(F.sum("won").alias("won"), (F.sum("n1") * F.sum("n0")).alias("pairs"))


def _by_score(rows: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return rows.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("n1"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("n0"))


def auroc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Chance that a positive outscores a negative, ties half; null where a class is missing."""
    parts = _pooled(_by_score(rows, keys), keys)
    return parts.select(*keys, (F.col("won") / F.when(F.col("pairs") > 0, F.col("pairs"))).alias("auroc"))


def _pooled(counts: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_auroc``, for keys with any number of scores."""
    counts, bin_ = ranks.by_range(counts, "score")
    placed = ranks.running_total(counts, keys, "score", bin_, F.col("n0"), "below")
    return placed.groupBy(*keys).agg(F.sum(F.col("n1") * (F.col("below") + F.col("n0") / 2)).alias("won"), (F.sum("n1") * F.sum("n0")).alias("pairs"))


def within_prompt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same over pairs of one prompt, pooled; with the number of pairs and of mixed prompts."""
    each = _auroc(_by_score(rows, [*keys, "prompt_id"]), [*keys, "prompt_id"]).where("pairs > 0")
    return each.groupBy(*keys).agg((F.sum("won") / F.sum("pairs")).alias("auroc"), F.sum("pairs").cast("long").alias("n_pairs"), F.count("*").alias("n_mixed"))


def _parts(rows: DataFrame) -> int:
    """Spark's own number of parts of a shuffle, given where small parts would be joined before they grow."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _slots(prompts: DataFrame, reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Prompts by number (i, prompt_id), and the number that each slot of each draw (rep) gets by hash.  Slots are dealt over tasks
    before they grow by the draws, as prompts alone are so small that Spark leaves them all in one."""
    listed = ranks.value_rank(prompts.select("prompt_id").distinct(), "prompt_id").select("prompt_id", (F.col("rank") - 1).alias("i"))
    size = listed.agg(F.count("*").alias("size"))
    slots = listed.select(F.col("i").alias("slot")).repartition(_parts(listed), "slot").join(F.broadcast(size)).select(F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), "slot", "size")
    text = F.concat_ws(":", F.lit(seed), F.col("rep"), F.col("slot"))
    return listed, slots.select("rep", (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % F.col("size")).alias("i"))


def draws(prompts: DataFrame, reps: int, seed: int) -> DataFrame:
    """(rep, prompt_id, k): how often a prompt is drawn when as many as there are get drawn by hash with replacement."""
    listed, drawn = _slots(prompts, reps, seed)
    drawn = drawn.repartition(_parts(drawn), "i")  # almost every slot is a key of its own, so nothing is gained by counting before
    return drawn.groupBy("rep", "i").agg(F.count("*").alias("k")).join(listed, "i").select("rep", "prompt_id", "k")


def _drawn(prompts: DataFrame, reps: int, seed: int) -> DataFrame:
    """(prompt_id, k): ``draws`` with a prompt's counts in all draws as one binary of 16-bit numbers.  Stored."""
    listed, slots = _slots(prompts, reps, seed)

    @F.pandas_udf("binary")
    def counts(found):
        return found.map(lambda r: np.bincount(np.asarray([] if r is None else r, int), minlength=reps).astype("<u2").tobytes())

    each = slots.groupBy("i").agg(F.collect_list("rep").alias("reps"))  # about a number a draw
    return stored(listed.join(each, "i", "left").select("prompt_id", counts("reps").alias("k")), name="draws")


def _counts(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<u2") for b in column]).astype(float)


def _in_bins(placed: DataFrame, reps: int) -> DataFrame:
    """(bin, n1, n0, won): for each draw the positives and negatives of a bin's rows (bin, split, score, n1, n0, k), and the pairs won inside it."""
    schema = "bin int, n1 binary, n0 binary, won binary"

    def task(frames):
        import pandas as pd

        key, total, last = None, None, None  # the bin at hand, its sums, and its last score with that score's sums

        def closed():
            return (key[0], *(v.tobytes() for v in total))

        def take(s1, s0):
            """Adds whole scores in order."""
            below = np.cumsum(s0, 0) - s0 + total[1]
            total[2] += (s1 * (below + s0 / 2)).sum(0)
            total[0] += s1.sum(0)
            total[1] += s0.sum(0)

        for f in frames:
            out = []
            for at in range(0, len(f), AT_ONCE):
                part = f.iloc[at : at + AT_ONCE]
                k, names = _counts(part["k"]), list(zip(part["bin"].tolist(), part["split"].tolist(), part["score"].tolist(), strict=True))
                first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
                s1, s0 = (np.add.reduceat(part[c].to_numpy()[:, None] * k, first, axis=0) for c in ("n1", "n0"))
                names = [names[i] for i in first]
                if last is not None:
                    if last[0] == names[0]:
                        s1[0] += last[1]
                        s0[0] += last[2]
                    else:
                        names, s1, s0 = [last[0], *names], np.concatenate([last[1][None], s1]), np.concatenate([last[2][None], s0])
                last = names[-1], s1[-1], s0[-1]
                i = 0
                while i < len(names) - 1:
                    j = i
                    while j < len(names) - 1 and names[j][:2] == names[i][:2]:
                        j += 1
                    if names[i][:2] != key:
                        out += [closed()] if key is not None else []
                        key, total = names[i][:2], [np.zeros(reps) for _ in range(3)]
                    take(s1[i:j], s0[i:j])
                    i = j
            yield pd.DataFrame(out, columns=["bin", "n1", "n0", "won"])
        if last is not None:
            out = []
            if last[0][:2] != key:
                out += [closed()] if key is not None else []
                key, total = last[0][:2], [np.zeros(reps) for _ in range(3)]
            take(last[1][None], last[2][None])
            yield pd.DataFrame([*out, closed()], columns=["bin", "n1", "n0", "won"])

    return placed.repartition("bin", "split").sortWithinPartitions("bin", "split", "score").mapInPandas(task, schema)


def _over_bins(bins: DataFrame, reps: int) -> DataFrame:
    """(rep, auroc) from the sums of bins; a bin of one score is the sum of its splits, half of whose pairs count."""

    parts = ["n1", "n0", "won"]

    def splits(f):
        import pandas as pd

        return pd.DataFrame([(f["bin"].iloc[0], *(np.sum([np.frombuffer(b) for b in f[c]], axis=0).tobytes() for c in parts))], columns=["bin", *parts])

    def task(f):
        import pandas as pd

        won, pairs, below, ones = (np.zeros(reps) for _ in range(4))
        for row in f.sort_values("bin").itertuples():
            bin_, (n1, n0, inside) = row.bin, (np.frombuffer(getattr(row, c)) for c in parts)
            won += n1 * below + (n1 * n0 / 2 if bin_ % 2 else inside)
            below += n0
            ones += n1
        pairs = ones * below
        some = np.flatnonzero(pairs > 0)
        return pd.DataFrame({"rep": some, "auroc": won[some] / pairs[some]})

    whole = bins.groupBy("bin").applyInPandas(splits, bins.schema)  # a bin has ``SPLIT`` rows at most
    return whole.groupBy().applyInPandas(task, "rep int, auroc double")  # a row for each of about 2,048 bins


def _replicates(rows: DataFrame, drawn: DataFrame, within: bool, reps: int) -> DataFrame:
    """(rep, auroc) of the draws that have both classes; null scores take no part."""
    if not within:
        counts = ranks.by_range_or_value(_by_score(rows.where("score IS NOT NULL"), ["prompt_id"]), "score")
        split = F.when(F.col("bin") % 2 == 1, F.pmod(F.xxhash64("prompt_id"), F.lit(SPLIT))).otherwise(0)
        return _over_bins(_in_bins(counts.join(drawn, "prompt_id").select("bin", split.cast("int").alias("split"), "score", "n1", "n0", "k"), reps), reps)
    each = _auroc(_by_score(rows, ["prompt_id"]), ["prompt_id"]).where("pairs > 0").join(drawn, "prompt_id").select("won", "pairs", "k")

    def part(f):
        total = np.zeros((2, reps))
        for at in range(0, len(f), AT_ONCE):
            some = f.iloc[at : at + AT_ONCE]
            total += some[["won", "pairs"]].to_numpy(float).T @ _counts(some["k"]) ** 2  # a prompt drawn k times pairs all its copies
        return total

    won, pairs = sums.added(each, 2 * reps, part).reshape(2, reps)
    return rows.sparkSession.createDataFrame([(i, float(won[i] / pairs[i])) for i in range(reps) if pairs[i] > 0], "rep int, auroc double")


def bootstrap(rows: DataFrame, *, reps: int = 1000, seed: int = 42, within: bool = False) -> DataFrame:
    """Mean and 95 % interval over draws of prompts; draws with one class are left out."""
    return interval(rows, _drawn(rows, reps, seed), reps=reps, within=within)


def interval(rows: DataFrame, drawn: DataFrame, *, reps: int = 1000, within: bool = False) -> DataFrame:
    """``bootstrap`` on draws of the same prompts that were made before, by ``_drawn``."""
    r = _replicates(rows, drawn, within, reps)
    return r.agg(F.count("*").alias("n_reps"), F.avg("auroc").alias("mean"), F.percentile("auroc", 0.025).alias("lo"), F.percentile("auroc", 0.975).alias("hi"))


def paired_delta(rows: DataFrame, a: str, b: str, *, reps: int = 1000, seed: int = 42, within: bool = False) -> DataFrame:
    """Difference of two scores' quality on the same draws, and whether its interval leaves out zero."""
    return paired_deltas(rows, [(a, b)], [within], reps=reps, seed=seed).drop("condition", "baseline", "metric")


def paired_deltas(rows: DataFrame, pairs: list[tuple[str, str]], within: list[bool], *, reps: int = 1000, seed: int = 42) -> DataFrame:
    """``paired_delta`` of several pairs, with condition, baseline and metric (pooled, within).  Prompts are drawn once, and a score that is in several pairs is measured once."""
    names = sorted({c for p in pairs for c in p})
    rows = stored(rows.select("prompt_id", "y", *names), name="scores")
    held = _drawn(rows, reps, seed)
    found = {}
    for c in names:
        for w in within:
            quality = _replicates(rows.select("prompt_id", "y", F.col(c).alias("score")), held, w, reps)
            found[c, w] = quality if len(pairs) == 1 else stored(quality, name="replicates")
    out = []
    for a, b in pairs:
        for w in within:
            d = found[a, w].join(found[b, w].withColumnRenamed("auroc", "second"), "rep").select((F.col("auroc") - F.col("second")).alias("d"))
            d = d.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"))
            d = d.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))
            out.append(d.select(F.lit(a).alias("condition"), F.lit(b).alias("baseline"), F.lit("within" if w else "pooled").alias("metric"), *d.columns))
    return reduce(DataFrame.unionByName, out)


def paired_delta_over_repeats(rows: DataFrame, a: str, b: str, *, reps: int = 1000, seed: int = 42, within: bool = False) -> DataFrame:
    """``paired_delta`` of scores from several repeats (a, b and repeat): every repeat's scores stand side by side in one
    bootstrap, so an answer counts once for each repeat."""
    return paired_delta(rows.drop("repeat"), a, b, reps=reps, seed=seed, within=within)
