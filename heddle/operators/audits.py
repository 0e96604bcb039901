"""Composition, agreement, alignment, integrity and length checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("int")).cast("long")


def composition(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts by kind, rows, opposite-label pairs and the share of positives."""
    each = rows.groupBy(*keys, "prompt_id").agg(F.sum("y").alias("h"), F.sum(1 - F.col("y")).alias("t"))
    return each.groupBy(*keys).agg(
        F.count("*").alias("n_prompts"),
        _n((F.col("h") > 0) & (F.col("t") > 0)).alias("n_mixed"),
        _n(F.col("h") == 0).alias("n_all_true"),
        _n(F.col("t") == 0).alias("n_all_false"),
        F.sum(F.col("h") * F.col("t")).alias("n_pairs"),
        (F.sum("h") / F.sum(F.col("h") + F.col("t"))).alias("rate"),
    )


def confusion(judged: DataFrame, a: str, b: str) -> DataFrame:
    """The four cells of two judgements and the share they agree on."""
    x, y = F.col(a), F.col(b)
    return judged.agg(_n(x & y).alias("both"), _n(x & ~y).alias("only_a"), _n(~x & y).alias("only_b"), _n(~x & ~y).alias("neither"), F.avg((x == y).cast("double")).alias("agreement"))


def status_flips(judged: DataFrame, a: str, b: str) -> DataFrame:
    """Prompts that either judge calls known (any true answer), and those whose status differs."""
    each = judged.groupBy("prompt_id").agg(F.bool_or(a).alias("x"), F.bool_or(b).alias("y"))
    x, y = F.col("x"), F.col("y")
    return each.agg(F.count("*").alias("n_prompts"), _n(x).alias("known_a"), _n(y).alias("known_b"), _n(x & ~y).alias("lost"), _n(~x & y).alias("gained"))


def alignment(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Rows matched by key, on one side alone, and matched with another label."""
    a, b = left.select(F.col(key).alias("k"), F.col(label).alias("x")), right.select(F.col(key).alias("k2"), F.col(label).alias("x2"))
    j = a.join(b, F.col("k") == F.col("k2"), "full")
    return j.agg(
        _n(F.col("k").isNotNull() & F.col("k2").isNotNull()).alias("matched"),
        _n(F.col("k2").isNull()).alias("left_only"),
        _n(F.col("k").isNull()).alias("right_only"),
        F.coalesce(_n(F.col("x") != F.col("x2")), F.lit(0)).alias("differing"),
    )


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left, right) of settings that differ or stand on one side alone."""
    left, right = a.select("key", F.col("value").alias("left")), b.select("key", F.col("value").alias("right"))
    return left.join(right, "key", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def integrity(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that are no number, infinite or zero, and rows that are all zero."""
    rows = cells.groupBy(*keys, "beam_id").agg(F.max(F.abs("v")).alias("most"), _n(F.isnan("v")).alias("nan"), _n(F.abs("v") == float("inf")).alias("inf"), _n(F.col("v") == 0).alias("zero"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum("nan").alias("n_nan"), F.sum("inf").alias("n_inf"), F.sum("zero").alias("n_zero"), _n(F.col("most") == 0).alias("n_empty"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """Completion lengths (population deviation) and how many break the canonical length."""
    n = F.col("n")
    return lengths.agg(
        F.count("*").alias("n_beams"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.percentile(n, 0.5).alias("median"), _n(n != F.col("canonical")).alias("violations"),
    )


def token_classes(tokens: DataFrame, lengths: DataFrame, stop: str, pads: list[str]) -> DataFrame:
    """Tokens by class: pad or end, stop, content within the window, and what follows the stop."""
    kind = (
        F.when(F.col("tok").isin(*pads), "eos_or_pad").when(F.col("tok") == stop, "custom_stop").when(F.col("pos") < F.col("canonical"), "content").otherwise("post_stop_extra")
    )
    return tokens.join(lengths.select("beam_id", "canonical"), "beam_id").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("pos").alias("mean_pos"))


def energy_gap(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Gap of mean layer norms between the classes, over the pooled sample deviation; null where undefined."""
    norms = cells.groupBy("beam_id", "y", "layer", *keys).agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    of = lambda k: F.when(F.col("y") == k, F.col("norm"))
    by = norms.groupBy("layer", *keys).agg(*[f(of(k)).alias(f"{n}{k}") for k in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp))])
    dev = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return by.select("layer", *keys, (F.col("m1") - F.col("m0")).alias("gap"), ((F.col("m1") - F.col("m0")) / F.when(dev > 0, dev)).alias("standard_gap"))


def peak_window(profile: DataFrame, layers: int, *, width: int = 3, gradient: bool = False) -> DataFrame:
    """The window of layers around the largest gap, or its largest rise, in the middle 70 % of the depth."""
    size = F.abs("gap")
    if gradient:
        size = size - F.lag(size).over(Window.orderBy("layer"))
    lo, hi = int(0.15 * layers), int(0.85 * layers)
    peak = profile.withColumn("size", size).where(F.col("layer").between(lo, hi) & F.col("size").isNotNull()).agg(F.max_by("layer", F.struct("size", -F.col("layer"))).alias("peak"))
    start = F.least(F.greatest(F.col("peak") - width // 2, F.lit(0)), F.lit(layers - width))
    return peak.select("peak", start.cast("int").alias("first"), (start + width - 1).cast("int").alias("last"))


def bandpass(cells: DataFrame, lo: float, hi: float) -> DataFrame:
    """Channels whose share of positive training values lies in a band."""
    return cells.groupBy("layer", "ch").agg(F.avg((F.col("v") > 0).cast("double")).alias("share")).where(F.col("share").between(lo, hi))


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def profile_shape(profile: DataFrame, value: str) -> DataFrame:
    """The top layer of a profile (layer, value) and its shape: flat where it spans under a thousandth, or under 2 % of its mean; falling or
    rising where the top stands first or last; peaked where it is above both ends.  Undetermined with a missing value."""
    v = F.col(value).cast("double")
    s = profile.agg(
        (F.max(v) - F.min(v)).alias("span"), F.avg(v).alias("mean"), F.max_by("layer", F.struct(v.alias("v"), (-F.col("layer")).alias("l"))).alias("peak"), F.max(v).alias("top"),
        F.min_by(v, "layer").alias("ini"), F.max_by(v, "layer").alias("fin"), F.min("layer").alias("lo"), F.max("layer").alias("hi"), F.bool_and(v.isNotNull() & ~F.isnan(v)).alias("whole"),
    )
    shape = (
        F.when(~F.col("whole"), "undetermined")
        .when((F.col("span") < 1e-3) | (F.col("span") < 0.02 * (F.abs("mean") + 1e-9)), "flat")
        .when(F.col("peak") == F.col("lo"), "falling")
        .when(F.col("peak") == F.col("hi"), "rising")
        .when((F.col("top") > F.col("ini")) & (F.col("top") > F.col("fin")), "peaked")
        .otherwise("mixed")
    )
    return s.select("peak", shape.alias("shape"))


def energy_gap_interval(cells: DataFrame, drawn: DataFrame) -> DataFrame:
    """By layer, mean and 95 % interval of the standardised gap over draws (rep, prompt_id, k) of prompts.

    Norms are summed by prompt first, so a draw weighs sums and rows are never repeated.
    """
    norms = cells.groupBy("beam_id", "prompt_id", "y", "layer").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("norm"))
    of = lambda k, x: F.sum(F.when(F.col("y") == k, x).otherwise(0.0))
    sums = norms.groupBy("prompt_id", "layer").agg(*[of(k, x).alias(f"{n}{k}") for k in (0, 1) for n, x in (("n", F.lit(1.0)), ("s", F.col("norm")), ("q", F.col("norm") ** 2))])
    each = drawn.join(sums, "prompt_id").groupBy("rep", "layer").agg(*[F.sum(F.col("k") * F.col(f"{n}{k}")).alias(f"{n}{k}") for k in (0, 1) for n in "nsq"])
    var = lambda k: (F.col(f"q{k}") - F.col(f"s{k}") ** 2 / F.col(f"n{k}")) / (F.col(f"n{k}") - 1)
    enough = each.where("n0 >= 2 and n1 >= 2").withColumn("dev", F.sqrt(F.greatest((var(0) + var(1)) / 2, F.lit(0.0)))).where("dev > 0")
    gap = enough.select("layer", ((F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")) / F.col("dev")).alias("gap"))
    return gap.groupBy("layer").agg(F.count("*").alias("n_reps"), F.avg("gap").alias("mean"), F.percentile("gap", 0.025).alias("lo"), F.percentile("gap", 0.975).alias("hi"))


def structure(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """Keys whose number of rows isn't the expected one."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def count_matches(one: DataFrame, two: DataFrame, key: str, count: str) -> DataFrame:
    """How many keys of both sides have equal counts, and their share."""
    both = one.select(key, F.col(count).alias("a")).join(two.select(key, F.col(count).alias("b")), key)
    equal = F.col("a") == F.col("b")
    return both.agg(F.count("*").alias("n"), _n(equal).alias("equal"), F.avg(equal.cast("double")).alias("share"))


def version_difference(cells: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Of two versions of the same cells: how many differ, by how much at most and on average, and their correlation."""
    d = F.abs(F.col(a) - F.col(b))
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), _n(d > 0).alias("differing"), F.max(d).alias("most"), F.avg(d).alias("mean"), F.corr(a, b).alias("corr"))


def asserted_count(rows: DataFrame, expected: int) -> DataFrame:
    """The rows; the query fails where there aren't as many as expected."""
    n = rows.agg(F.count("*").alias("_n"))
    checked = n.select(F.assert_true(F.col("_n") == expected, F.concat(F.lit(f"expected {expected} rows, found "), F.col("_n").cast("string"))).alias("_ok"))
    return rows.join(F.broadcast(checked)).where(F.col("_ok").isNull()).drop("_ok")  # one row


def asserted_each(rows: DataFrame, key: str, expected: int, *, open_end: bool = False) -> DataFrame:
    """The rows; the query fails where a key hasn't as many as expected.  With ``open_end`` the last key may have fewer, as a table may end inside its rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    found = F.concat(F.lit(f"expected {expected} rows of each {key}, found "), F.col("_n").cast("string"), F.lit(" of "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    short = F.lit(False)
    if open_end:
        n = n.join(F.broadcast(rows.agg(F.max(key).alias("_last"))))  # one row
        short = F.coalesce(F.col(key) == F.col("_last"), F.lit(False)) & (F.col("_n") < expected)
    wrong = n.select(F.when((F.col("_n") != expected) & ~short, found).alias("_said")).agg(F.min("_said").alias("_said"))
    checked = wrong.select(F.when(F.col("_said").isNotNull(), F.raise_error(F.col("_said")).cast("boolean")).otherwise(True).alias("_ok"))
    return rows.join(F.broadcast(checked)).where("_ok").drop("_ok")  # one row
