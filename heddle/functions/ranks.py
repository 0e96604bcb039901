"""Places and running totals in a total order, without bringing all rows to one task.

Rows fall into bins that follow the order.  Each bin is summed on its own, at most 4,096 bin totals are
added up in one task, and a row's total is its bin's plus what stands before it in the bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Three hexadecimal digits of a hash, or the square of so many steps between quantiles.
STEPS = 32
#: Bins by which exact quantiles are found.
CUTS = 64
#: Values of a key that one task may hold.
AT_ONCE = 1_000_000


def by_hash(key: Column) -> Column:
    """The bin of a hexadecimal hash; the bins are of like size."""
    return F.substring(key, 1, 3)


def _edged(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``_by``, how many approximate quantiles lie below the column's value, and ``_edge``, whether it is the next one."""
    grid = [i / STEPS**2 for i in range(1, STEPS**2)]
    value = F.col(column).cast("double")
    edges = rows.agg(F.percentile_approx(value, grid, 10_000).alias("_edges"))
    edges = edges.withColumn("_coarse", F.transform(F.sequence(F.lit(1), F.lit(STEPS - 1)), lambda i: F.element_at("_edges", i * STEPS)))
    below = lambda cut: F.size(F.filter(cut, lambda e: e < value))
    coarse = below(F.col("_coarse"))
    bin_ = coarse * STEPS + below(F.slice("_edges", coarse * STEPS + 1, F.lit(STEPS - 1)))
    held = rows.join(F.broadcast(edges)).withColumn("_by", bin_)  # one row of edges
    return held.select(*rows.columns, "_by", F.coalesce(F.get("_edges", F.col("_by").cast("int")) == value, F.lit(False)).alias("_edge"))


def by_range(rows: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """The rows with a bin of the column's value, and that bin.  Bins lie between approximate quantiles, so they are of like size
    whatever the values; a value has one bin."""
    return _edged(rows, column).drop("_edge"), F.col("_by")


def by_range_or_value(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``bin``, in the values' order: odd bins have a single value each, as every frequent one has, and the even ones
    between them are of like size."""
    found = _edged(rows, column)
    return found.withColumn("bin", 2 * F.col("_by") + F.col("_edge").cast("int")).drop("_by", "_edge")


def quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles of a value, between neighbours by line: one row for each value of the keys.

    Keys of ``AT_ONCE`` rows at most are ordered in one buffer each.  If a key has more, distinct values are counted and dealt
    by approximate quantiles into bins, and only the bins that hold a wanted place are put in order, so no task holds all
    values of a key; the results are the same.  Null values count for nothing.
    """
    largest = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    if largest <= AT_ONCE:
        return rows.where(value.isNotNull()).groupBy(*keys).agg(*[F.percentile(value.cast("double"), p).alias(n) for n, p in shares.items()])
    return _binned_quantiles(rows, keys, value, shares)


def _binned_quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    counts = rows.where(value.isNotNull()).groupBy(*keys, value.cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    edges = counts.groupBy(*keys).agg(F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], 1_000).alias("_edges"), F.sum("_n").alias("_all"))
    dealt = counts.join(edges, keys).withColumn("_bin", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    sizes = dealt.groupBy(*keys, "_bin", "_all").agg(F.sum("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = {n: (F.col("_all") - 1) * p for n, p in shares.items()}
    holds = lambda at, lo, size: (at >= lo) & (at < lo + size)
    wanted = F.lit(False)
    for at in place.values():
        wanted = wanted | holds(F.floor(at), F.col("_before"), F.col("_size")) | holds(F.ceil(at), F.col("_before"), F.col("_size"))
    kept = sizes.withColumn("_before", before).where(wanted).drop("_size", "_all")
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    found = dealt.join(kept, [*keys, "_bin"]).withColumn("_from", F.col("_before") + inside - F.col("_n"))
    ends = [F.max(F.when(holds(f(at), F.col("_from"), F.col("_n")), F.col("_v"))).alias(f"{n}_{side}") for n, at in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    out = found.groupBy(*keys).agg(F.max("_all").alias("_all"), *ends)
    line = lambda n, at: (F.col(f"{n}_lo") + (at - F.floor(at)) * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))).alias(n)
    return out.select(*keys, *[line(n, at) for n, at in place.items()])


def running_total(rows: DataFrame, keys: list[str], order: Column | str, bin_: Column, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same keys that stand before; 0 for the first."""
    dealt = rows.withColumn("_bin", bin_).withColumn("_value", value)
    sizes = dealt.groupBy(*keys, "_bin").agg(F.sum("_value").alias("_size"))
    past = Window.unboundedPreceding, -1
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(*past))
    inside = F.sum("_value").over(Window.partitionBy(*keys, "_bin").orderBy(order).rowsBetween(*past))
    placed = dealt.withColumn("_inside", inside).join(sizes.withColumn("_before", before).drop("_size"), [*keys, "_bin"])
    return placed.withColumn(name, F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))).drop("_bin", "_value", "_inside", "_before", "_by")


def hash_rank(rows: DataFrame, key: Column, name: str = "rank") -> DataFrame:
    """Adds ``name``: the place, from 1, in the order of a hexadecimal hash."""
    return running_total(rows.withColumn("_key", key), [], "_key", by_hash(F.col("_key")), F.lit(1), name).withColumn(name, F.col(name) + 1).drop("_key")


def value_rank(rows: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Adds ``name``: the place, from 1, in the order of a numeric column."""
    rows, bin_ = by_range(rows, column)
    return running_total(rows, [], column, bin_, F.lit(1), name).withColumn(name, F.col(name) + 1)
