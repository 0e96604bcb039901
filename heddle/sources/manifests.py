"""Manifests of tables as hash trees over ranges of keys.

A row has the hash of its columns.  A leaf, a range of integer keys, has the hash of its rows' hashes in order, with how often
each occurs, so any change of a row changes it; a node has the hash of its children's.  Two versions of a table are compared from the
root down along the nodes that differ, which names the ranges of keys that changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.sources.scratch import stored

#: Keys of a leaf, children of a node, and leaves that rows without a key are dealt to by hash.
SPAN, FAN, KEYLESS = 1024, 16, 1024


def row_hash(columns: list[str]) -> Column:
    """Of the columns' texts, each with its length before it, so no two rows look alike; null isn't the empty text."""
    text = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(",", *text), 256)


def _node(of: str, items: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(items))), 256).alias(of)


def tree(rows: DataFrame, key: str, columns: list[str], *, span: int = SPAN, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """(level, node, n, digest) of a table with an integer key; level 0 has the leaves, the last level one root.  Stored.

    A leaf's distinct rows meet in one task, a stated number of keys; equal rows are counted before.  Rows without a key lie in leaves below
    zero.  An empty table has no nodes.  ``levels`` is found by the range of keys, if it isn't given.
    """
    h = row_hash([key, *columns])
    leaf = F.coalesce(F.floor(F.col(key) / span), -1 - F.pmod(F.xxhash64(h), F.lit(KEYLESS))).cast("long")
    leaf = F.when(F.col(key) < 0, F.floor(F.col(key) / span) - KEYLESS).otherwise(leaf).cast("long")
    counted = rows.select(leaf.alias("node"), h.alias("h")).groupBy("node", "h").agg(F.count("*").alias("c"))
    now = stored(counted.groupBy("node").agg(F.sum("c").alias("n"), _node("digest", F.concat("h", F.lit("x"), F.col("c").cast("string")))), name="leaves")
    parts = [now.withColumn("level", F.lit(0))]
    if levels is None:
        edge = now.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
        levels, a, b = 0, edge.a or 0, edge.b or 0
        while (a, b) != (0, 0) and (a, b) != (-1, -1) and (a, b) != (-1, 0):
            a, b, levels = a // fan, b // fan, levels + 1
        levels += 1
    for level in range(1, levels + 1):
        above = F.floor(F.col("node") / fan).cast("long") if level < levels else F.lit(0).cast("long")
        item = F.concat(F.col("node").cast("string"), F.lit(":"), "digest")
        now = now.groupBy(above.alias("node")).agg(F.sum("n").alias("n"), _node("digest", item))
        parts.append(now.withColumn("level", F.lit(level)))
    return stored(reduce(DataFrame.unionByName, parts).select("level", "node", "n", "digest"), name="manifest")


def difference(one: DataFrame, two: DataFrame, *, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(first_key, last_key, n_one, n_two): the leaves that differ between two trees of as many levels; keys are null for rows without one.

    Goes down a level a step, along differing nodes alone.
    """
    top = one.agg(F.max("level").alias("t")).union(two.agg(F.max("level").alias("t"))).agg(F.max("t")).first()[0]
    spark = one.sparkSession
    if top is None:
        return spark.createDataFrame([], "first_key long, last_key long, n_one long, n_two long")
    a, b = (t.select("level", "node", F.col("n").alias(f"n_{name}"), F.col("digest").alias(f"d_{name}")) for t, name in ((one, "one"), (two, "two")))
    changed = None
    for level in range(top, -1, -1):
        both = [t.where(F.col("level") == level).drop("level") for t in (a, b)]
        if changed is not None:
            above = F.floor(F.col("node") / fan).cast("long") if level + 1 < top else F.lit(0).cast("long")
            both = [t.join(changed.select(F.col("node").alias("_above")), above == F.col("_above"), "left_semi") for t in both]
        found = both[0].join(both[1], "node", "full").where(~F.col("d_one").eqNullSafe(F.col("d_two")))
        changed = stored(found.select("node", "n_one", "n_two"), name="changed")
    low = F.when(F.col("node") >= 0, F.col("node")).when(F.col("node") < -KEYLESS, F.col("node") + KEYLESS)
    return changed.select((low * span).alias("first_key"), (low * span + span - 1).alias("last_key"), F.coalesce("n_one", F.lit(0)).alias("n_one"), F.coalesce("n_two", F.lit(0)).alias("n_two"))


def verified(manifest: DataFrame, rows: DataFrame, key: str, columns: list[str], *, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """The rows; fails, and names ranges of keys, where they aren't those of the manifest."""
    levels = manifest.agg(F.max("level")).first()[0]
    wrong = difference(manifest, tree(rows, key, columns, span=span, fan=fan, levels=levels), span=span, fan=fan)
    some = wrong.orderBy("first_key").limit(5).collect()
    if some:
        ranges = ", ".join("rows without a key" if r.first_key is None else f"{r.first_key} to {r.last_key}" for r in some)
        raise ValueError(f"the table isn't the manifest's: {wrong.count()} ranges of keys differ, among them {ranges}")
    return rows
