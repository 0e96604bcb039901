"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, discard, stored

#: Edges that a task joins on its own; more take rounds over all tasks.
LOCAL = 200_000


def _stars(edges: DataFrame, local: int) -> DataFrame:
    """Edges (u, v) from each node to the smallest one of its component among ``local`` edges of its task."""
    schema = ddl("u long, v long")

    def task(batches):
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        for b in batches:
            for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p, q = top(u), top(v)
                if p != q:
                    above[max(p, q)] = min(p, q)
                if len(above) >= local:
                    yield batch_of([(x, top(x)) for x in above], schema)
                    above.clear()
        yield batch_of([(x, top(x)) for x in above], schema)

    return edges.mapInArrow(task, schema)


def components(edges: DataFrame, *, most_rounds: int = 50, local: int = LOCAL) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's smallest node.

    Tasks replace up to ``local`` edges by stars; where no more are left, one task joins these.  Else follow
    alternating large-star and small-star rounds; each is stored, so lineage stays short, and the
    number of rounds grows with the logarithm of the components' size.  Minima are taken before the
    joins, so a node with many neighbours is met by a join that Spark can split.
    """
    seen = None
    e = stored(_stars(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), local), name="edges")
    if e.count() <= local:
        last, e = e, stored(_stars(e.coalesce(1), local + 1), name="edges")
        discard(last)
        return _rooted(e)
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name="edges")
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return _rooted(e)


def _rooted(e: DataFrame) -> DataFrame:
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
