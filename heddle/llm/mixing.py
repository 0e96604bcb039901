"""Mixing of sources to target weights by Sainte-Laguë apportionment.

Blocks of equal numbers of words are dealt to the sources by highest quotients.  A source's documents lie in shards by a
seeded hash, and its words are dealt to its shards in the same way, which gives each an integer quota.  Inside a shard the documents stand
in seeded order and are cut into blocks; whole passes take them all, and what the quota has beyond these is taken from blocks in
the order of a seeded hash, the last one as far as the quota goes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import ranks
from heddle.llm.common import ddl, discard, stored

WORDS = r"[^\x20\x09-\x0D]+"
#: The sources' weights in order, again and again.
WEIGHTS = (1, 2, 3)
#: A source's words are taken so many times at most.
MOST = 3
BLOCK = 64
#: Thresholds that one pass over the sources tries, quotients that the last pass may put in order, and passes at most.
STEPS, LAST, PASSES = 64, 10_000, 12
#: Sources by which the others are binned to number them.
EDGES = 255


def highest(weights: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë seats of each weight, ``most`` at most; equal quotients go to the first.  ``seats`` is no more than all of ``most``."""
    most = np.where(weights > 0, most, 0)
    if not seats:
        return np.zeros(len(weights), np.int64)
    count = lambda cut: np.minimum(most, np.floor((weights / cut + 1) / 2)).astype(np.int64)
    some = most > 0
    low, high = float((weights[some] / (2.0 * most[some])).min()), 2.0 * float(weights.max())
    for _ in range(200):
        mid = (low * high) ** 0.5
        if not low < mid < high:
            break
        low, high = (mid, high) if count(mid).sum() >= seats else (low, mid)
    found = count(high)
    spare = count(low) - found
    who = np.repeat(np.arange(len(weights)), spare)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(spare) - spare, spare) + found[who]
    order = np.lexsort((who, -(weights[who] / (2.0 * nth + 1))))[: seats - found.sum()]
    return found + np.bincount(who[order], minlength=len(weights))


def apportioned(rows: DataFrame, seats: int) -> DataFrame:
    """Adds ``seats`` to distributed rows (place, weight, most): Sainte-Laguë, ``most`` at most, equal quotients by place.

    ``seats`` is no more than all of ``most``.  Passes over the rows narrow the least quotient that gets a seat; the few quotients
    between the last bounds are put in order.
    """
    weight, most = F.col("weight"), F.when(F.col("weight") > 0, F.col("most")).otherwise(0)
    count = lambda cut: F.least(most, F.floor((weight / F.lit(cut) + 1) / 2)).cast("long")
    edge = rows.where((weight > 0) & (most > 0)).agg(F.min(weight / (2.0 * most)), F.max(weight)).first()
    if not seats or edge[0] is None:
        return rows.withColumn("seats", F.lit(0).cast("long"))
    low, high, between = edge[0], 2.0 * edge[1], None
    for _ in range(PASSES):
        if between is not None and between <= LAST:
            break
        cuts = [low * (high / low) ** (i / STEPS) for i in range(STEPS)] + [high]
        got = list(rows.agg(*[F.sum(count(c)) for c in cuts]).first())
        at = max([i for i, n in enumerate(got) if n >= seats], default=0)
        low, high, between = cuts[at], cuts[min(at + 1, STEPS)], got[at] - got[min(at + 1, STEPS)]
    base, top = count(high), count(low)
    left = seats - rows.agg(F.sum(base)).first()[0]
    spare = rows.where(top > base).select("place", weight.alias("weight"), F.explode(F.sequence(base, top - 1)).alias("nth"))
    spare = spare.select("place", (-F.col("weight") / (2.0 * F.col("nth") + 1)).alias("less"))
    spare, bin_ = ranks.by_range(spare, "less")
    extra = ranks.running_total(spare, [], F.struct("less", "place"), bin_, F.lit(1), "before").where(F.col("before") < left)
    extra = extra.groupBy("place").agg(F.count("*").alias("more"))
    return rows.join(extra, "place", "left").withColumn("seats", base + F.coalesce("more", F.lit(0))).drop("more")


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``: the number of a distinct ``source`` in code-point order from 0, null last."""
    some = sources.where("source IS NOT NULL").orderBy(F.xxhash64("source")).limit(EDGES).collect()
    edges = F.array(*[F.lit(r["source"]) for r in some]).cast("array<string>")
    bin_ = F.when(F.col("source").isNull(), EDGES + 1).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("source"))))
    return ranks.running_total(sources, [], F.col("source").asc_nulls_last(), bin_, F.lit(1), "place")


def targeted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, words, place, weight, cap, target) of distinct sources with their words.

    All words are shared by weight; what would exceed ``most`` times a source's words is shared among the others until none is above.
    """
    rows = numbered(sources).withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("place") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("words"))
    rows = stored(rows, name="sources")
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < level * F.col("weight")
        t = rows.agg(F.sum("words"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if not t[0] or t[2] is None or t[3] == capped:
            break
        level, capped = (t[0] - t[1]) / t[2], t[3]
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight")))


def _keys(source: Column) -> list[Column]:
    return [F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("none")]


def _quotas(shards: DataFrame, most: int) -> DataFrame:
    """Deals each source's ``take`` to its shards: (name, none, shard, all, quota).  A source has 4,096 shards at most."""
    schema = ddl("name string, none boolean, shard string, quota long")

    def dealt(pdf):
        pdf = pdf.sort_values("shard")
        words = pdf["all"].to_numpy()
        return pdf.assign(quota=highest(words.astype(float), most * words, int(pdf["take"].iloc[0])))[["name", "none", "shard", "quota"]]

    return shards.groupBy("name", "none").applyInPandas(dealt, schema)


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = "0"
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words of each document that the mix takes, repeats counted.

    A source takes whole blocks, so its words are within about half a block of its target.  Null and empty texts have size 0 and
    are never taken, a null source is a source, null ids and repeated rows are documents of their own, and very long texts are cut
    into blocks like others.  Other columns are left out.  An empty table gives no rows.  Reruns agree on any layout; of equal
    rows it is open which one takes what.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.hex(F.xxhash64(text_col))))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), key.alias("key"))
    sized = stored(sized.withColumn("shard", F.substring("key", 1, 3)), name="sizes")
    shards = stored(sized.groupBy("source", "shard").agg(F.sum("size").alias("all")), name="shards")
    sources = targeted(shards.groupBy("source").agg(F.sum("all").alias("words")), weights, most)
    total = sources.agg(F.sum("words")).first()[0] or 0
    blocks = sources.select("place", F.col("target").alias("weight"), F.ceil(F.col("cap") / block).alias("most"))
    seats = apportioned(blocks, round(total / block)).select("place", "seats")
    taking = sources.join(seats, "place").withColumn("take", F.least(F.col("seats") * block, "cap"))
    taking = stored(taking.select(*_keys(F.col("source")), F.col("words").alias("source_size"), "target", "take"), name="taking")
    parts = shards.select(*_keys(F.col("source")), "shard", "all").join(taking, ["name", "none"])
    quotas = parts.join(_quotas(parts.where("all > 0").select("name", "none", "shard", "all", "take"), most), ["name", "none", "shard"], "left")
    quotas = stored(quotas.withColumn("quota", F.coalesce("quota", F.lit(0))).drop("take"), name="quotas")
    out = _taken(sized, quotas, block, seed)
    discard(shards)
    return out


def _taken(sized: DataFrame, quotas: DataFrame, block: int, seed: str) -> DataFrame:
    shard = Window.partitionBy("name", "none", "shard")
    before = Window.unboundedPreceding, -1
    rows = sized.select("doc_id", *_keys(F.col("source")), "shard", "size", "key").join(quotas, ["name", "none", "shard"])
    rows = rows.withColumn("nth", F.row_number().over(shard.orderBy("key", "size", "doc_id")))
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(shard.orderBy("nth").rowsBetween(*before)), F.lit(0)))
    cut = lambda x: F.floor(x / block).cast("long")
    ends = F.when(F.col("size") > 0, F.sequence(cut(F.col("start")), cut(F.col("start") + F.col("size") - 1)))
    pieces = rows.withColumn("block", F.explode_outer(ends))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.withColumn("words", F.coalesce(hi - lo, F.lit(0)))
    order = F.xxhash64(F.lit(seed), "name", "shard", "block"), F.col("block"), F.col("nth")
    past = F.coalesce(F.sum("words").over(shard.orderBy(*order).rowsBetween(*before)), F.lit(0))
    rest = F.when(F.col("all") > 0, F.col("quota") % F.col("all")).otherwise(0)
    pieces = pieces.withColumn("part", F.greatest(F.lit(0), F.least(rest - past, "words")))
    found = pieces.groupBy("name", "none", "shard", "nth").agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target", "quota", "all")], F.sum("part").alias("part"))
    whole = F.when(F.col("all") > 0, F.floor(F.col("quota") / F.col("all")) * F.col("size")).otherwise(0)
    return found.select("doc_id", F.when(~F.col("none"), F.col("name")).alias("source"), "size", "source_size", "target", (whole + F.col("part")).cast("long").alias("taken"))
