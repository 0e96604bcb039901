"""Exact top-k search by inner product as a Voronoi join.

Data and queries are grouped by their nearest pivots, and the members of a pivot by their distances from it into
rings.  A group, which is a ring of a pivot, is summed up by its radius; by Cauchy and Schwarz no member scores more than q·p + |q|·radius.  A query is first
solved in the group that looks best to it, which gives a score to beat, and then goes only to those
groups whose bound reaches it.  Groups are cut into blocks and laid, next to each other, into parts of bounded size; a query travels
once to a part, with the list of the groups that it must meet there, and leaves it with k results.
Of equal vectors only the k + 1 smallest ids can matter, so no more travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, stored

SCALE = 256
#: Pivots grow with the square root of the table between these bounds, so what is broadcast stays bounded.
LEAST_PIVOTS, MOST_PIVOTS = 128, 16_384
RINGS = 4
#: Vectors of a block of a group, and of a part, which a task holds.
BLOCK, PART = 4096, 16_384
#: Numbers of a matrix of vectors or queries by groups at most, and queries solved at once.
CELLS, AT_ONCE = 4_000_000, 256


def _bytes(v: np.ndarray) -> bytes:
    """Whole numbers as 32-bit or 64-bit integers where they fit, else as the floats that they are; a leading byte tells."""
    largest = np.abs(v).max(initial=0)
    if largest < 2**31:
        return b"4" + v.astype("<i4").tobytes()
    return b"8" + v.astype("<i8").tobytes() if largest < 2**62 else b"f" + v.astype("<f8").tobytes()


_TYPES = {b"4": "<i4", b"8": "<i8", b"f": "<f8"}


def _matrix(vectors: list[bytes], width: int = 0) -> np.ndarray:
    """Vectors as rows, shorter ones ended with zeros; of Python's integers where one doesn't fit 64 bits."""
    rows = [np.frombuffer(b, _TYPES[b[:1]], offset=1) for b in vectors]
    wide = any(b[:1] == b"f" for b in vectors)
    out = np.zeros((len(rows), max([width, *map(len, rows)])), object if wide else np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = [int(x) for x in r.tolist()] if wide else r
    return out


def _dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, the nearest long where one isn't a long; by floating point where that is exact."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (q, x))
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, width)
    if largest < 2**53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return np.clip(q.astype(object) @ x.T.astype(object), 1 - (1 << 63), (1 << 63) - 1).astype(np.int64)


def quantised(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component, without vectors that hold null or no finite number."""
    schema = ddl("vec_id long, v binary")

    def task(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.append((i, _bytes(np.floor(SCALE * np.array(x, np.float64)))))
            yield batch_of(rows, schema)

    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < float("inf")))
    usable = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return usable.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(task, schema)


def _grouped(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each vector's nearest pivot and its distance."""
    schema = ddl("vec_id long, v binary, p int, dist double")

    def task(batches):
        for b in batches:
            vectors, step = b.column(1).to_pylist(), max(1, min(2000, CELLS // len(pivots)))
            for at in range(0, len(vectors), step):
                x = _matrix(vectors[at : at + step], pivots.shape[1]).astype(float)
                known = np.pad(pivots, ((0, 0), (0, x.shape[1] - pivots.shape[1]))).astype(float)
                near = ((known**2).sum(1) - 2 * (x @ known.T)).argmin(1)
                dist = np.sqrt(((x - known[near]) ** 2).sum(1))
                ids = b.column(0).slice(at, step).to_pylist()
                yield batch_of(list(zip(ids, vectors[at : at + step], near.tolist(), dist.tolist(), strict=True)), schema)

    return rows.select("vec_id", "v").mapInArrow(task, schema)


class Layout:
    """Where groups lie: their radii, vectors and blocks, and the vectors laid before them; parts follow from these."""

    def __init__(self, radius: np.ndarray, sizes: np.ndarray, block: int, part: int):
        self.radius, self.block, self.part = radius, block, part
        self.blocks = -(-sizes // block)
        self.start = np.cumsum(sizes) - sizes

    def parts(self, groups: np.ndarray) -> list[tuple[int, list[int]]]:
        """The parts in which groups' blocks lie, and the groups that are in each."""
        n = self.blocks[groups]
        each = np.repeat(groups, n)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        where = (self.start[each] + nth * self.block) // self.part
        out: dict[int, dict[int, None]] = {}
        for p, g in zip(where.tolist(), each.tolist(), strict=True):
            out.setdefault(p, {})[g] = None
        return [(p, list(g)) for p, g in out.items()]


def _sent(queries: DataFrame, pivots: np.ndarray, layout: Layout, *, first: bool) -> DataFrame:
    """Queries by the parts that they must meet: for the best-looking group, or for all others that can hold a result."""
    schema = ddl("part long, query_id long, v binary, groups array<int>")
    shared = queries.sparkSession.sparkContext.broadcast((pivots, layout))

    def task(batches):
        pivots, layout = shared.value
        step = max(1, min(500, CELLS // len(layout.radius)))
        for b in batches:
            all_ids, all_vectors, all_least = b.column(0).to_pylist(), b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), float)
            for at in range(0, len(all_ids), step):
                ids, vectors, least = (x[at : at + step] for x in (all_ids, all_vectors, all_least))
                q = _matrix(vectors, pivots.shape[1]).astype(float)
                known = np.pad(pivots, ((0, 0), (0, q.shape[1] - pivots.shape[1]))).astype(float)
                with np.errstate(over="ignore", invalid="ignore"):
                    middle = np.repeat(q @ known.T, RINGS, axis=1)
                    reach = np.sqrt((q**2).sum(1))[:, None] * layout.radius
                    bound = middle + reach + 1e-9 * (np.abs(middle) + np.abs(reach)) + 1e-3
                bound[np.isnan(bound)] = np.inf  # past what floats hold, so nothing is ruled out
                bound[:, layout.blocks == 0] = -np.inf
                best, rows = bound.argmax(1), []
                for i in range(len(ids)):
                    hit = (bound[i] >= least[i]) & (layout.blocks > 0)
                    hit[best[i]] = False
                    to = best[i : i + 1] if first else np.flatnonzero(hit)
                    rows += [(p, ids[i], vectors[i], groups) for p, groups in layout.parts(to)]
                    if len(rows) > 2_000:
                        yield batch_of(rows, schema)
                        rows = []
                yield batch_of(rows, schema)

    return queries.select("query_id", "v", "least").mapInArrow(task, schema)


def _better(ids: np.ndarray, x: np.ndarray, queries: list[tuple], k: int) -> Iterator[tuple[int, int, int]]:
    """(query's number, score, id) of the k best of a group for each query, ties to the smaller id."""
    score = _dot(_matrix([q[1] for q in queries]), x)
    own = np.array([q[0] for q in queries])[:, None] == ids
    low = np.iinfo(np.int64).min
    score[own] = low
    kth = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(queries), low)
    r, c = np.nonzero((score >= kth[:, None]) & ~own)
    order = np.lexsort((ids[c], -score[r, c], r))
    r, c = r[order], c[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    r, c = r[nth < k], c[nth < k]
    return zip(r.tolist(), score[r, c].tolist(), ids[c].tolist(), strict=True)


class _Part:
    """A part's vectors by group, and the queries that wait for them."""

    def __init__(self, number: int, k: int):
        self.number, self.k = number, k
        self.rows: dict[int, list[tuple[int, bytes]]] = {}
        self.groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.waiting: list[tuple[int, bytes, list[int]]] = []

    def solved(self) -> list[tuple]:
        """(query_id, v, vec_id, score): the k best of the part for each waiting query."""
        for g, rows in self.rows.items():
            self.groups[g] = np.array([i for i, _ in rows]), _matrix([v for _, v in rows])
        self.rows = {}
        meets: dict[int, list[int]] = {}
        for i, (_, _, groups) in enumerate(self.waiting):
            for g in groups:
                meets.setdefault(g, []).append(i)
        found: list[list[tuple[int, int]]] = [[] for _ in self.waiting]
        for g, who in meets.items():
            if g in self.groups:
                for r, score, i in _better(*self.groups[g], [self.waiting[w] for w in who], self.k):
                    found[who[r]].append((-score, i))
        out = [(q, v, i, -s) for (q, v, _), best in zip(self.waiting, found, strict=True) for s, i in sorted(best)[: self.k]]
        self.waiting = []
        return out


def _solved(data: DataFrame, sent: DataFrame, k: int) -> DataFrame:
    """Best k of each part for each query that was sent to it."""
    schema = ddl("query_id long, v binary, vec_id long, score long")
    both = data.select("part", F.lit(0).alias("side"), F.col("vec_id").alias("id"), "v", F.array("p").alias("groups")).unionByName(
        sent.select("part", F.lit(1).alias("side"), F.col("query_id").alias("id"), "v", "groups")
    )

    def task(batches):
        now = None
        for batch in batches:
            out = []
            for number, side, i, v, groups in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or number != now.number:
                    out += now.solved() if now is not None else []
                    now = _Part(number, k)
                if side == 0:
                    now.rows.setdefault(groups[0], []).append((i, v))
                    continue
                now.waiting.append((i, v, groups))
                if len(now.waiting) == AT_ONCE:
                    out += now.solved()
            yield batch_of(out, schema)
        if now is not None:
            yield batch_of(now.solved(), schema)

    return both.repartition("part").sortWithinPartitions("part", "side").mapInArrow(task, schema)


def _in_order(pivots: np.ndarray) -> np.ndarray:
    """Pivots along the direction in which they vary most, so that neighbours come to lie in the same part."""
    x = np.nan_to_num(pivots.astype(float), posinf=0, neginf=0)
    x = x / max(1.0, float(np.abs(x).max(initial=0)))
    v = np.ones(x.shape[1])
    for _ in range(8):
        v = (x - x.mean(0)).T @ ((x - x.mean(0)) @ v)
        v /= max(1e-300, float(np.linalg.norm(v)))
    return pivots[np.argsort(x @ v, kind="stable")]


def top_k(
    data: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, pivots: int | None = None, block: int = BLOCK, part: int = PART
) -> DataFrame:
    """The k highest inner products of every query over all data: query_id, rank, vec_id, score.

    Components are floor(256 * x).  Ties go to the smaller id; rows with the query's id are left out; a query
    with fewer than k candidates gets those.  Null vectors, null ids and vectors with a null or non-finite
    component, or one whose 256-fold isn't finite, take no part.  Products are exact, and scores beyond a long are the
    nearest long.  Vectors of any length are read whole; those of unequal length are compared as if the shorter ended with zeros;
    an id's repeated equal vectors count once.  Empty tables give no rows; other columns are ignored.
    """
    few = Window.partitionBy("v").orderBy("vec_id")
    rows = quantised(data, id_col, vector_col).distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    rows = stored(rows.select("vec_id", "v"), name="vectors")
    asked = stored(quantised(queries, id_col, vector_col).distinct().withColumnRenamed("vec_id", "query_id"), name="queries")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(rows.count())))
    picked = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
    if not picked:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.col("query_id").alias("score")).limit(0)
    known = _in_order(_matrix([r.v for r in picked]))
    cells = stored(_grouped(rows, known), name="cells")
    edges = cells.groupBy("p").agg(F.percentile_approx("dist", [i / RINGS for i in range(1, RINGS)], 1000).alias("edges"))
    ring = F.size(F.filter("edges", lambda x: F.col("dist") > x))
    grouped = cells.join(F.broadcast(edges), "p").select((F.col("p") * RINGS + ring).alias("p"), "vec_id", "v", "dist")  # MOST_PIVOTS rows at most
    grouped = stored(grouped, name="groups")
    sizes = grouped.groupBy("p").agg(F.count("*").alias("n"), F.max("dist").alias("r")).collect()  # at most a row a pivot and ring
    radius, n = np.zeros(len(known) * RINGS), np.zeros(len(known) * RINGS, int)
    for r in sizes:
        radius[r.p], n[r.p] = r.r, r.n
    layout = Layout(radius, n, block, part)
    places = [(i, int(b), int(a)) for i, (b, a) in enumerate(zip(layout.blocks, layout.start, strict=True)) if b]
    places = grouped.sparkSession.createDataFrame(places, "p int, blocks int, start long")
    at = F.floor((F.col("start") + F.pmod(F.xxhash64("vec_id"), "blocks") * block) / part)
    spread = grouped.join(F.broadcast(places), "p").select(at.alias("part"), "p", "vec_id", "v")
    start = _sent(asked.withColumn("least", F.lit(0.0)), known, layout, first=True)
    one = stored(_solved(spread, start, k), name="first")
    kth = one.groupBy("query_id", "v").agg(F.sort_array(F.collect_list("score"), asc=False).alias("x"))  # k rows of each part of a group
    kth = kth.select("query_id", "v", F.when(F.size("x") >= k, F.element_at("x", k).cast("double")).alias("kth"))
    least = asked.join(kth, ["query_id", "v"], "left").select("query_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    rest = _solved(spread, _sent(least, known, layout, first=False), k)
    rank = F.row_number().over(Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id"))
    return one.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
