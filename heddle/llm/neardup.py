"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Equal shingle sets are one node.  Each tree of the forest sorts the nodes by its own part of the signature
with a range partitioning; runs that share a prefix are leaves, cut deeper where they
are crowded, so the depth follows the region.  Leaves of the first trees give spanning forests of their pairs
that look alike; confirmed ones join into components; then leaves of all trees that hold several
components give all pairs across them.  No leaf is larger than a fixed number of nodes; a run that had to be cut
is then compared whole, every node with all those of other components, in cells of two bounded blocks of
nodes, so nothing is dropped and no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ascii_word_bytes, batch_of, ddl, discard, stored
from heddle.llm.graph import components

TREES, DEPTH, SHARED = 16, 6, 3
#: Trees whose spanning forests are confirmed first; the others then only add pairs across components.
FIRST_TREES = 4
HASHES = TREES * DEPTH
LEAF = 128
#: Bins of the sketch by which pairs of a leaf are compared.
BINS = 512
#: What an estimate may lie below the threshold for a pair to be confirmed; over four standard errors of BINS bins.
SLACK = 0.075
#: Nodes, and shingles of them, in a block of a run that is compared whole; a task holds two blocks.
BLOCK_NODES, BLOCK_SHINGLES = 4_096, 2_000_000
CACHE_WORDS = 1_000_000
_words: dict[bytes, int] = {}
_M = np.random.default_rng(20_240_101).integers(1 << 62, size=(2, HASHES), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence where it has fewer words."""
    import xxhash

    words = ascii_word_bytes(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    try:
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    except KeyError:
        _words.update([(x, xxhash.xxh3_64_intdigest(x)) for x in set(words) if x not in _words])
        w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        h = _mix(h + w[j : len(w) - n + 1 + j]) * _M[0, j]
    return np.unique(_mix(h))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets: [sets, HASHES]."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((flat * _M[1, i]) >> np.uint64(32), starts)
    return out


def signature_table(docs: DataFrame, *, id_col: str, text_col: str, k: int) -> DataFrame:
    """Per document: id, n_shingles, the set's hash in two parts and its signature (null for an empty set)."""
    import xxhash

    schema = ddl("doc_id long, n_shingles long, s1 long, s2 long, sig binary")

    def rows_of(ids: list, sets: list[np.ndarray]) -> list[tuple]:
        full = [i for i, s in enumerate(sets) if len(s)]
        sig = dict(zip(full, _signatures([sets[i] for i in full]), strict=True)) if full else {}
        out = []
        for i, (d, s) in enumerate(zip(ids, sets, strict=True)):
            if len(s):
                a = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((d, len(s), (a >> 64) - (1 << 63), (a & ((1 << 64) - 1)) - (1 << 63), sig[i].astype(">u4").tobytes()))
            else:
                out.append((d, 0, None, None, None))
        return out

    def task(batches: Iterator) -> Iterator:
        for b in batches:
            ids = b.column(0).to_pylist()
            at = 0
            while at < len(ids):
                sets, size, first = [], 0, at
                while at < len(ids) and size < 60_000:
                    sets.append(shingles(b.column(1)[at].as_py(), k))
                    size += len(sets[-1])
                    at += 1
                yield batch_of(rows_of(ids[first:at], sets), schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(task, schema)


def _leaves(nodes: DataFrame) -> DataFrame:
    """Leaves of every tree, (leaf, tree, node), and the nodes of runs that were cut or may go on in another task, (run, tree, node)."""
    rows_schema = ddl("tree int, key binary, sketch binary, node long")

    def rows(batches):
        for b in batches:
            out = []
            for node, sig in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low = np.frombuffer(sig, np.uint8)[3::4] & 15
                sketch = (low[::2] << 4 | low[1::2]).tobytes()
                out += [(t, sig[4 * DEPTH * t : 4 * DEPTH * (t + 1)], sketch, node) for t in range(TREES)]
            yield batch_of(out, rows_schema)

    leaf_schema = ddl("leaf long, tree int, node long, run long")

    def walk(batches):
        import xxhash
        from pyspark import TaskContext

        number, run, out = TaskContext.get().partitionId() << 36, [], []
        open_ended = True  # whether the run has rows outside ``run``, as the first and the last of a task may have

        def emit(part: list[tuple]) -> None:
            nonlocal number
            for at in range(0, max(1, len(part) - LEAF // 2), LEAF // 2) if len(part) > LEAF else [0]:
                out.extend((number, r[0], r[3], None) for r in part[at : at + LEAF])
                number += 1

        def whole(part: list[tuple]) -> None:
            if part:
                key = xxhash.xxh3_64_intdigest(bytes([part[0][0]]) + part[0][1][: 4 * SHARED]) - (1 << 63)
                out.extend((None, r[0], r[3], key) for r in part)

        def cut(part: list[tuple], depth: int) -> None:
            if len(part) <= LEAF or depth == DEPTH:
                if len(part) > 1:
                    emit(part)
                return
            first = 0
            for i in range(1, len(part) + 1):
                if i == len(part) or part[i][1][4 * depth : 4 * depth + 4] != part[first][1][4 * depth : 4 * depth + 4]:
                    cut(part[first:i], depth + 1)
                    if i < len(part):
                        emit(part[i - 1 : i + 1])
                    first = i

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if run and (r[0] != run[-1][0] or r[1][: 4 * SHARED] != run[-1][1][: 4 * SHARED]):
                    cut(run, SHARED)
                    if open_ended or len(run) > LEAF:
                        whole(run)
                    run, open_ended = [], False
                elif len(run) >= 4096:
                    cut(run, SHARED)
                    whole(run[:-LEAF])
                    run, open_ended = run[-LEAF:], True
                run.append(r)
            if len(out) > 5_000:
                yield batch_of(out, leaf_schema)
                out = []
        cut(run, SHARED)
        whole(run)
        yield batch_of(out, leaf_schema)

    spread = nodes.select("node", "sig").mapInArrow(rows, rows_schema)
    return spread.repartitionByRange("tree", "key", "sketch").sortWithinPartitions("tree", "key", "sketch", "node").mapInArrow(walk, leaf_schema)


def _bins(s: np.ndarray) -> bytes:
    """A byte for each of BINS equal ranges of hashes, from the set's smallest one there; 0 where it has none."""
    first = np.searchsorted(s, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    full = first < np.append(first[1:], len(s))
    code = np.uint64(1) + s[np.minimum(first, len(s) - 1)] % np.uint64(255)
    return np.where(full, code, np.uint64(0)).astype(np.uint8).tobytes()


def _similar(sketches: list[bytes]) -> np.ndarray:
    """Estimated similarities of all pairs of a leaf: equal bins among those that either set fills."""
    code = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    full = code > 0
    same = np.stack([((code == row) & full).sum(1) for row in code])
    return same / np.stack([(full | row).sum(1) for row in full])


def _pairs(leaves: DataFrame, least: float, *, across: bool) -> DataFrame:
    """Pairs of each leaf with an estimate of ``least`` or more, from different components (``root``).

    ``across`` gives all of them, else only a spanning forest with the highest estimates.
    """
    schema = ddl("a long, b long")

    def solve(nodes: list, roots: list, sketches: list, found: list) -> None:
        if len(set(roots)) < 2:
            return
        s = _similar(sketches)
        i, j = np.nonzero(np.triu(s >= least, 1))
        order = np.argsort(-s[i, j], kind="stable")
        above = {r: r for r in roots}

        def top(x):
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = top(roots[x]), top(roots[y])
            if p != q:
                found.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
                if not across:
                    above[p] = q

    def task(batches):
        leaf, held = None, ([], [], [])
        for b in batches:
            found: list[tuple] = []
            for at, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != leaf:
                    solve(*held, found)
                    leaf, held = at, ([], [], [])
                for part, x in zip(held, row, strict=True):
                    part.append(x)
            yield batch_of(found, schema)
        found = []
        solve(*held, found)
        yield batch_of(found, schema)

    rows = leaves.select("leaf", "node", "root", "sketch").repartition("leaf").sortWithinPartitions("leaf")
    return rows.mapInArrow(task, schema).where("a <> b").distinct()


def _cells(runs: DataFrame) -> DataFrame:
    """(cell, inner, left, node, root): cells that hold all pairs of a run's nodes (run, node, root, size) from different components.

    The nodes of a run's largest component are the right side, which isn't compared with itself.  Both sides are dealt
    into blocks; a cell is a block of the left side and any other block, and compares the left block with itself where ``inner``.
    """
    each = runs.groupBy("run", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    both = each.groupBy("run").agg(F.max(F.struct("n", "root", "size")).alias("most"), F.sum("n").alias("n"), F.sum("size").alias("size")).where("most.n < n")
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_NODES, size / BLOCK_SHINGLES)).cast("int")
    dealt = both.select("run", F.col("most.root").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("lefts"), blocks(F.col("most.n"), F.col("most.size")).alias("rights"))
    placed = runs.join(dealt, "run").withColumn("left", F.col("root") != F.col("main"))
    spot = F.xxhash64("node")
    placed = placed.withColumn("own", F.when(F.col("left"), F.pmod(spot, F.col("lefts"))).otherwise(F.col("lefts") + F.pmod(spot, F.col("rights"))).cast("int"))
    last = F.when(F.col("left"), F.col("lefts") + F.col("rights")).otherwise(F.col("lefts")) - 1
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("other <> own")
    first, second = F.least("own", "other"), F.greatest("own", "other")
    return met.select(F.xxhash64("run", first, second).alias("cell"), (second == F.col("lefts")).alias("inner"), (F.col("own") == first).alias("left"), "node", "root")


def _across(runs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Confirmed pairs that join components within runs: a spanning forest of each cell's."""
    schema = ddl("a long, b long")

    def solve(inner: list, left: list, nodes: list, roots: list, sketches: list, items: list, found: list) -> None:
        if len(set(roots)) < 2:
            return
        code = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), -1)
        bits = np.packbits(code > 0, axis=1).view(np.uint64)
        filled = np.bitwise_count(bits).sum(1, dtype=np.int64)
        group = np.unique(roots, return_inverse=True)[1]
        side = np.array(left)
        for i in np.flatnonzero(side).tolist():
            other = group != group[i]
            if inner[i]:
                other[:i] &= ~side[:i]  # an earlier one of the left side has met this one
            else:
                other &= ~side
            at = np.flatnonzero(other)
            if not len(at):
                continue
            same = np.ascontiguousarray(code[at] == code[i]).view(np.uint64).sum(1).view(np.uint8).reshape(len(at), -1).sum(1, dtype=np.int64)
            shared = np.bitwise_count(bits[at] & bits[i]).sum(1, dtype=np.int64)
            union = filled[at] + filled[i] - shared
            estimate = (same - (BINS - union)) / union
            near = np.flatnonzero(estimate >= least)
            for j in at[near[np.argsort(-estimate[near], kind="stable")]].tolist():
                if group[j] != group[i] and _linked(items[i], items[j], percent):
                    found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
                    group[group == group[j]] = group[i]

    def task(batches):
        cell, held = None, ([], [], [], [], [], [])
        for b in batches:
            found: list[tuple] = []
            for at, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != cell:
                    solve(*held, found)
                    cell, held = at, ([], [], [], [], [], [])
                for part, x in zip(held, row, strict=True):
                    part.append(x)
            yield batch_of(found, schema)
        found = []
        solve(*held, found)
        yield batch_of(found, schema)

    rows = _cells(runs).join(sets, "node").select("cell", "inner", "left", "node", "root", "sketch", "items")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(task, schema).distinct()


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    one, two = _unpack(x), _unpack(y)
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(two) - common)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    schema = ddl("a long, b long")

    def task(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if _linked(x, y, percent):
                    out.append((a, b))
            yield batch_of(out, schema)

    first = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    both = first.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(task, schema)


def _pack(s: np.ndarray) -> bytes:
    """Six bytes of each hash; two shingles of a pair meet by chance about once in a billion pairs."""
    return s.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Full sets of the given nodes, and their sketches."""
    schema = ddl("node long, items binary, sketch binary")

    def task(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), 200):
                texts = b.column(1).slice(at, 200).to_pylist()
                found = [(d, shingles(t, k)) for d, t in zip(ids[at : at + 200], texts, strict=True)]
                yield batch_of([(d, _pack(x), _bins(x)) for d, x in found], schema)

    # a sort-merge join at every size: nodes grow with the corpus, so they are never broadcast
    return docs.join(nodes.hint("merge"), docs["doc_id"] == nodes["node"], "left_semi").mapInArrow(task, schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable) and kept (it has that id).

    Words are runs of anything but ASCII white space, A-Z in lower case.  Documents are linked where
    the Jaccard similarity of their sets of k-word shingles is at least ``percent`` per cent; a text of fewer
    words is one shingle; one without words, or null, is linked with nothing.  A row with a null id is linked
    with nothing, has a null component and is kept.  Rows are linked by their texts, so repeated
    rows share a component; an empty table gives no rows; other columns are ignored.  Very long texts are read
    whole and compared on their full sets.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = stored(signature_table(texts, id_col="doc_id", text_col="text", k=k), name="signatures")
    linked = table.where("s1 is not null and doc_id is not null")
    nodes = linked.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"))
    nodes = stored(nodes, name="nodes")
    least = percent / 100 - SLACK
    placed = stored(_leaves(nodes), name="leaves")
    sets = stored(_sets(texts, placed.select("node").distinct(), k), name="sets")
    crowded = placed.where("run is not null").select("run", "tree", "node")
    leaves = placed.where("leaf is not null").join(sets.select("node", "sketch"), "node")
    tried = stored(_pairs(leaves.where(F.col("tree") < FIRST_TREES).withColumn("root", F.col("node")), least, across=False), name="pairs")
    links = stored(_confirmed(tried, sets, percent), name="links")
    roots = components(links)
    known = leaves.join(roots, "node", "left").select("leaf", "node", "sketch", F.coalesce("root", "node").alias("root"))
    untried = _pairs(known, least, across=True).join(tried, ["a", "b"], "left_anti")  # pairs that were refuted stay so
    more = stored(_confirmed(untried, sets, percent), name="links")
    discard(tried)
    if not more.isEmpty():
        links = links.union(more)
        roots = components(links)
    for trees in (F.col("tree") < FIRST_TREES, F.col("tree") >= FIRST_TREES):
        runs = crowded.where(trees).join(roots, "node", "left").join(nodes.select("node", "size"), "node")
        more = stored(_across(runs.select("run", "node", F.coalesce("root", "node").alias("root"), "size"), sets, least, percent), name="links")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
    discard(placed, sets)
    by_set = nodes.join(roots, "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("root"))
    out = table.select("doc_id", "n_shingles", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with their columns as they are.

    Rows with a null id, and null and empty texts, stay; so do all rows of a doc_id that is kept, as they can't be told
    apart.  An empty table gives an empty one; other columns stay as they are, whatever their names.
    """
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
