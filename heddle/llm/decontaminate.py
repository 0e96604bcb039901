"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping windows of words, of a size for each class of item lengths, weighed by TF-IDF
over the benchmark's vocabulary; document frequencies come from all documents.  One pass adds up the Gram matrix of all windows
of all documents; a randomised SVD of it and the items themselves, each product being one Spark job, gives the latent
space.  Every window of every document is projected; those close to an item go to a check of the words
themselves: the longest common subsequence, and how many of the rarer half of the item's words, where its
answer is, stand there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, discard, free_name, id_or_text, stored

#: Words of the shortest items' windows.  A window has over half of its items' words; windows overlap by half.
SHORTEST = 8
#: Items that share a latent space, blocks of them searched in one pass, and items for whose words the documents are encoded at once.
BLOCK, BLOCKS, ENCODED = 250, 4, 20_000
#: Parts in which the tasks' matrices are added up.
PARTS = 8
#: Cells of a Gram matrix that a task adds up at once, as doubles, and blocks of its rows.
CELLS, UPPER = 8_000_000, 32
#: How much all items weigh beside all windows in the decomposition, so that the leading directions hold the items.
ITEM_WEIGHT = 4.0
#: Squared weight that a window has at least, so that windows of nothing but words of every document don't drown others' digits.
LEAST = 1e-9
CACHE_WORDS = 200_000
_MARKS = ".,;:!?()[]{}\"'“”«»„`*#&%|<>"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def bare(word: str) -> str:
    """A word without marks around it; a chunk of marks alone is empty."""
    return word.strip(_MARKS)


class _Ids(dict):
    """Ids of raw words, looked up without their marks; -1 outside the vocabulary, -2 for marks alone."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        w = bare(word)
        self[word] = found = self.vocabulary.get(w, -1) if w else -2
        return found


def window_of(length: int) -> int:
    """Words of the windows in which an item is looked for: SHORTEST times the largest power of two that isn't longer than the item."""
    return SHORTEST << max(0, (length // SHORTEST).bit_length() - 1)


@dataclass
class Space:
    """Items as word ids, and the weights and latent directions of the vocabulary."""

    item_ids: list[int]
    items: list[np.ndarray]
    vocabulary: dict[str, int]
    idf: np.ndarray
    other: float = 1.0
    #: Window sizes, and the places of the items looked for in each.
    classes: dict[int, np.ndarray] = field(default_factory=dict)
    basis: np.ndarray | None = None
    vectors: np.ndarray | None = None
    #: What each word adds to the product of a window's projection with each item's vector.
    reach: np.ndarray | None = None
    answers: list[set[int]] = field(default_factory=list)
    #: Ids here of the words of the stored documents; -1 outside the vocabulary.
    local: np.ndarray | None = None
    _ids: _Ids | None = field(default=None, repr=False)

    def ids(self, words: list[str]) -> np.ndarray:
        if self._ids is None:
            self._ids = _Ids(self.vocabulary)
        return np.fromiter(map(self._ids.__getitem__, words), np.int32, len(words))

    def batch(self, texts: Iterator[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of texts laid end to end, without marks, and each text's bounds."""
        parts = [self.ids(words_of(t)) for t in texts]
        parts = [p[p != -2] if (p == -2).any() else p for p in parts]
        return np.concatenate(parts or [np.empty(0, np.int32)]), np.cumsum([0, *map(len, parts)])


def windows(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows of every text; the last one is flush with its end."""
    starts, ends = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b > a:
            s = np.arange(a, max(a + 1, b - size + size // 2), size // 2)
            s[-1] = max(a, b - size) if len(s) > 1 else a
            starts.append(s)
            ends.append(np.minimum(s + size, b))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(ends)


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, with a bit for each word of the item."""
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in words.tolist():
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _encoded(docs: DataFrame, space: Space) -> DataFrame:
    """Per document: id, and the ids of its words, without marks, as packed numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(space)
    schema = ddl(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")

    def task(batches):
        import pyarrow as pa

        s, width = shared.value, _width(len(shared.value.vocabulary))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, bounds = s.batch(b.column(1).slice(at, 500).to_pylist())
                packed, n = ids.astype(width).tobytes(), np.dtype(width).itemsize
                parts = [packed[n * a : n * e] for a, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), pa.array(parts, pa.binary())], names=["doc_id", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(task, schema), name="word-ids")


def _width(size: int) -> str:
    return "<i2" if size < 1 << 15 else "<i4"


def _laid(parts: list[bytes], width: str, local: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of stored documents laid end to end, as ids of a block where ``local`` is given, and each document's bounds."""
    n = np.dtype(width).itemsize
    ids = np.frombuffer(b"".join(parts), width).astype(np.int32)
    return ids if local is None else local[ids], np.cumsum([0, *(len(x) // n for x in parts)])


def _frequencies(encoded: DataFrame, space: Space) -> tuple[int, np.ndarray]:
    """Documents, and how many of them hold each word of the vocabulary."""
    schema, size, width = ddl("w int, n long"), len(space.vocabulary), _width(len(space.vocabulary))

    def task(batches):
        total, df = 0, np.zeros(size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                ids, bounds = _laid(b.column(0).slice(at, 500).to_pylist(), width)
                total += len(bounds) - 1
                owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
                known = ids >= 0
                pairs = np.unique(owner[known] * size + ids[known])
                df += np.bincount(pairs % size, minlength=size)
        yield batch_of([(-1, total), *((int(i), int(df[i])) for i in np.flatnonzero(df))], schema)

    rows = encoded.select("ids").mapInArrow(task, schema).groupBy("w").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    df = np.zeros(size)
    for r in rows:
        if r.w >= 0:
            df[r.w] = r.n
    return next((r.n for r in rows if r.w < 0), 0), df


def _pairs(s: Space, ids: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of words that share windows, each word with itself too, as (words, words, the sum over these windows of one over the
    window's squared weight), the distance between both growing from part to part.  ``spans`` are starts and ends of windows."""
    at = np.flatnonzero(ids >= 0)
    words = ids[at]
    inside = np.concatenate([[0], np.cumsum(np.where(ids >= 0, s.idf[np.maximum(ids, 0)] ** 2, 0))])
    sums = []
    for starts, ends in spans:
        own = inside[ends] - inside[starts]
        total = np.concatenate([[0], np.cumsum(np.where(own > 0, 1 / np.maximum(own, LEAST), 0))])
        # the windows of two places are those that start up to the first and end after the second
        begun, over = (np.cumsum(np.bincount(x, minlength=len(ids) + 1))[at] for x in (starts, ends))
        sums.append((total[begun], total[over], int((ends - starts).max(initial=0))))
    first = None  # all places, until most share no window with one so far off
    for gap in range(max((size for *_, size in sums), default=0)):
        sums = [x for x in sums if x[2] > gap]
        if first is None:
            last = max(0, len(at) - gap)
            weight = sum(np.maximum(begun[:last] - over[gap:], 0) for begun, over, _ in sums)
            here = np.flatnonzero(weight)
            weight = weight[here]
            first = here if len(here) < last / 4 else None
        else:
            first = first[: np.searchsorted(first, len(at) - gap)]
            weight = sum(np.maximum(begun[first] - over[first + gap], 0) for begun, over, _ in sums)
            here = first = first[weight > 0]  # places further apart share no other windows
            weight = weight[weight > 0]
        if not len(here):
            return
        left, right = words[here], words[here + gap]
        yield left, right, np.where(left == right, 2 * weight, weight) if gap else weight


def _products(encoded: DataFrame, space: Space, shared) -> tuple[list[DataFrame], list[int]]:
    """The Gram matrix of all windows of all documents, before weights, as the blocks' first rows and stored tables of
    (block, n, part): upper rows end to end, and how many windows hold words of the vocabulary.

    Tasks are as many as the cores, so what they send doesn't grow with the documents, and a pass adds up ``CELLS`` cells or
    one row, so neither does what they hold.
    """
    schema, cells, size = ddl("block int, n long, part binary"), _width(len(space.local) - 1), len(space.vocabulary)
    first = np.concatenate([[0], np.cumsum(np.arange(size, 0, -1))])  # cells before each row's
    cuts, passes = [0], [[]]
    step = min(CELLS, -(-int(first[-1]) // UPPER))
    while cuts[-1] < size:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + step, side="right")) - 1))
        if passes[-1] and first[cuts[-1]] - first[cuts[passes[-1][0]]] > CELLS:
            passes.append([])
        passes[-1].append(len(cuts) - 2)

    def summed(blocks):
        low, high = cuts[blocks[0]], cuts[blocks[-1] + 1]

        def task(batches):
            s, n = shared.value, 0
            out = np.zeros(int(first[high] - first[low]))
            for b in batches:
                for at in range(0, b.num_rows, 200):
                    ids, bounds = _laid(b.column(0).slice(at, 200).to_pylist(), cells, s.local)
                    known = np.concatenate([[0], np.cumsum(ids >= 0)])
                    spans = [windows(bounds, k) for k in s.classes]
                    n += sum(int((known[e] > known[a]).sum()) for a, e in spans)
                    for left, right, weight in _pairs(s, ids, spans):
                        row, column = np.minimum(left, right), np.maximum(left, right)
                        if high - low < size:
                            here = (row >= low) & (row < high)
                            row, column, weight = row[here], column[here], weight[here]
                        np.add.at(out, first[row] - first[low] + column - row, weight)
            for k in blocks:
                part = out[first[cuts[k]] - first[low] : first[cuts[k + 1]] - first[low]]
                yield batch_of([(k, n, part.astype(np.float32).tobytes())], schema)

        return task

    tasks = encoded.select("ids").coalesce(encoded.sparkSession.sparkContext.defaultParallelism)
    parts = [tasks.mapInArrow(summed(blocks), schema).repartition(UPPER, "block").mapInArrow(_added(schema), schema) for blocks in passes]
    return [stored(p, name="products") for p in parts], cuts


def _added(schema):
    """Adds up the blocks' parts; a block is in one partition."""

    def task(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for block, n, part in zip(*b.columns, strict=True):
                old = sums.setdefault(block.as_py(), [0, 0.0])
                old[0], old[1] = old[0] + n.as_py(), old[1] + np.frombuffer(part.as_buffer(), np.float32)
        for k in list(sums):
            n, v = sums.pop(k)
            yield batch_of([(k, n, v.astype(np.float32).tobytes())], schema)

    return task


def _basis(encoded: DataFrame, space: Space, dims: int, rounds: int = 3) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF windows of all documents, by subspace iteration from a random start."""
    sc, size = encoded.sparkSession.sparkContext, len(space.vocabulary)
    width = min(len(space.items) + dims + 8, size)
    shared = sc.broadcast(space)
    tables, rows = _products(encoded, space, shared)
    products = reduce(DataFrame.union, tables)
    n = products.agg(F.max("n")).first()[0] or 0
    rng = np.random.default_rng(0)
    x = np.linalg.qr(rng.standard_normal((size, width)))[0]
    items = np.zeros((len(space.items), size), np.float32)
    for row, item in zip(items, space.items, strict=True):
        np.add.at(row, item, space.idf[item])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    blob = ddl("block int, n long, part binary")
    cuts = np.linspace(0, size, PARTS + 1).astype(int).tolist()
    for _ in range(rounds):
        sent = sc.broadcast((space.idf[:, None] * x).astype(np.float32))

        def product(batches, sent=sent):
            x = sent.value
            out = np.zeros(x.shape, np.float32)
            for b in batches:
                for block, _, part in zip(*b.columns, strict=True):
                    a, e = rows[block.as_py()], rows[block.as_py() + 1]
                    upper = np.zeros((e - a, size - a), np.float32)
                    upper[np.triu(np.ones(upper.shape, bool))] = np.frombuffer(part.as_buffer(), np.float32)
                    out[a:e] += upper @ x[a:]
                    upper[np.arange(e - a), np.arange(e - a)] = 0  # the diagonal counts once
                    out[a:] += upper.T @ x[a:e]
            yield batch_of([(k, 0, out[a:e].tobytes()) for k, (a, e) in enumerate(zip(cuts, cuts[1:], strict=False))], blob)

        y = np.zeros(x.shape)
        for r in products.mapInArrow(product, blob).repartition(PARTS, "block").mapInArrow(_added(blob), blob).collect():  # one matrix, in parts
            y[cuts[r.block] : cuts[r.block + 1]] = np.frombuffer(r.part, np.float32).reshape(-1, width)
        y = space.idf[:, None] * y * len(items) / max(1, n) + ITEM_WEIGHT * items.T @ (items @ x.astype(np.float32))
        small = x.T @ y
        x, before = np.linalg.qr(y)[0], x
        sent.destroy()
    discard(*tables)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (before @ turn[:, np.argsort(-values)[: len(space.items) + dims]]).astype(np.float32)


def _words(item: str | None) -> list[str]:
    return [w for raw in words_of(item) if (w := bare(raw))]


def _encoder(rows: list) -> Space:
    """The vocabulary of many items, by which documents are encoded once."""
    vocabulary: dict[str, int] = {}
    for r in rows:
        for w in _words(r.text):
            vocabulary.setdefault(w, len(vocabulary))
    return Space([], [], vocabulary, np.empty(0))


def _space(block: list, encoder: Space, encoded: DataFrame, total: int, df: np.ndarray, dims: int) -> Space:
    """The space of a block of items."""
    vocabulary: dict[str, int] = {}
    texts = [_words(r.text) for r in block]
    for words in texts:
        for w in words:
            vocabulary.setdefault(w, len(vocabulary))
    items = [np.array([vocabulary[w] for w in words], np.int32) for words in texts]
    here = np.array([encoder.vocabulary[w] for w in vocabulary])
    space = Space([r.item_id for r in block], items, vocabulary, np.log((total + 2) / (df[here] + 1)), math.log(total + 2))
    space.local = np.full(len(encoder.vocabulary) + 1, -1, np.int32)  # the last one is that of any other word
    space.local[here] = np.arange(len(here))
    sizes = np.array([window_of(len(i)) for i in items])
    space.classes = {int(w): np.flatnonzero(sizes == w) for w in np.unique(sizes)}
    space.basis = _basis(encoded, space, dims)
    raw = np.stack([(space.idf[i][:, None] * space.basis[i]).sum(0) for i in items])
    space.vectors = (raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    space.answers = [{w for w in set(i.tolist()) if space.idf[w] >= np.median(space.idf[np.unique(i)])} for i in items]
    space.reach = ((space.idf[:, None] * space.basis) @ space.vectors.T).astype(np.float32)
    space.basis, space.vocabulary = None, {}  # not needed any more, so not sent to tasks
    return space


def _confirm(s: Space, ids, bounds, starts, ends, every, reach, members, least_cosine: float, least_lcs: float, best: dict) -> None:
    """Adds to ``best`` what the windows hold of the items ``members``, whose columns ``reach`` has."""
    owner = np.searchsorted(bounds, starts, side="right") - 1
    for at in range(0, len(starts), 500):
        part = slice(at, at + 500)
        sizes = ends[part] - starts[part]
        first = np.cumsum(sizes) - sizes
        words = ids[np.arange(sizes.sum()) + np.repeat(starts[part] - first, sizes)]
        cosine = np.add.reduceat(reach[words], first) / np.sqrt(every[part])[:, None]
        for i, k in zip(*np.nonzero(cosine >= least_cosine), strict=True):
            text, j = int(owner[at + i]), int(members[k])
            item = s.items[j]
            a = max(int(bounds[text]), int(starts[at + i]) - len(item))
            e = min(int(bounds[text + 1]), int(ends[at + i]) + len(item))
            region = ids[a:e]
            answer = len(s.answers[j] & set(region.tolist())) / max(1, len(s.answers[j]))
            if answer < 0.5:
                continue
            share = common_subsequence(item, region) / len(item)
            if share >= least_lcs:
                found = (float(cosine[i, k]), share, answer)
                best[text, j] = max(found, best.get((text, j), found))


def _matches(s: Space, ids: np.ndarray, bounds: np.ndarray, least_cosine: float, least_lcs: float) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, share in common subsequence, share of answer words)."""
    if not len(ids):
        return []
    known = ids >= 0
    weight = np.where(known, s.idf[np.maximum(ids, 0)], s.other)
    inside = np.concatenate([[0], np.cumsum(np.where(known, weight**2, 0))])
    all_of = np.concatenate([[0], np.cumsum(weight**2)])
    reach = np.concatenate([s.reach, np.zeros((1, len(s.items)), np.float32)])  # the last row is that of any other word
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for size, members in s.classes.items():
        starts, ends = windows(bounds, size)
        own, every = inside[ends] - inside[starts], all_of[ends] - all_of[starts]
        lightest = min(float((s.idf[s.items[j]] ** 2).sum()) for j in members)
        # the cosine of the whole window is at most the root of its vocabulary's share of weight
        close = (own >= least_cosine**2 * every) & (own >= least_cosine**2 * min(lightest, 8 * s.other**2))
        # and at most what its words add to the items that they add most to
        part = reach[:, members]
        most = np.concatenate([[0], np.cumsum(np.where(known, part.max(1).astype(np.float64)[ids], 0))])
        near = np.flatnonzero(close & (most[ends] - most[starts] >= (least_cosine - 1e-4) * np.sqrt(every)))
        _confirm(s, ids, bounds, starts[near], ends[near], every[near], part, members, least_cosine, least_lcs, best)
    return [(*k, *v) for k, v in sorted(best.items())]


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: int = 64,
    least_cosine: float = 0.1,
    least_lcs: float = 0.5,
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds: id, item_id, cosine, lcs, answer.

    ``lcs`` is the share of the item's words in the longest common subsequence with the place in the
    document, ``answer`` the share of the rarer half of its words there; half of each is needed.  The least cosine is low, as words
    between those of an item dilute a window.  Null and empty texts, and items without words, match nothing; very long texts are
    read whole.  Repeated rows give a row each; without documents or items there
    are no rows; other columns are ignored.  The latent space has ``dims`` dimensions besides one for each item of
    a block, fitted on all windows of all documents.  Documents are encoded once for ``ENCODED`` items, and searched
    for ``BLOCKS`` blocks of ``BLOCK`` items in a pass over their ids, so what is broadcast stays bounded.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ddl(f"{id_col} {id_type}, item_id long, cosine double, lcs double, answer double")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text")
    found, last = None, None
    while True:
        after = items if last is None else items.where((F.col("item_id") > last[0]) | ((F.col("item_id") == last[0]) & (F.col("text") > last[1])))
        many = after.limit(ENCODED).collect()
        if not many:
            break
        last = many[-1].item_id, many[-1].text
        usable = [r for r in many if any(map(bare, words_of(r.text)))]
        if not usable:
            continue
        encoder = _encoder(usable)
        encoded = _encoded(texts, encoder)
        total, df = _frequencies(encoded, encoder)
        width = _width(len(encoder.vocabulary))
        blocks = [usable[at : at + BLOCK] for at in range(0, len(usable), BLOCK)]
        for at in range(0, len(blocks), BLOCKS):
            spaces = [_space(block, encoder, encoded, total, df, dims) for block in blocks[at : at + BLOCKS]]
            part = stored(encoded.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(spaces), width, schema, least_cosine, least_lcs), schema), name="leaks")
            found = part if found is None else found.union(part)
        discard(encoded)
    return found if found is not None else texts.sparkSession.createDataFrame([], schema)


def _search(shared, width: str, schema, least_cosine: float, least_lcs: float):
    def task(batches):
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at in range(0, len(doc_ids), 500):
                parts = b.column(1).slice(at, 500).to_pylist()
                for s in shared.value:
                    ids, bounds = _laid(parts, width, s.local)
                    hits = _matches(s, ids, bounds, least_cosine, least_lcs)
                    yield batch_of([(doc_ids[at + t], s.item_ids[j], c, lcs, x) for t, j, c, lcs, x in hits], schema)

    return task


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their columns as they are.

    A repeated doc_id goes if any of its rows holds one; rows with a null id go by their text.  A null or empty text
    holds none and stays, a long one is read whole, an empty table gives an empty one, and other columns stay as they
    are, whatever their names.
    """
    key = free_name(docs.columns, "_key")
    rows = docs.withColumn(key, id_or_text())
    bad = leaks(rows.select(key, "text"), benchmark, id_col=key).select(F.col(key).alias("bad")).distinct()
    return rows.join(bad, rows[key].eqNullSafe(bad["bad"]), "left_anti").drop(key)
