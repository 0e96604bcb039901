"""Ranked lexical search over document-sharded postings.

Each task cuts its documents into shards of bounded size and writes a shard as one row: a vocabulary, and in CSR form each
term's documents and their precomputed integer impacts.  A block of queries is sent to the shards, which are scored term
at a time into dense accumulators; the best of each shard meet by query.  Nothing of the corpus is shuffled but
the best rows and the counts of the queries' own terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, stored
from heddle.sources.scratch import folder

#: A shard ends with so many terms or documents; document numbers have 16 bits.
SHARD_TERMS, SHARD_DOCS = 1 << 20, 1 << 16
#: Longer texts are shards of their own, counted piece by piece.
LONG_BYTES, PIECE = 4 << 20, 1 << 20
#: A block of queries, which is broadcast, has so many pairs of a query and a term at most, or one query.
BLOCK_PAIRS = 200_000
#: Groups that the best rows of a query meet in first.
GROUPS = 32
#: Letters and digits of ASCII in lower case, spaces for the rest of ASCII, other bytes as they are.
_TABLE = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text as lists of bounded length."""
    text = text.translate(_TABLE)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def weight(documents: int, holding: int) -> int:
    """A term's weight by the number of documents and of those that hold it."""
    return int(np.floor(1000 * np.log((2 * documents + 2) / (2 * holding + 1))))


class Index:
    """``shards`` is the table of postings; ``documents`` have a term at least, ``terms`` are all of theirs with repeats."""

    def __init__(self, shards: DataFrame, documents: int, terms: int):
        self.shards, self.documents, self.terms = shards, documents, terms


_SHARD = "n long, doc_ids binary, nulls binary, vocabulary binary, starts binary, docs binary, impacts binary"


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_terms: int = SHARD_TERMS, long_bytes: int = LONG_BYTES) -> Index:
    """An index of every document.

    Null, empty and termless texts aren't in it.  Rows that share an id or a text are documents of their own.  Very long
    texts are read whole.  Of other columns nothing is read.  An empty table gives an index without shards.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t IS NOT NULL")
    sizes = ddl("documents long, terms long")

    def counted(batches: Iterator) -> Iterator:
        documents = terms = 0
        for b in batches:
            for text in b.column("t"):
                n = sum(map(len, term_pieces(text.as_py())))
                documents, terms = documents + (n > 0), terms + n
        yield batch_of([(documents, terms)], sizes)

    found = rows.select("t").mapInArrow(counted, sizes).agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = found[0] or 0, found[1] or 0
    schema = ddl(_SHARD)

    def shards(batches: Iterator) -> Iterator:
        open_ = _Shard(documents, terms)
        for b in batches:
            for i, t in zip(b.column("i").to_pylist(), b.column("t"), strict=True):
                text = t.as_py()
                if len(text) > long_bytes:
                    alone = _Shard(documents, terms)
                    alone.add_long(i, text)
                    yield from (batch_of([r], schema) for r in alone.rows())
                    continue
                open_.add(i, text)
                if open_.size >= shard_terms or len(open_.ids) >= SHARD_DOCS:
                    yield from (batch_of([r], schema) for r in open_.rows())
                    open_ = _Shard(documents, terms)
        yield from (batch_of([r], schema) for r in open_.rows())

    return Index(stored(rows.mapInArrow(shards, schema), name="postings"), documents, terms)


class _Shard:
    """Documents of one shard, as numbers of terms until it is written."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[np.ndarray] = []
        self.size = 0
        self.counts: Counter | None = None

    def add(self, doc_id: int | None, text: bytes) -> None:
        n = 0
        for terms in term_pieces(text):
            self.found.append(np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms)) << 16 | len(self.ids))
            n += len(terms)
        self._ended(doc_id, n)

    def add_long(self, doc_id: int | None, text: bytes) -> None:
        self.counts = Counter()
        for terms in term_pieces(text):
            self.counts.update(terms)
        self._ended(doc_id, self.counts.total())

    def _ended(self, doc_id: int | None, n: int) -> None:
        if n:
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.size += n

    def rows(self) -> Iterator[tuple]:
        """The shard's row, or none where no document has a term.  Documents are numbered by id, null ids last."""
        if not self.ids:
            return
        nulls = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        order = np.lexsort((ids, nulls))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        if self.counts is not None:
            vocabulary = list(self.counts)
            term, doc, tf = np.arange(len(vocabulary)), np.zeros(len(vocabulary), np.int64), np.fromiter(self.counts.values(), np.int64, len(vocabulary))
        else:
            vocabulary = list(self.number)
            keys = np.concatenate(self.found)
            keys = np.sort(keys >> 16 << 16 | place[keys & 0xFFFF])
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            tf = np.diff(first, append=len(keys))
            term, doc = keys[first] >> 16, keys[first] & 0xFFFF
        m = np.array([25 + 75 * n * self.documents // self.terms for n in self.lengths], np.int64)[order]
        impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        parts = (ids[order], nulls[order], starts.astype("<i4"), doc.astype("<u2"), impacts.astype("<u4"))
        i, z, s, d, w = (p.tobytes() for p in parts)
        yield (len(ids), i, z, b" ".join(vocabulary), s, d, w)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best scores above 0; of equal ones at the end those with the smallest numbers."""
    some = np.flatnonzero(scores)
    if len(some) <= k:
        return some
    held = scores[some]
    least = held[np.argpartition(held, len(held) - k)[len(held) - k]]
    over = some[held > least]
    return np.concatenate([over, some[held == least][: k - len(over)]])


class _Block:
    """A bounded number of queries: ``terms`` numbers their terms, ``queries`` has of each its terms' numbers and repeats."""

    def __init__(self):
        self.keys: list[tuple[int | None, int]] = []
        self.queries: list[tuple[np.ndarray, np.ndarray]] = []
        self.terms: dict[bytes, int] = {}
        self.pairs = 0

    def add(self, key: tuple[int | None, int], counts: Counter) -> None:
        numbers = [self.terms.setdefault(t, len(self.terms)) for t in counts]
        self.keys.append(key)
        self.queries.append((np.array(numbers, np.int64), np.fromiter(counts.values(), np.int64, len(counts))))
        self.pairs += len(counts)


def _blocks(queries: DataFrame, pairs: int) -> Iterator[_Block]:
    block = _Block()
    for at, (item, text) in enumerate(queries.toLocalIterator()):
        counts: Counter = Counter()
        for terms in term_pieces(bytes(text)):
            counts.update(terms)
        if block.keys and block.pairs + len(counts) > pairs:
            yield block
            block = _Block()
        block.add((item, at), counts)
    if block.keys:
        yield block


def _held(index: Index, block: _Block) -> dict[int, int]:
    """How many documents hold each of a block's terms, by the term's number; reads the vocabularies alone."""
    schema = ddl("term int, n long")
    wanted = index.shards.sparkSession.sparkContext.broadcast(block.terms)

    def counted(batches: Iterator) -> Iterator:
        terms = wanted.value
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for words, starts in zip(b.column("vocabulary"), b.column("starts"), strict=True):
                sizes = np.diff(np.frombuffer(starts.as_py(), "<i4"))
                found = [(at, terms[w]) for at, w in enumerate(words.as_py().split(b" ")) if w in terms]
                if found:
                    at, number = np.array(found).T
                    total[number] += sizes[at]
        some = np.flatnonzero(total)
        yield batch_of(list(zip(some.tolist(), total[some].tolist(), strict=True)), schema)

    rows = index.shards.select("vocabulary", "starts").mapInArrow(counted, schema).groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in rows.collect()}


def _scored(index: Index, block: _Block, k: int) -> DataFrame:
    """(query, doc_id, score): the best of each task for each query of a block."""
    schema = ddl("query long, item_id long, doc_id long, score long")
    held = _held(index, block)
    weights = np.array([weight(index.documents, held[i]) if i in held else 0 for i in range(len(block.terms))], np.int64)
    sent = index.shards.sparkSession.sparkContext.broadcast((block, weights))

    def best(batches: Iterator) -> Iterator:
        block, weights = sent.value
        kept: dict[int, list[tuple]] = {}
        for b in batches:
            for row in (b.slice(j, 1).to_pylist()[0] for j in range(b.num_rows)):
                at = np.full(len(weights), -1, np.int64)
                for i, w in enumerate(row["vocabulary"].split(b" ")):
                    if (number := block.terms.get(w)) is not None:
                        at[number] = i
                starts, docs, impacts = (np.frombuffer(row[c], t) for c, t in (("starts", "<i4"), ("docs", "<u2"), ("impacts", "<u4")))
                ids, nulls = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["nulls"], bool)
                impacts = impacts.astype(np.int64)
                for q, (numbers, repeats) in enumerate(block.queries):
                    scores = np.zeros(row["n"], np.int64)
                    there = at[numbers] >= 0
                    for i, w in zip(at[numbers[there]].tolist(), (weights[numbers] * repeats)[there].tolist(), strict=True):
                        lo, hi = starts[i], starts[i + 1]
                        scores[docs[lo:hi]] += w * impacts[lo:hi]
                    new = [(-int(scores[d]), bool(nulls[d]), int(ids[d])) for d in _best(scores, k)]
                    if new:
                        kept[q] = sorted(kept.get(q, []) + new)[:k]
        rows = [(block.keys[q][1], block.keys[q][0], None if null else i, -s) for q, found in kept.items() for s, null, i in found]
        yield batch_of(rows, schema)

    return index.shards.mapInArrow(best, schema)


def search(index: Index, queries: DataFrame, k: int = 10, *, item_col: str = "item_id", text_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents with a score above 0, equal scores by id, null ids last.

    A query without a known term has no rows.  Repeats of a query (id and text) count once; queries that
    share an id alone are ranked apart.  Queries are taken in blocks, each of which reads all shards; very long ones are read whole.
    """
    spark = index.shards.sparkSession
    asked = queries.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).where("t IS NOT NULL").distinct()
    path, some = folder(spark, name="ranked"), False
    schema = ddl("item_id long, rank int, doc_id long, score long")
    for block in _blocks(asked, block_pairs):
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = _scored(index, block, k).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
        for keys in (["query", "part"], ["query"]):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        found.select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
        some = True
    return spark.read.schema(schema).parquet(path) if some else spark.createDataFrame([], schema)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""WITH terms AS (SELECT r, doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents)),
totals AS (SELECT count(DISTINCT r) AS docs, count(*) AS words FROM terms),
postings AS (SELECT r, doc_id, term, n, count(*) AS tf FROM terms GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
FROM asked JOIN postings USING (term) JOIN weights USING (term), totals GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
