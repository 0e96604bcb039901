"""Substring dedup over sliding runs of sentences.

Every run of consecutive sentences is hashed, runs are joined over the whole table, and sentences under a
repeated run that is not its first are removed.  Long sentences are first cut after
words that a hash picks, so a passage is cut alike wherever it stands.  In scripts written without
spaces every character counts as a word.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, discard, stored

#: Sentences end at marks before white space, and at line ends.
ENDS = re.compile(r"[.!?]+\s+|[。！？]+\s*|\s*\n\s*")
WORD = re.compile(r"\S+\s*")
#: Thai to Lao, Burmese, Khmer, kana and ideographs.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
DENSE = re.compile(f"[{UNSPACED}]")
DENSE_WORD = re.compile(rf"[{UNSPACED}]\s*|[^\s{UNSPACED}]+\s*")
#: A run has at least so many sentences and words.
SENTENCES, WORDS = 3, 15
#: Sentences of more words are cut into parts of least to most words.
LONG, LEAST, MOST = 12, 4, 16
CACHE_WORDS = 1_000_000
_cuts: dict[str, bool] = {}


def _cuts_after(word: str) -> bool:
    found = _cuts.get(word)
    if found is None:
        if len(_cuts) > CACHE_WORDS:
            _cuts.clear()
        found = _cuts[word] = zlib.crc32(word.strip().lower().encode()) % 4 == 0
    return found


def units(text: str) -> list[str]:
    """The text cut into sentences, with the white space after them, and long ones into parts."""
    out, at = [], 0
    word = WORD if text.isascii() or not DENSE.search(text) else DENSE_WORD
    ends = [m.end() for m in ENDS.finditer(text)]
    for end in [*ends, len(text)]:
        piece = text[at:end]
        at = end
        if not piece:
            continue
        if len(piece) <= (2 * LONG if word is WORD else LONG) or len(words := word.findall(piece)) <= LONG:
            out.append(piece)
            continue
        n, start, here = 0, 0, len(piece) - len(piece.lstrip())
        for w in words:
            here += len(w)
            n += 1
            if n >= LEAST and (n >= MOST or _cuts_after(w)):
                out.append(piece[start:here])
                n, start = 0, here
        if n:
            out.append(piece[start:])
    return out


def runs(pieces: list[str]) -> list[tuple[int, int, bytes]]:
    """(first unit, unit after the last, hash) of the shortest run from every unit that has both minima."""
    import xxhash

    full, joined, sizes = [], [], []
    for i, p in enumerate(pieces):
        if w := p.lower().split():
            full.append(i)
            joined.append(" ".join(w))
            sizes.append(len(w) if p.isascii() or not DENSE.search(p) else len(DENSE_WORD.findall(p)))
    out, end, total = [], 0, 0
    for first in range(len(full)):
        while end < len(full) and (end - first < SENTENCES or total < WORDS):
            total += sizes[end]
            end += 1
        if end - first < SENTENCES or total < WORDS:
            break
        out.append((full[first], full[end - 1] + 1, xxhash.xxh3_128_digest(" \n".join(joined[first:end]))))
        total -= sizes[first]
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each hash, as a long and an int."""
    parts = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return parts[:, 0], (parts[:, 1] >> 32).astype(np.int32)


def _run_table(docs: DataFrame) -> DataFrame:
    """(s, c, d, h, many): the distinct runs of every row, and whether they stand there more than once."""
    schema = ddl("s long, c int, d long, h long, many boolean")

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.name for f in schema]

        def batch(found: list[bytes], owners: list[int], hashes: list[int], many: list[bool]):
            return pa.RecordBatch.from_arrays([*map(pa.array, _halves(found)), pa.array(owners, pa.int64()), pa.array(hashes, pa.int64()), pa.array(many, pa.bool_())], names=names)

        for b in batches:
            found, owners, hashes, many = [], [], [], []
            for d, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                times: dict[bytes, bool] = {}
                for _, _, x in runs(units(text.as_py() or "")):
                    times[x] = x in times
                found += times
                owners += [d] * len(times)
                hashes += [h] * len(times)
                many += times.values()
                if len(found) > 20_000:
                    yield batch(found, owners, hashes, many)
                    found, owners, hashes, many = [], [], [], []
            yield batch(found, owners, hashes, many)

    return docs.select("d", "h", "text").mapInArrow(task, schema)


def _met(table: DataFrame) -> DataFrame:
    """(d, h, s, c, later): the runs that stand more than once, and whether a row is not the first to hold one.

    Rows are ordered by id and, where rows share an id, by the hash of their text.
    """
    groups = table.groupBy("s", "c").agg(F.min("d").alias("first"), F.count("*").alias("n"), F.bool_or("many").alias("many"))
    shared = stored(groups.where("n > 1 or many").select("s", "c", "first"), name="shared-runs")
    met = table.join(shared, ["s", "c"])
    again = stored(table.groupBy("d").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("d"), name="shared-ids")
    later = F.col("d") > F.col("first")
    if not again.isEmpty():
        ties = met.where("d = first").join(again, "d", "left_semi").groupBy("s", "c").agg(F.min("h").alias("least"))
        met = met.join(ties, ["s", "c"], "left")
        later = later | (F.col("h") > F.coalesce("least", "h"))
    return met.select("d", "h", "s", "c", later.alias("later"))


def dedup_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes sentences under repeated runs, save where a run stands first: in the smallest id, at its first place.

    Returns the id, n_sentences, n_repeated (under any repeated run), n_removed, removed (their
    ranges, ends exclusive), kept_sha256 and text (what is left).  Case and the amount of white space do not
    tell runs apart.  Null text counts as empty and long texts are read whole.  Rows without an id come first; rows that
    share an id, or have none, come by the hash of their text.  Rows alike in both can't be told apart: each repeats the
    others, and all keep what stands first in them.  An empty table gives no rows; other columns are ignored.
    """
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col), d.alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    table = stored(_run_table(texts), name="runs")
    runs_of = F.collect_set(F.struct("s", "c", "later")).alias("runs")
    lists = stored(_met(table).groupBy("d", "h").agg(runs_of), name="run-lists")
    discard(table)
    schema = ddl(
        f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_sentences long, n_repeated long, n_removed long, removed string, kept_sha256 string, text string"
    )

    def task(batches):
        for b in batches:
            rows = []
            for doc_id, text, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                text = text.as_py()
                pieces = units(text)
                if not found:
                    rows.append((doc_id, len(pieces), 0, 0, "", hashlib.sha256(text.encode()).hexdigest(), text))
                    continue
                known = {(r["s"], r["c"]): r["later"] for r in found}
                repeated, gone, seen = [False] * len(pieces), [False] * len(pieces), set()
                all_runs = runs(pieces)
                keys = zip(*(x.tolist() for x in _halves([r[2] for r in all_runs])), strict=True)
                for (first, end, _), key in zip(all_runs, keys, strict=True):
                    if (later := known.get(key)) is None:
                        continue
                    later = later or key in seen
                    seen.add(key)
                    for i in range(first, end):
                        repeated[i] = True
                        gone[i] = gone[i] or later
                kept = "".join(p for p, g in zip(pieces, gone, strict=True) if not g)
                starts = [i for i, g in enumerate(gone) if g and not (i and gone[i - 1])]
                ends = [i + 1 for i, g in enumerate(gone) if g and not (i + 1 < len(gone) and gone[i + 1])]
                removed = ",".join(f"{s}-{e}" for s, e in zip(starts, ends, strict=True))
                rows.append((doc_id, len(pieces), sum(repeated), sum(gone), removed, hashlib.sha256(kept.encode()).hexdigest(), kept))
                if len(rows) >= 200:
                    yield batch_of(rows, schema)
                    rows = []
            yield batch_of(rows, schema)

    return texts.join(lists, ["d", "h"], "left").select(id_col, "text", "runs").mapInArrow(task, schema)
