"""Exact substring dedup: byte windows that start in more than one place, by a depth-limited radix sort.

The suffixes at all window starts are told apart most significant part first.  A start's first
digit is the text at its anchor, the least-hashed gram of the window's head: equal windows have
equal anchors, so starts with one anchor move together as a zone, and zones whose anchor text is unique
end there.  Zones that stay are told apart by their whole text; groups of equal zones are repeated
throughout.  Of the rest one zone of each group goes on to the next pass, cut into shorter ranges of starts,
and at last into single windows.  So each pass sees only the borders of repeated passages, and equal
groups are exactly the repeated windows (to a collision of 128-bit hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, discard, stored

GRAM, RANGE = 8, 16
#: Rows that a task hands on at a time.
BATCH = 5_000
_CHUNK = 1 << 20
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64((1 << 24) - 1)


def _head(length: int) -> int:
    """Starts among which an anchor is chosen; the anchor text has length - head + 1 bytes."""
    return length // 2 - GRAM


def zones_of(data: np.ndarray, bounds: list[tuple[int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last starts of every zone, and their anchors, over documents laid end to end."""
    head = _head(length)
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3
    raw = data.tobytes()
    grams = np.ndarray(len(raw) - GRAM + 1, "<u8", raw, strides=(1,)).astype(np.uint64)
    grams *= _C1
    grams ^= grams >> np.uint64(29)
    grams *= _C2
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= head:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if head > width:
        key = np.minimum(key[: len(key) - (head - width)], key[head - width :])
    anchors = (key & _POS).astype(np.int64)
    lows, highs = [], []
    for first, end in bounds:
        last = end - length
        if last >= first:
            turn = np.flatnonzero(np.diff(anchors[first : last + 1])) + first
            lows.append(np.concatenate([[first], turn + 1]))
            highs.append(np.concatenate([turn, [last]]))
    if not lows:
        return (np.empty(0, np.int64),) * 3
    low, high = np.concatenate(lows), np.concatenate(highs)
    return low, high, anchors[low]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _zone_table(docs: DataFrame, length: int) -> DataFrame:
    """Every zone: (d, h, lo, hi, a) and the hashes of its anchor text and of all its text."""
    schema = ddl("d long, h long, lo int, hi int, a int, core long, hull long")
    deep = length - _head(length) + 1

    def task(batches: Iterator) -> Iterator:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            at = 0
            while at < len(ids):
                parts, bounds, size, first = [], [], 0, at
                while at < len(ids) and (not parts or size < _CHUNK):
                    t = (b.column(2)[at].as_py() or "").encode()
                    parts.append(t)
                    bounds.append((size, size + len(t)))
                    size += len(t)
                    at += 1
                for part, shift, count in _split(b"".join(parts), bounds, length):
                    low, high, anchor = zones_of(np.frombuffer(part, np.uint8), count, length)
                    ends = np.array([e for _, e in bounds])
                    owner = np.searchsorted(ends, low + shift, side="right")
                    rows = []
                    for lo, hi, a, o in zip(low.tolist(), high.tolist(), anchor.tolist(), owner.tolist(), strict=True):
                        core = digest(part[a : a + deep])
                        hull = digest(part[lo : hi + length], seed=((a - lo) << 32) + hi - lo)
                        base = bounds[o][0] - shift
                        rows.append((ids[first + o], hashes[first + o], lo - base, hi - base, a - base, _signed(core), _signed(hull)))
                        if len(rows) == BATCH:
                            yield batch_of(rows, schema)
                            rows = []
                    yield batch_of(rows, schema)

    return docs.select("d", "h", "text").mapInArrow(task, schema)


def _split(data: bytes, bounds: list[tuple[int, int]], length: int) -> Iterator[tuple[bytes, int, list[tuple[int, int]]]]:
    """Stretches short enough for 24-bit positions; a longer document is read in overlapping ones."""
    most = 15 << 20
    if len(data) <= most:
        yield data, 0, bounds
        return
    for first, end in bounds:
        for at in range(first, max(first + 1, end - length + 1), most - length + 1):
            stop = min(end, at + most)
            yield data[at:stop], at, [(0, stop - at)]


def _refine(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows (d, h, z, lo, hi, a, core, hull): those in groups of equal hulls, and one of each group
    of those cores that still hold several groups.

    Repeated cores are stored before the rows are joined to them, so Spark can split a core that many rows share.
    """
    cores = stored(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), name=name)
    held = stored(rows.join(cores, "core"), name=name)
    discard(cores)
    groups = stored(
        held.groupBy("core", "hull").agg(F.count("*").alias("n"), F.min(F.struct("d", "h", "z", "lo", "hi", "a")).alias("one")), name=name
    )
    equal = held.join(groups.where("n > 1").select("core", "hull"), ["core", "hull"], "left_semi")
    several = groups.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core")
    rest = groups.join(several, "core", "left_semi").select("one.*")
    return equal.select("d", "h", "lo", "hi"), rest


def _pieces(docs: DataFrame, zones: DataFrame, length: int) -> DataFrame:
    """The bytes of the given zones."""
    schema = ddl("d long, h long, z int, hi int, a int, data binary")
    wanted = zones.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "a"))).alias("zones"))

    def task(batches):
        for b in batches:
            for i in range(b.num_rows):
                d, h, text, found = (b.column(c)[i].as_py() for c in range(4))
                t = text.encode()
                yield batch_of([(d, h, z["lo"], z["hi"], z["a"], t[z["lo"] : z["hi"] + length]) for z in found], schema)

    return docs.join(wanted, ["d", "h"]).select("d", "h", "text", "zones").mapInArrow(task, schema)


def _ranges(pieces: DataFrame, length: int) -> DataFrame:
    """Zones cut into ranges of starts, counted back from the anchor."""
    schema = ddl("d long, h long, z int, lo int, hi int, a int, core long, hull long")

    def task(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rows = []
            for d, h, z, hi, a, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                top = hi
                while top >= z:
                    j = (a - top) // RANGE
                    near, far = a - RANGE * j, a - RANGE * j - RANGE + 1
                    low = max(z, far)
                    core = digest(data[near - z : far - z + length], seed=j)
                    hull = digest(data[low - z : top - z + length], seed=(a - low) << 32 | (a - top))
                    rows.append((d, h, z, low, top, a, _signed(core), _signed(hull)))
                    top = low - 1
                if len(rows) >= BATCH:
                    yield batch_of(rows, schema)
                    rows = []
            yield batch_of(rows, schema)

    return pieces.mapInArrow(task, schema)


def _windows(pieces: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """The single windows of the given ranges, with two hashes."""
    schema = ddl("d long, h long, lo int, one long, two long")
    wanted = ranges.groupBy("d", "h", "z").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))

    def task(batches):
        import xxhash

        for b in batches:
            rows = []
            for d, h, z, data, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in found:
                    for s in range(r["lo"], r["hi"] + 1):
                        x = xxhash.xxh3_128_intdigest(data[s - z : s - z + length])
                        rows.append((d, h, s, _signed(x >> 64), _signed(x & ((1 << 64) - 1))))
                if len(rows) >= BATCH:
                    yield batch_of(rows, schema)
                    rows = []
            yield batch_of(rows, schema)

    return pieces.join(wanted, ["d", "h", "z"]).select("d", "h", "z", "data", "ranges").mapInArrow(task, schema)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents by (d, h): the id, -1 if null, and a hash of id and text."""
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), d.alias("d"), F.xxhash64(F.col(id_col), text).alias("h"), text.alias("text"))


def repeated_intervals(docs: DataFrame, length: int) -> DataFrame:
    """(d, h, start, end) of bytes under repeated windows; intervals may overlap."""
    zones = stored(_zone_table(docs, length), name="zones")
    first, rest = _refine(zones.withColumn("z", F.col("lo")), "zones-1")
    discard(zones)
    pieces = stored(_pieces(docs, rest.select("d", "h", "lo", "hi", "a"), length), name="pieces")
    second, rest = _refine(_ranges(pieces, length), "zones-2")
    windows = stored(_windows(pieces, rest.select("d", "h", "z", "lo", "hi"), length), name="windows")
    twice = windows.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").select("one", "two")
    third = windows.join(twice, ["one", "two"], "left_semi").select("d", "h", "lo", F.col("lo").alias("hi"))
    found = first.union(second).union(third)
    return found.select("d", "h", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Removes every byte under a ``length``-byte string that also starts anywhere else.

    Returns the id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes) and
    kept_sha256.  Strings never cross documents and are judged on the input.  Null text counts as empty;
    texts shorter than ``length`` stay whole; repeated rows count as further places, so each loses what
    they share; an empty table gives no rows; a null id stays null; other columns are ignored.  Very long texts are
    read whole, and repeats inside one count.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length is at least {4 * GRAM}")
    texts = keyed(docs, id_col, text_col)
    found = repeated_intervals(texts, length)
    spans = found.groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    schema = ddl(f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")

    def task(batches):
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                doc_id, text, spans = (b.column(c)[i].as_py() for c in range(3))
                t, kept, at, runs = text.encode(), [], 0, 0
                end = -1
                for s in spans or ():
                    if s["start"] > end:
                        kept.append(t[at : s["start"]])
                        runs += 1
                    end = max(end, s["end"])
                    at = end
                out = b"".join([*kept, t[at:]])
                rows.append((doc_id, len(t), len(t) - len(out), runs, out, hashlib.sha256(out).hexdigest()))
                if len(rows) == 200:
                    yield batch_of(rows, schema)
                    rows = []
            yield batch_of(rows, schema)

    return texts.join(spans, ["d", "h"], "left").select(id_col, "text", "spans").mapInArrow(task, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")
