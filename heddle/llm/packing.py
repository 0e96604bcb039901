"""Hierarchical multi-length packing of documents into context windows.

Documents are routed by length to tiers of window sizes (powers of two).  Whole
windows of the longest tier are cut from long documents; what remains goes to the
smallest tier that holds it.  Tiers are packed from long to short; the gap in a window
is filled from shorter tiers, with a whole document where one fits and else with the
head of one.  Each task packs its own partition as a stream with a bounded buffer, so
nothing is shuffled and nothing waits for the whole table.  The end of a partition is
cut by its binary expansion, so windows are always full.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl

#: Chunks whose ids a worker remembers at most; beyond that it starts anew.
CACHE_WORDS = 1_000_000
#: Chunks that go through the tokenizer as one text.
TOGETHER = 200
_cache: dict[str, dict[str, bytes]] = {}
_tokenizers: dict[str, object] = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    The vocabulary never joins across white space, so each white-space-delimited chunk is
    encoded once per worker.  Texts with U+001C to U+001F, which only Python takes
    for white space, are encoded whole.
    """
    tokenizer, cache = _tokenizer(path), _cache.setdefault(path, {})
    if len(cache) > CACHE_WORDS:
        cache.clear()
    odd = [any(c in t for c in "\x1c\x1d\x1e\x1f") for t in texts]
    chunks = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
    new: set[str] = set()
    for c in chunks:
        new.update(c)
    fresh = [w for w in new if w not in cache]
    parts = [_core_and_tail(w) for w in fresh]
    wanted = [w for w in {x for p in parts for x in p} if w not in cache]
    cache.update(_encoded_apart(wanted, tokenizer))
    get = cache.__getitem__
    cache.update((w, b"".join(map(get, p))) for w, p in zip(fresh, parts, strict=True) if len(p) > 1 or p[0] != w)
    return [
        _pack(tokenizer.encode(t, add_special_tokens=False).ids) if o else b"".join(map(get, c))
        for t, o, c in zip(texts, odd, chunks, strict=True)
    ]


def _encoded_apart(chunks: list[str], tokenizer) -> Iterator[tuple[str, bytes]]:
    """Each chunk with its ids.  Chunks that composing leaves as they are go through the tokenizer ``TOGETHER`` at a time, with spaces
    between, and are told apart by where tokens begin; the others go one by one."""
    plain = [w for w in chunks if w.isascii() or unicodedata.is_normalized("NFC", w)]
    for at in range(0, len(plain), TOGETHER):
        part = plain[at : at + TOGETHER]
        found = tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids, begun, a, end = _pack(found.ids), [o[0] for o in found.offsets], 0, 0
        for w in part:
            end += len(w) + 1
            e = bisect_left(begun, end, a)
            yield w, ids[4 * a : 4 * e]
            a = e
    if len(plain) < len(chunks):
        rest = list(set(chunks).difference(plain))
        for w, e in zip(rest, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            yield w, _pack(e.ids)


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _core_and_tail(chunk: str) -> tuple[str, ...]:
    """A word and its closing marks apart, which the vocabulary never joins; ASCII words in lower case.

    The vocabulary composes and lower-cases first and then parts letters from marks, so a word counts only where it is
    letters alone after that too: \u0130 becomes a letter and a mark, and marks join each other.
    """
    core = chunk.rstrip(".,!?;:|*&#")
    if core != chunk and core.isalpha():
        if core.isascii():
            return (core.lower(), chunk[len(core) :])
        if unicodedata.normalize("NFC", core).lower().isalpha():
            return (core, chunk[len(core) :])
    return (chunk.lower(),) if chunk.isascii() and chunk.isalpha() else (chunk,)


class _Packer:
    """Packs one stream of documents.  Items are (length, number, start, doc_id, ids, total)."""

    def __init__(self, tiers: tuple[int, ...], group_tokens: int, base: int):
        self.tiers, self.top, self.group = sorted(tiers), max(tiers), group_tokens
        self.base, self.sequences, self.dealt = base, 0, 0
        self.held: list[tuple] = []
        self.rows: list[tuple] = []
        self.number = 0

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.top:
            self._emit(self.top, [(self.top, self.number, start, doc_id, ids, total)])
            start += self.top
        if start < total:
            self.held.append((total - start, self.number, start, doc_id, ids, total))
        self.number += 1

    def _emit(self, size: int, items: list[tuple]) -> None:
        seq, offset = self.base + self.sequences, 0
        step = self.base + self.dealt // self.group
        for length, _, start, doc_id, ids, total in items:
            crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
            self.rows.append((doc_id, start, length, crc, total, seq, offset, size, step))
            offset += length
        self.sequences += 1
        self.dealt += size

    def flush(self) -> None:
        """Packs what is held; windows that cannot be filled stay held."""
        pools: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        for item in sorted(self.held, key=lambda x: x[:2]):
            pools[next(t for t in self.tiers if item[0] <= t)].append(item)
        self.held, full = [], []
        for tier in reversed(self.tiers):
            shorter = [t for t in self.tiers if t <= tier][::-1]
            own = pools[tier]
            while own:
                window, gap = [own.pop()], 0
                gap = tier - window[0][0]
                while gap:
                    found = self._fits(pools, shorter, gap)
                    if found is None:
                        break
                    window.append(found)
                    gap -= found[0]
                if gap:
                    self.held += window
                else:
                    full.append((tier, window))
        for tier, window in full:
            self._emit(tier, window)

    def _fits(self, pools: dict[int, list[tuple]], shorter: list[int], gap: int):
        """The longest held item that fits the gap, or the head of the shortest that doesn't."""
        for t in shorter:
            at = bisect_right(pools[t], gap, key=lambda x: x[0])
            if at:
                return pools[t].pop(at - 1)
        for t in reversed(shorter):
            if pools[t]:
                length, number, start, doc_id, ids, total = pools[t].pop(0)
                rest = (length - gap, number, start + gap, doc_id, ids, total)
                insort(pools[next(s for s in self.tiers if rest[0] <= s)], rest, key=lambda x: x[:2])
                return (gap, number, start, doc_id, ids, total)
        return None

    def pour(self, last: bool) -> None:
        """Cuts what is held into full windows of the longest tier; the last rest by powers of two."""
        left, self.held = sorted(self.held, key=lambda x: -x[0])[::-1], []
        amount = sum(x[0] for x in left)
        while amount and (last or amount >= self.top):
            size = min(self.top, 1 << (amount.bit_length() - 1))
            window, gap = [], size
            while gap:
                length, number, start, doc_id, ids, total = left.pop()
                take = min(length, gap)
                window.append((take, number, start, doc_id, ids, total))
                gap -= take
                if take < length:
                    left.append((length - take, number, start + take, doc_id, ids, total))
            self._emit(size, window)
            amount -= size
        self.held = left


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 2,
    tiers: tuple[int, ...] = (512, 1024, 2048, 4096),
    step_tokens: int = 65_536,
    buffer_tokens: int = 1_000_000,
) -> DataFrame:
    """Packs every document; one row per piece.

    Returns the id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length and step_group.  Sequences are full: their length is a tier, or a smaller
    power of two at the end of a partition.  Step groups of a partition hold ``step_tokens``
    tokens each, to within one window.

    Null text counts as empty, and an empty document is its end id alone.  A null id stays
    null; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
    A very long text is encoded whole and cut into windows.
    """
    path = tokenizer_path or default_tokenizer_path()
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers are powers of two")
    end = int(end_id).to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ddl(
        f"{id_col} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, sequence_length long, step_group long"
    )

    def task(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        packer = _Packer(tiers, step_tokens, TaskContext.get().partitionId() << 33)

        def take():
            rows, packer.rows = packer.rows, []
            return batch_of(rows, schema)

        held = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at in range(0, len(doc_ids), 500):
                texts = [t or "" for t in batch.column(1).slice(at, 500).to_pylist()]
                for doc_id, ids in zip(doc_ids[at : at + 500], encode_texts(texts, path), strict=True):
                    packer.add(doc_id, ids + end)
                held = sum(x[0] for x in packer.held)
                if held > buffer_tokens:
                    packer.flush()
                    if sum(x[0] for x in packer.held) > buffer_tokens // 2:
                        packer.pour(last=False)
                if len(packer.rows) > 5_000:
                    yield take()
        packer.flush()
        packer.pour(last=True)
        yield take()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(task, schema)

