"""Scores from a log-bilinear neural language model, trained in numpy with noise-contrastive estimation.

Words have symbols: the most frequent ones their own, the others that of their ending.  Symbols
fall into classes by the company they keep.  The symbols before a word, their vectors, through a matrix for
each place, add up to a prediction.  It is multiplied with the class vectors and normalised over all classes, and with
the vectors of the class's symbols, beside their shares, and normalised over these; the product is
a symbol's probability.  Words that share a symbol have their shares of it by exact counts over all training tokens.  Texts are read twice, to count
and to encode; training and scoring go over the stored symbols.  Each task trains on its
own documents and the parameters are averaged, weighed by how often a task met a symbol.

Counts of frequent words are broadcast, of a stated number at most; those of the others are joined.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ascii_word_bytes, batch_of, ddl, discard, fold, stored

CONTEXT, DIMS, CLASSES, NOISE, DRAWS = 3, 16, 64, 8, 2
#: Words with a symbol, symbols of endings, words whose counts are broadcast, words remembered by a worker.
TOP, ENDINGS, HEAD, CACHE_WORDS = 4_000, 1_024, 200_000, 600_000
#: Neighbours that tell symbols apart, and training rounds, which share out all positions.
NEIGHBOURS, ROUNDS = 128, 2
#: Training tokens of a group, tokens of a piece of a long text, and tasks that train at most.
GROUP_TOKENS, PIECE_TOKENS, MOST_TASKS = 2_000_000, 1 << 16, 20_000
END = b" "  # no word holds a space
PAD = TOP + ENDINGS
SYMBOLS = PAD + 1
NEW = 1 << 40


def key_of(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def keys_of(words: list[bytes]) -> np.ndarray:
    """``key_of`` each word."""
    import xxhash

    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) ^ np.uint64(1 << 63)).view(np.int64)


def ending_of(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?*&#|")[-3:]) % ENDINGS


class Codes(dict):
    """Codes of words; a word met first gets NEW and its place in ``new`` until it has its own."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = NEW + len(self.new)
        self.new.append(word)
        return code


@dataclass
class Parameters:
    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray
    #: Vectors of symbols among their class's, beside their shares.
    u: np.ndarray

    @classmethod
    def start(cls, prior: np.ndarray) -> Parameters:
        rng = np.random.default_rng(7)
        f = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(f(SYMBOLS, DIMS), np.stack([np.eye(DIMS, dtype=np.float32)] * CONTEXT), f(CLASSES, DIMS), np.log(prior).astype(np.float32), np.zeros((SYMBOLS, DIMS), np.float32))

    def copy(self) -> Parameters:
        return Parameters(*(v.copy() for v in (self.r, self.c, self.q, self.b, self.u)))


class Members:
    """The symbols of each class, their shares, and draws by these shares in constant time (alias tables)."""

    def __init__(self, classes: np.ndarray, share: np.ndarray):
        self.classes, self.order = classes, np.argsort(classes, kind="stable")
        self.first = np.searchsorted(classes[self.order], np.arange(CLASSES + 1))
        self.size = np.diff(self.first)
        self.place = np.empty(SYMBOLS, np.int64)
        self.place[self.order] = np.arange(SYMBOLS) - self.first[classes[self.order]]
        self.log_share = (share * math.log(10)).astype(np.float32)
        self.keep, self.other = np.ones(SYMBOLS), np.arange(SYMBOLS)
        for c in range(CLASSES):
            a, n = self.first[c], self.size[c]
            left = 10 ** share[self.order[a : a + n]] * n
            small, large = ([i for i in range(n) if (left[i] < 1) == low] for low in (True, False))
            while small and large:
                i, j = small.pop(), large[-1]
                self.keep[a + i], self.other[a + i] = left[i], a + j
                left[j] -= 1 - left[i]
                if left[j] < 1:
                    small.append(large.pop())

    def draw(self, classes: np.ndarray, rng) -> np.ndarray:
        """DRAWS symbols of each class by their shares."""
        at = rng.random((len(classes), DRAWS)) * self.size[classes][:, None]
        slot = at.astype(np.int64)
        at -= slot
        slot += self.first[classes][:, None]
        return self.order[np.where(at < self.keep[slot], slot, self.other[slot])]


@dataclass
class Model:
    """What scoring needs; ``head`` are frequent words' keys, sorted, with their counts and symbols."""

    tokens: int
    distinct: int
    head: np.ndarray
    head_n: np.ndarray
    head_symbol: np.ndarray
    classes: np.ndarray
    #: log10 of a symbol's share of its class, and of the weight of its words (0 for a word's own symbol).
    share: np.ndarray
    weight: np.ndarray
    #: How often each symbol stands in the training texts.
    times: np.ndarray
    parameters: Parameters | None = None
    _codes: Codes | None = field(default=None, repr=False)
    #: Keys and symbols of the other words that the worker has met, and how many of their places are taken.
    _tail: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)
    _met: int = 0

    def base(self, n):
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Places in ``head``, or -1 less a place in the worker's list of other words."""
        if self._codes is None or len(self._codes) > CACHE_WORDS:
            self._codes, self._tail, self._met = Codes(), (np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)), 0
        known = self._codes
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        new, known.new = known.new, []
        if new:
            keys = keys_of(new)
            at = np.searchsorted(self.head, keys)
            hit = (at < len(self.head)) & (self.head[np.minimum(at, max(0, len(self.head) - 1))] == keys) if len(self.head) else np.zeros(len(new), bool)
            found = np.where(hit, at, -self._met - np.cumsum(~hit))
            self._remember(keys[~hit], [TOP + ending_of(w) for w, h in zip(new, hit.tolist(), strict=True) if not h])
            known.update(zip(new, found.tolist(), strict=True))
            fresh = codes >= NEW
            codes[fresh] = found[codes[fresh] - NEW]
        return codes

    def _remember(self, keys: np.ndarray, symbols: list[int]) -> None:
        end = self._met + len(keys)
        while end > len(self._tail[0]):
            self._tail = tuple(np.concatenate([a, np.zeros_like(a)]) for a in self._tail)
        self._tail[0][self._met : end], self._tail[1][self._met : end] = keys, symbols
        self._met = end

    def tail_keys(self, codes: np.ndarray) -> np.ndarray:
        return self._tail[0][-1 - codes]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int64)
        inside = codes >= 0
        out[inside] = np.take(self.head_symbol, codes[inside])
        out[~inside] = self._tail[1][-1 - codes[~inside]]
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and symbols of texts laid end to end, and each text's first token."""
        words: list[bytes] = []
        starts = [0]
        for t in texts:
            if t:
                words += ascii_word_bytes(t)
            words.append(END)
            starts.append(len(words))
        codes = self.codes(words)
        return codes, self.symbols(codes), np.array(starts)


def contexts_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and contexts of stored texts laid end to end, and each text's first token."""
    starts = np.cumsum([0, *(len(x) // 2 for x in parts)])
    symbols = np.frombuffer(b"".join(parts), "<u2").astype(np.int32)
    place = np.arange(len(symbols)) - np.repeat(starts[:-1], np.diff(starts))
    contexts = np.full((len(symbols), CONTEXT), PAD, np.int32)
    for i in range(CONTEXT):
        contexts[i + 1 :, i] = symbols[: max(0, len(symbols) - i - 1)]
        contexts[place <= i, i] = PAD
    return symbols, contexts, starts


def log_classes(p: Parameters, contexts: np.ndarray, classes: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """log10 of the normalised probability of each class, in blocks of matrix products."""
    h = predicted(tables(p), contexts) if h is None else h
    out = np.empty(len(contexts))
    small = _small(h, p.q, p.b)
    for at in range(0, len(contexts), 2048):
        part = h[at : at + 2048]
        s = part @ p.q.T
        s += p.b
        if not small:
            s -= s.max(1, keepdims=True)
        own = s[np.arange(len(part)), classes[at : at + 2048]]
        np.exp(s, out=s)
        out[at : at + 2048] = (own - np.log(s @ np.ones(CLASSES, np.float32))) / math.log(10)
    return out


def _small(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no product of rows with vectors, with a bias, leaves what 32-bit exponentials hold; then no maximum need be taken out."""
    longest = lambda m: float(np.sqrt(np.einsum("nd,nd->n", m, m).max(initial=0)))
    return longest(h) * longest(vectors) + float(np.abs(bias).max(initial=0)) < 60


def predicted(table: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    h = np.take(table[0], contexts[:, 0], axis=0)
    for i in range(1, CONTEXT):
        h += np.take(table[i], contexts[:, i], axis=0)
    return h


def log_members(p: Parameters, h: np.ndarray, symbols: np.ndarray, members: Members) -> np.ndarray:
    """log10 of each symbol's probability given its class, normalised over the class, in a matrix product a class."""
    out = np.empty(len(symbols))
    small = _small(h, p.u, members.log_share)
    own = members.classes[symbols]
    order = np.argsort(own.astype(np.uint16), kind="stable")
    ends = np.searchsorted(own[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        among = members.order[members.first[c] : members.first[c + 1]]
        for at in range(ends[c], ends[c + 1], 2048):
            rows = order[at : min(at + 2048, ends[c + 1])]
            s = np.take(h, rows, axis=0) @ np.take(p.u, among, axis=0).T
            s += members.log_share[among]
            if not small:
                s -= s.max(1, keepdims=True)
            one = s[np.arange(len(rows)), members.place[symbols[rows]]]
            np.exp(s, out=s)
            out[rows] = (one - np.log(s @ np.ones(len(among), np.float32))) / math.log(10)
    return out


def tables(p: Parameters) -> np.ndarray:
    """Each symbol's part of a prediction, by place."""
    return np.stack([p.r @ p.c[i] for i in range(CONTEXT)])


def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the sums of their rows, and how many each has."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # SYMBOLS fit 16 bits, which numpy sorts by radix
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    pairs = np.take(rows, order, axis=0).view(np.complex64 if rows.dtype == np.float32 else np.complex128)  # two sums at once
    return keys[starts], np.add.reduceat(pairs, starts, axis=0).view(rows.dtype), np.diff(starts, append=len(keys))


def sigmoid(x: np.ndarray) -> None:
    """1 / (1 + exp(x)), in place."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def adagrad(value: np.ndarray, past: np.ndarray, step: np.ndarray, rate: float, at=...) -> None:
    total = step * step
    total += past[at]
    past[at] = total
    np.sqrt(total, out=total)
    np.divide(step, total, out=total)
    total *= rate
    value[at] += total


def train(p: Parameters, contexts: np.ndarray, classes: np.ndarray, noise: np.ndarray, rng, seen: np.ndarray, state: dict, batch: int = 2048, rate: float = 0.1, words: tuple | None = None) -> None:
    """One pass of noise-contrastive estimation with AdaGrad steps, in place.

    All classes have their scores, so the noise counts by its expectation, NOISE times a class's probability, not by
    draws.  ``words`` are the symbols that follow, the members of the classes and how often a symbol's
    vector has moved: a symbol is told from DRAWS others of its class, drawn by their shares.
    """
    if not state:
        state |= {name: np.full_like(getattr(p, name), 1e-2) for name in ("r", "c", "q", "b", "u")}
    expected = (NOISE * noise).astype(np.float32)
    log_noise = np.log(expected)
    for at in range(0, len(contexts), batch):
        x, y = contexts[at : at + batch], classes[at : at + batch]
        rows = np.arange(len(x))
        r = np.take(p.r, x.T, axis=0)
        h = r[0] @ p.c[0]
        for i in range(1, CONTEXT):
            h += r[i] @ p.c[i]
        odds = h @ -p.q.T
        odds += log_noise - p.b
        sigmoid(odds)
        g = odds * -expected
        g[rows, y] += 1 - odds[rows, y]
        dh = g @ p.q
        if words is not None:
            symbols, members, moved = words
            both = np.concatenate([symbols[at : at + batch, None], members.draw(y, rng)], 1)
            u = np.take(p.u, both, axis=0)
            own = math.log(DRAWS) - np.einsum("nkd,nd->nk", u, h)
            sigmoid(own)
            np.negative(own, out=own)
            own[:, 0] += 1
            dh += np.einsum("nk,nkd->nd", own, u)
            met, du, times = summed(both.ravel(), (own[:, :, None] * h[:, None, :]).reshape(-1, DIMS))
            adagrad(p.u, state["u"], du, rate, met)
            moved[met] += times
        met, dr, times = summed(x.T.ravel(), np.concatenate([dh @ p.c[i].T for i in range(CONTEXT)]))  # the other symbols don't move
        adagrad(p.c, state["c"], np.stack([r[i].T @ dh for i in range(CONTEXT)]), rate)
        adagrad(p.q, state["q"], g.T @ h, rate)
        adagrad(p.b, state["b"], np.ones(len(g), g.dtype) @ g, rate)
        adagrad(p.r, state["r"], dr, rate, met)
        seen[met] += times


def _counts(texts: DataFrame) -> DataFrame:
    """(key, ending, n) of every distinct token of the training texts."""
    schema = ddl("key long, ending int, n long")

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: Counter[bytes] = Counter()

        def take():
            words, n = list(found), list(found.values())
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                columns = [pa.array(keys_of(part)), pa.array(map(ending_of, part), pa.int32()), pa.array(n[at : at + 20_000], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            found.clear()

        for b in batches:
            for t in b.column(0):
                found.update(ascii_word_bytes(t.as_py() or ""))
            found[END] += b.num_rows
            if len(found) > 400_000:
                yield from take()
        yield from take()

    return texts.select("text").mapInArrow(task, schema).groupBy("key", "ending").agg(F.sum("n").alias("n"))


def targets(n: int, number: int) -> np.ndarray:
    """Which of ``n`` positions the round predicts; the rounds predict each once."""
    return np.arange(number, n, ROUNDS)


def _classes(read: DataFrame) -> np.ndarray:
    """A class for every symbol, by k-means over the neighbours that it has in the training texts."""
    schema = ddl("symbol int, near int, n long")

    def task(batches):
        width = NEIGHBOURS + 1
        seen = np.zeros(SYMBOLS * width, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                s, x, _ = contexts_of(b.column(0).slice(at, 200).to_pylist())
                for i in range(2):
                    ok = x[:, i] != PAD
                    one, two = s[ok], x[ok, i]
                    np.add.at(seen, one * width + np.minimum(two, NEIGHBOURS), 1)
                    np.add.at(seen, two * width + np.minimum(one, NEIGHBOURS), 1)
        full = np.flatnonzero(seen)
        for at in range(0, len(full), 20_000):
            part = full[at : at + 20_000]
            yield batch_of(list(zip((part // width).tolist(), (part % width).tolist(), seen[part].tolist(), strict=True)), schema)

    seen = np.zeros((SYMBOLS, NEIGHBOURS + 1))
    rows = read.mapInArrow(task, schema).groupBy("symbol", "near").agg(F.sum("n").alias("n")).toArrow()  # at most symbols times neighbours
    seen[rows["symbol"].to_numpy(), rows["near"].to_numpy()] = rows["n"].to_numpy()
    size = seen.sum(1)
    x = np.sqrt(seen / np.maximum(size, 1)[:, None])
    rng, weight = np.random.default_rng(3), np.sqrt(size) + 1e-6
    centers = x[rng.choice(SYMBOLS, CLASSES, replace=False, p=weight / weight.sum())]
    for _ in range(20):
        own = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x * weight[:, None])
        total = np.bincount(own, weight, minlength=CLASSES)
        centers = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-9)[:, None], centers)
    return own


def _groups(read: DataFrame, number: int) -> DataFrame:
    """(group, symbols, lengths, leads): training texts, long ones in pieces after the symbols before them, in groups by hash and in its order.  Stored."""
    schema = ddl("group int, symbols binary, lengths binary, leads binary")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("symbols") / 2 - 1).cast("int"), F.lit(PIECE_TOKENS))).alias("at")
    rows = read.select(F.xxhash64("id", "symbols").alias("key"), "symbols", at)
    lead = F.least("at", F.lit(CONTEXT))
    part = F.substring("symbols", 2 * (F.col("at") - lead) + 1, 2 * (lead + PIECE_TOKENS))
    pieces = rows.select("key", "at", lead.alias("lead"), part.alias("symbols"), F.pmod(F.xxhash64("key", "at"), F.lit(number)).cast("int").alias("group"))

    def together(frame):
        import pandas as pd

        f = frame.sort_values(["key", "at", "symbols"])
        lengths, leads = f["symbols"].map(len).to_numpy("<i4"), f["lead"].to_numpy("u1")
        return pd.DataFrame([(int(f["group"].iloc[0]), b"".join(f["symbols"]), lengths.tobytes(), leads.tobytes())], columns=schema.names)

    return stored(pieces.groupBy("group").applyInPandas(together, schema), name="groups")  # a group has a stated size


def _texts(row: dict) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The pieces of a group, 500 at a time, and how many symbols before each are context alone."""
    ends, leads = np.cumsum(np.frombuffer(row["lengths"], "<i4")), np.frombuffer(row["leads"], "u1")
    for at in range(0, len(ends), 500):
        some = range(at, min(at + 500, len(ends)))
        yield [row["symbols"][ends[i - 1] if i else 0 : ends[i]] for i in some], leads[at : at + 500]


def _trained(read: DataFrame, members: Members, prior: np.ndarray, tokens: int) -> Parameters:
    p = Parameters.start(prior)
    names = [f"v{i}" for i in range(DIMS)]
    schema = ddl("kind int, id int, w double, " + ", ".join(f"{v} double" for v in names))
    sc = read.sparkSession.sparkContext
    shared = sc.broadcast(members)
    number = max(1, math.ceil(tokens / GROUP_TOKENS))
    groups = _groups(read, number)
    for turn in range(ROUNDS):
        sent = sc.broadcast(p)

        def task(batches, sent=sent, turn=turn):
            members = shared.value
            for row in (b.slice(j, 1).to_pylist()[0] for b in batches for j in range(b.num_rows)):
                p = sent.value.copy()
                rng, seen, moved, state = np.random.default_rng([turn, row["group"]]), np.zeros(SYMBOLS), np.zeros(SYMBOLS), {}
                for parts, leads in _texts(row):
                    s, x, starts = contexts_of(parts)
                    place = np.arange(len(s)) - np.repeat(starts[:-1], np.diff(starts))
                    pick = targets(len(s), turn)
                    pick = pick[place[pick] >= np.repeat(leads, np.diff(starts))[pick]]
                    train(p, x[pick], members.classes[s[pick]], prior, rng, seen, state, words=(s[pick], members, moved))
                total = float(seen.sum())
                if total:
                    rows = [(0, int(i), float(seen[i]), *map(float, p.r[i])) for i in np.flatnonzero(seen)]
                    rows += [(1, i, total, *map(float, v)) for i, v in enumerate(p.c.reshape(-1, DIMS))]
                    rows += [(2, i, total, *map(float, v)) for i, v in enumerate(p.q)]
                    rows += [(3, i, total, *map(float, v)) for i, v in enumerate(p.b.reshape(-1, DIMS))]
                    rows += [(4, int(i), float(moved[i]), *map(float, p.u[i])) for i in np.flatnonzero(moved)]
                    yield batch_of(rows, schema)

        mean = [(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(v) for v in names]
        found = groups.repartition(min(number, MOST_TASKS)).mapInArrow(task, schema).groupBy("kind", "id").agg(*mean).collect()  # one for each symbol and vector
        p = p.copy()
        parts = [p.r, p.c.reshape(-1, DIMS), p.q, p.b.reshape(-1, DIMS), p.u]
        for row in found:
            parts[row.kind][row.id] = row[2:]
        sent.destroy()
    discard(groups)
    return p


def count(docs: DataFrame, *, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all given texts as far as counts make it, and the table of all counts (key, n)."""
    counts = stored(_counts(docs.select(F.col(text_col).alias("text"))), name="word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    sizes = counts.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("n")).collect()
    least, held = 1 << 62, 0
    for r in sizes:
        if held + r.k > HEAD:
            break
        least, held = r.n, held + r.k
    head = counts.where(F.col("n") >= least).toArrow().to_pandas().sort_values(["n", "key"], ascending=[False, True])  # HEAD rows at most
    head["symbol"] = np.where(np.arange(len(head)) < TOP, np.arange(len(head)), TOP + head["ending"])
    top = head[:TOP]
    words, kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    for r in counts.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        words[TOP + r.ending], kinds[TOP + r.ending] = r.n, r.k
    np.subtract.at(words, TOP + top["ending"].to_numpy(), top["n"].to_numpy())
    np.subtract.at(kinds, TOP + top["ending"].to_numpy(), 1)
    words[: len(top)] = top["n"]
    weight = np.where(np.arange(SYMBOLS) < TOP, 0.0, -np.log10(words + 0.5 * (kinds + 1)))
    by_key = head.sort_values("key")
    nothing = np.zeros(SYMBOLS)
    model = Model(total.n, total.v, *(by_key[c].to_numpy(np.int64) for c in ("key", "n", "symbol")), nothing.astype(int), nothing, weight, words)
    return model, counts.select("key", "n")


def encode(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None) -> DataFrame:
    """Per text: row, id, train, n_tokens, n_head, base, word (both of frequent words), tail (the others) and symbols."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ddl(
        f"row long, id {id_type}, train boolean, n_tokens long, n_head long, base double, word double, tail array<struct<key:bigint,n:int>>, symbols binary"
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        m, row = shared.value, TaskContext.get().partitionId() << 33
        # The last place is that of words outside the head.
        base = np.append(m.base(m.head_n), -math.log10(m.tokens + 0.5 * (m.distinct + 1)))
        word = np.append(np.where(m.head_symbol < TOP, 0.0, np.log10(m.head_n + 0.5) + m.weight[m.head_symbol]), 0.0)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                codes, symbols, starts = m.read(part.column(1).to_pylist())
                inside = codes >= 0
                outside = np.flatnonzero(~inside)
                places = codes.copy()
                places[outside] = len(base) - 1
                second = np.take(word, places)
                second[outside] = m.weight[symbols[outside]]
                one, two, known = (np.add.reduceat(v, starts[:-1]) for v in (np.take(base, places), second, inside.astype(np.int64)))
                owner = np.searchsorted(starts, outside, side="right") - 1
                pairs, times = np.unique(owner << 40 | -1 - codes[outside], return_counts=True)  # a text and the place of a word
                keys = m.tail_keys(-1 - (pairs & (1 << 40) - 1))
                tail = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(times, pa.int32())], names=["key", "n"])
                ends = pa.array(np.searchsorted(pairs >> 40, np.arange(part.num_rows + 1)), pa.int32())
                packed = pa.py_buffer(symbols.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + part.num_rows)), part.column(0), part.column(2), pa.array(np.diff(starts)), pa.array(known), pa.array(one), pa.array(two),
                        pa.ListArray.from_arrays(ends, tail), pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * starts).astype("<i4").tobytes()), packed]),
                    ],
                    names=schema.names,
                )
                row += part.num_rows

    train = F.lit(False) if train is None else train
    return stored(docs.select(F.col(id_col), F.col(text_col), train).mapInArrow(task, schema), name="encoded")


def learn(model: Model, encoded: DataFrame) -> None:
    """Gives the model its classes and parameters, from the rows of ``encoded`` marked ``train``."""
    if not model.tokens:
        return
    read = encoded.where("train").select("id", "symbols")
    model.classes = _classes(read.select("symbols"))
    sums = np.bincount(model.classes, model.times, minlength=CLASSES)
    each = np.bincount(model.classes, minlength=CLASSES)
    model.share = np.log10((model.times + 0.5) / (sums + 0.5 * each)[model.classes])
    model.parameters = _trained(read, Members(model.classes, model.share), (sums + 1) / (sums + 1).sum(), model.tokens)


def fit(docs: DataFrame, *, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all given texts, and the table of all counts (key, n)."""
    model, counts = count(docs, text_col=text_col)
    learn(model, encode(docs, model, id_col=text_col, text_col=text_col, train=F.lit(True)))
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: id, n_tokens, n_known, train_tokens, base_score and score, both log10 probabilities.

    A token is a word, A-Z in lower case, or the end of the text.  Null text is empty: its end alone.  A model
    of no texts gives every token the base's probability.  Repeated rows get a row each, an empty table gives
    none, a null id stays null; other columns are ignored.  Very long texts are scored whole; for training they are cut
    into pieces that keep the symbols before them.
    """
    return scored(encode(docs, model, id_col=id_col, text_col=text_col), model, counts, id_col=id_col)


def scored(encoded: DataFrame, model: Model, counts: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """The scores of encoded texts, as of ``score``."""
    parameters, classes, share = model.parameters, model.classes, model.share
    shared = encoded.sparkSession.sparkContext.broadcast((parameters, Members(classes, share) if parameters else None))
    held = encoded.select("row", "id", "n_tokens", "n_head", "base", "word", "tail", "symbols")
    schema = ddl(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]) + ", model double")

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        parameters, members = shared.value
        table = tables(parameters) if parameters else None
        for b in batches:
            found = np.empty(b.num_rows)
            for at in range(0, b.num_rows, 200):
                if table is None:
                    found[at : at + 200] = b.column(4).slice(at, 200).to_numpy()
                    continue
                s, x, starts = contexts_of(b.column(7).slice(at, 200).to_pylist())
                h = predicted(table, x)
                each = log_classes(parameters, x, members.classes[s], h) + log_members(parameters, h, s, members)
                found[at : at + 200] = np.add.reduceat(each, starts[:-1]) + b.column(5).slice(at, 200).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found)], names=[*b.schema.names[:-1], "model"])

    read = stored(held.mapInArrow(task, schema), name="scored")
    tail = read.select("row", F.explode("tail").alias("t")).select("row", "t.key", F.col("t.n").alias("k"))
    tail = tail.join(counts, "key", "left").groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("add"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more")
    )
    add = F.coalesce("add", F.lit(0.0))
    return read.join(tail, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_head") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + add).alias("base_score"),
        (F.col("model") + add).alias("score"),
    )


def held_out_query(docs: DataFrame) -> DataFrame:
    """Learns from documents outside fold 1 and scores all."""
    model, counts = count(docs.where(fold() != 1))
    encoded = encode(docs, model, train=fold() != 1)
    learn(model, encoded)
    return scored(encoded, model, counts).select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
