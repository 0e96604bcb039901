"""Toxicity from a lexicon matched with spelling errors, weighed by context.

A trie of terms is intersected with Levenshtein automata: a state is a set of (trie
node, errors) pairs, and transitions are made once and kept, so a word costs a lookup per
character.  Terms are whole words, which may be misspelled, or stems, which may not.  A hit
counts as quoted between quotation marks and as direct near a word of address; a logistic model of
such counts gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, fold, free_name, id_or_text

#: Terms known before any label is read.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "bastard")
#: Words that address somebody.
ADDRESS = frozenset("you your you're youre u ur du dich dir dein deine tu te toi ton ta vous votre tú ti tus usted".split())
#: Marks that open a quotation, and those that close it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "‚": "‘’", "‹": "›", "›": "‹"}
MARKS = frozenset("".join([*QUOTES, *QUOTES.values()]))
#: Words in a quotation at most; an opening mark that isn't closed by then quotes nothing.
QUOTED = 60
TOKEN = re.compile(r"[\w*@$]+")
WINDOW, NEAR = 20, 3
CACHE_WORDS = 1_000_000
FEATURES = 10
TERM, STEM, MISSPELLED = 0, 1, 2
#: For too few labels; after the intercept in the order of ``Lexicon.features``.
DEFAULT_WEIGHTS = (-4.0, 4.0, 1.0, 2.0, 1.0, 2.0, -1.0, 0.0, 1.0, 1.0, 0.1)


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Accepts words within the allowed edits of a term, or that begin with a stem.

    Edits are insertion, deletion, substitution and exchange of neighbours.
    """

    def __init__(self, terms: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.limit: list[int] = [0]
        self.ends: dict[int, int] = {}
        self.stem_ends: set[int] = set()
        for word, most, stem in [*((t, errors_allowed(t), False) for t in terms), *((s, 0, True) for s in stems)]:
            node = 0
            self.limit[0] = max(self.limit[0], most)
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.limit.append(0)
                node = self.next[node][c]
                self.limit[node] = max(self.limit[node], most)
            if stem:
                self.stem_ends.add(node)
            else:
                self.ends[node] = max(most, self.ends.get(node, 0))
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        #: What a word that ends in the state is; STEM holds whatever follows.
        self.found: list[int | None] = []
        self.dead = self._state(set())
        self.start = self._state({(0, 0, "")})

    def _state(self, found: set[tuple[int, int, str]]) -> int:
        """Closes a set under deletion and gives its number."""
        todo, best = list(found), {}
        while todo:
            node, e, wait = todo.pop()
            if e > self.limit[node] or best.get((node, wait), 9) <= e:
                continue
            best[node, wait] = e
            if not wait:
                todo += [(child, e + 1, "") for child in self.next[node].values()]
        key = frozenset((n, e, w) for (n, w), e in best.items())
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            errors = min((e for n, e, w in key if not w and e <= self.ends.get(n, -1)), default=None)
            stem = any(n in self.stem_ends and e == 0 and not w for n, e, w in key)
            self.found.append(STEM if stem else None if errors is None else MISSPELLED if errors else TERM)
        return self.known[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, wait in self.sets[state]:
            if wait:
                if wait == c:
                    out.add((node, e, ""))
                continue
            out.add((node, e + 1, ""))
            for d, child in self.next[node].items():
                out.add((child, e + (c != d), ""))
                if c != d and c in self.next[child]:
                    out.add((self.next[child][c], e + 1, d))
        to = self._state(out)
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> int | None:
        """TERM, STEM or MISSPELLED (a term), or None."""
        state, moves, found, dead = self.start, self.moves, self.found, self.dead
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state == dead or found[state] == STEM:
                break
        return found[state]


@dataclass
class Lexicon:
    """Terms, stems, and words that look like misspelled terms but are seen in clean texts."""

    terms: list[str]
    stems: list[str]
    spared: frozenset[str] = frozenset()
    _automaton: Automaton | None = field(default=None, repr=False)
    _codes: dict[str, tuple] = field(default_factory=dict, repr=False)
    _seen: set[str] = field(default_factory=set, repr=False)
    _hits: set[str] = field(default_factory=set, repr=False)

    def match(self, word: str) -> int | None:
        if self._automaton is None:
            self._automaton = Automaton(self.terms, self.stems)
        return None if word in self.spared else self._automaton.match(word)

    def _read(self, chunk: str) -> None:
        """Keeps the code of a white-space-delimited chunk that isn't plain: terms, stems,
        misspelled terms, quotation marks (and whether each may open or close), address.

        A mark with a letter or digit on either side is an apostrophe.
        """
        words = [chunk] if chunk.isalnum() else TOKEN.findall(chunk)
        hits = [h for w in words if (h := self.match(w)) is not None]
        marks = ()
        if not MARKS.isdisjoint(chunk):
            inner = [i for i, c in enumerate(chunk) if c.isalnum()] or [len(chunk), -1]
            marks = tuple((c, i < inner[0], i > inner[-1]) for i, c in enumerate(chunk) if c in MARKS and (i < inner[0] or i > inner[-1]))
        address = any(w in ADDRESS for w in words)
        if hits or marks or address:
            self._codes[chunk] = (*(hits.count(k) for k in (TERM, STEM, MISSPELLED)), marks, int(address))
        if hits:
            self._hits.add(chunk)

    def features(self, text: str | None) -> list[float]:
        """Counts of hits outside quotations, of quoted ones, of those beside quotations, of direct ones, and how dense they are."""
        chunks = text.lower().split() if text else []
        distinct = set(chunks)
        for c in distinct - self._seen:
            self._read(c)
        self._seen |= distinct
        if distinct.isdisjoint(self._hits):
            found = None
        else:
            codes = [self._codes.get(c, _PLAIN) for c in chunks]
            found = self._weigh(codes)
        if len(self._seen) > CACHE_WORDS:
            for kept in (self._seen, self._hits, self._codes):
                kept.clear()
        return found or [0.0] * FEATURES

    def _weigh(self, codes: list[tuple]) -> list[float]:
        at = [i for i, c in enumerate(codes) if any(c[:3])]
        quoted = quotations(codes)
        free = [i for i in at if i not in quoted]
        terms, stems, misspelled = (sum(codes[i][k] for i in free) for k in (TERM, STEM, MISSPELLED))
        cited = sum(sum(codes[i][:3]) for i in at if i in quoted)
        beside = sum(not quoted.isdisjoint(range(i - NEAR, i + NEAR + 1)) for i in free)
        near = sum(any(c[4] for c in codes[max(0, i - NEAR) : i + NEAR + 1]) for i in free)
        dense, left = 0, 0
        for right, i in enumerate(free):
            while i - free[left] >= WINDOW:
                left += 1
            dense = max(dense, right - left + 1)
        logs = [float(np.log1p(v)) for v in (terms, stems, misspelled, cited, beside, near, dense)]
        share = 100 * (terms + stems + misspelled) / (len(codes) + 20)
        return [float(terms > 0), logs[0], float(stems > 0), logs[1], *logs[2:], share]


_PLAIN = (0, 0, 0, (), 0)


def quotations(codes: list[tuple]) -> set[int]:
    """Places of chunks from an opening mark to one that closes it, ``QUOTED`` chunks at most."""
    quoted: set[int] = set()
    opened: dict[str, int] = {}
    for i, c in enumerate(codes):
        for mark, may_open, may_close in c[3]:
            by = [o for o, at in opened.items() if mark in QUOTES[o] and i - at < QUOTED] if may_close else []
            if by:
                first = max(by, key=opened.__getitem__)
                quoted.update(range(opened.pop(first), i + 1))
            elif may_open and mark in QUOTES:
                opened[mark] = i
    return quoted


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        x = np.array([1.0, *self.lexicon.features(text)])
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights of a ridge-penalised logistic model, by Newton's method; the first is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-3, *[penalty] * (x.shape[1] - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows_per_class: int = 10_000,
    least_docs: int = 6,
    least_ratio: float = 20.0,
    most_terms: int = 300,
) -> Model:
    """Learns terms and weights from about ``rows_per_class`` labelled documents of each class.

    The rows are those with the smallest hashes of their ids, each distinct text once.  One half
    of them gives the terms and the spared words, the other the weights.  Their ids are
    broadcast: there are about twice ``rows_per_class`` of them at any size.  With no labelled rows the
    terms are ``SEED_TERMS`` and the weights fixed.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(Lexicon(list(SEED_TERMS), []), np.array(DEFAULT_WEIGHTS))
    share = F.when(F.col("y") == 1, min(1.0, rows_per_class / sizes[1])).otherwise(min(1.0, rows_per_class / sizes[0]))
    hashed = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    picked = known.where(hashed < share * (1 << 30)).select(id_col, "y")
    sample = (
        docs.select(F.col(id_col), F.col(text_col).alias("text"))
        .where("text is not null")
        .join(F.broadcast(picked), id_col)
        .groupBy(F.xxhash64("text").alias("h"))
        .agg(F.first("text").alias("text"), F.max("y").alias("y"))
        .select("text", "y", F.pmod("h", F.lit(2)).cast("int").alias("half"))
        .repartition(max(8, docs.sparkSession.sparkContext.defaultParallelism))
        .persist()
    )
    try:
        return _fit(sample, least_docs, least_ratio, most_terms)
    finally:
        sample.unpersist()


def _fit(sample: DataFrame, least_docs: int, least_ratio: float, most_terms: int) -> Model:
    n = {(r.y, r.half): r.n for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get((1, 0), 0), n.get((0, 0), 0)
    schema = ddl("term string, n1 long, n0 long")

    def count(batches):
        found: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {w for w in TOKEN.findall(text.lower()) if len(w) >= 4}
                for t in words | {w[:k] + "*" for w in words for k in range(4, min(9, len(w) + 1))}:
                    found.setdefault(t, [0, 0])[1 - y] += 1
        rows = [(t, a, b) for t, (a, b) in found.items()]
        for at in range(0, len(rows), 50_000):
            yield batch_of(rows[at : at + 50_000], schema)

    ratio = ((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1))
    counts = sample.where("half = 0").select("text", "y").mapInArrow(count, schema).groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    strong = counts.where((F.col("n1") >= max(least_docs, 0.001 * n1)) & (ratio >= least_ratio)).orderBy(F.desc("n1"), "term").limit(20 * most_terms).collect()
    terms, stems = set(SEED_TERMS), []
    whole = {r.term: r.n1 for r in strong if not r.term.endswith("*")}
    for r in sorted((r for r in strong if r.term.endswith("*")), key=lambda r: (len(r.term), r.term)):
        s = r.term[:-1]
        if not any(s.startswith(x) for x in stems) and r.n1 >= 1.5 * max((c for t, c in whole.items() if t.startswith(s)), default=0):
            stems.append(s)
    support = {r.term[:-1]: r.n1 for r in strong if r.term.endswith("*")}
    stems = sorted(sorted(stems), key=lambda s: -support[s])[:most_terms]
    terms |= set([r.term for r in strong if r.term in whole and not any(r.term.startswith(s) for s in stems)][:most_terms])
    lexicon = Lexicon(sorted(terms), sorted(stems))

    spared_schema = ddl("word string")

    def clean_words(batches):
        seen: set[str] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(TOKEN.findall(text.lower()))
        yield batch_of([(w,) for w in seen if lexicon.match(w) == MISSPELLED], spared_schema)

    clean = sample.where("half = 0 and y = 0").select("text").mapInArrow(clean_words, spared_schema).distinct()
    lexicon = Lexicon(lexicon.terms, lexicon.stems, frozenset(r.word for r in clean.collect()))
    x_schema = ddl("y int, x array<double>")

    def features(batches):
        for b in batches:
            yield batch_of([(y, lexicon.features(t)) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], x_schema)

    rows = sample.where("half = 1").select("text", "y").mapInArrow(features, x_schema).collect()  # at most the sample
    y = np.array([r.y for r in rows], float)
    if len(rows) < 20 or y.min() == y.max():
        return Model(lexicon, np.array(DEFAULT_WEIGHTS))
    return Model(lexicon, logistic(np.array([r.x for r in rows]), y))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score (0 to 1) and prediction of every whole text.

    A null or empty text gets the score of no hit.  Repeated rows get a row each, an empty table
    gives none, a null id stays null, other columns are ignored.
    """
    schema = ddl(f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), 500):
                found = [m.score(t) for t in b.column(1).slice(at, 500).to_pylist()]
                yield batch_of([(i, s, int(s >= 0.5)) for i, s in zip(ids[at : at + 500], found, strict=True)], schema)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(task, schema)


def held_out_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled rows outside fold 0 and scores all documents."""
    model = fit(docs, labels.where(fold() != 0))
    return score(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they are.

    A repeated doc_id goes if any of its rows is toxic; rows with a null id are judged by their text.  A null or empty
    text has no hit and stays, a long one is read whole, an empty table gives an empty one, and other columns
    stay as they are, whatever their names.
    """
    model = fit(docs, labels.where(fold() != 0))
    key = free_name(docs.columns, "_key")
    rows = docs.withColumn(key, id_or_text())
    bad = score(rows, model, id_col=key).where("predicted = 1").select(F.col(key).alias("bad")).distinct()
    return rows.join(bad, rows[key].eqNullSafe(bad["bad"]), "left_anti").drop(key)
