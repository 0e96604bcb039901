"""Language identification by unigram pieces with the segmentation summed out.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, which a forward
pass gives; pieces never cross words, so a text's is the product over its words.
Piece probabilities are fitted by expectation-maximisation over the words of a bounded sample of
labelled documents, each iteration being one Spark job.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import batch_of, ddl, fold, stored

#: Runs of letters; longer runs are read as consecutive words of this many characters.
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 32
CACHE_WORDS = 1_000_000


def default_vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, or none where the text holds no letter."""
    found = LETTERS.findall(text.lower()) if text else []
    if not any(c.isalpha() for w in found for c in w):
        return []
    if max(map(len, found)) > LONGEST:
        found = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return found


class Pieces:
    """The vocabulary as a lookup; one more id stands for a character that it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(names) if i not in special}
        self.size, self.unknown, self.none = len(names) + 2, len(names), len(names) + 1
        self.longest = min(LONGEST + 1, max(map(len, self.ids)))
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}

    def lattice(self, words: list[str]) -> np.ndarray:
        """For words of one length: ids of the piece of k+1 characters that ends at i."""
        n, longest = len(words[0]) + 1, self.longest
        out = np.full((len(words), n, min(n, longest)), self.none, np.int32)
        get, starts, unknown = self.ids.get, self.starts, self.unknown
        for b, w in enumerate(words):
            s, row = "▁" + w, out[b]
            for i in range(n):
                if s[i] not in self.ids:
                    row[i, 0] = unknown
                for j in range(i + 1, min(n, i + longest) + 1):
                    part = s[i:j]
                    if part not in starts:
                        break
                    if (found := get(part)) is not None:
                        row[j - 1, j - 1 - i] = found
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations: [words, characters + 1, languages]."""
    size, n, longest = lattice.shape
    a = np.zeros((size, n + 1, p.shape[1]))
    a[:, 0] = 1
    for i in range(n):
        for k in range(min(i + 1, longest)):
            a[:, i + 1] += a[:, i - k] * p[lattice[:, i, k]]
    return a


def expected(lattice: np.ndarray, p: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> None:
    """Adds each piece's expected number of uses over the words; p has one language."""
    _, n, longest = lattice.shape
    a = forward(lattice, p)[:, :, 0]
    b = np.zeros_like(a)
    b[:, n] = 1
    for i in range(n - 1, -1, -1):
        for k in range(min(i + 1, longest)):
            b[:, i - k] += b[:, i + 1] * p[lattice[:, i, k], 0]
    scale = weights / np.maximum(a[:, n], 1e-300)
    for i in range(n):
        for k in range(min(i + 1, longest)):
            ids = lattice[:, i, k]
            np.add.at(counts, ids, scale * a[:, i - k] * p[ids, 0] * b[:, i + 1])


def by_length(words: list[str], most: int = 4000) -> Iterator[list[str]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    for group in groups.values():
        for at in range(0, len(group), most):
            yield group[at : at + most]


@dataclass
class Model:
    """languages, log priors and log-probability table; ``vocabulary`` is the path of the pieces."""

    vocabulary: str
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray
    _seen: dict[str, int] = field(default_factory=dict, repr=False)
    _table: np.ndarray | None = field(default=None, repr=False)

    def text_scores(self, texts: list[list[str]]) -> np.ndarray:
        """Log-probability of each text's words by language, with the prior."""
        if len(self._seen) > CACHE_WORDS:
            self._seen.clear()
        if self._table is None:
            self._table = np.empty((1024, len(self.languages)))
        new: set[str] = set()
        for words in texts:
            new.update(words)
        new.difference_update(self._seen)
        known = pieces(self.vocabulary)
        for group in by_length(list(new)):
            logs = np.log(np.maximum(forward(known.lattice(group), self.p)[:, -1], 1e-300))
            at = len(self._seen)
            while at + len(group) > len(self._table):
                self._table = np.concatenate([self._table, np.empty_like(self._table)])
            self._table[at : at + len(group)] = logs
            self._seen.update(zip(group, range(at, at + len(group)), strict=True))
        get = self._seen.__getitem__
        out = np.empty((len(texts), len(self.languages)))
        for i, words in enumerate(texts):
            out[i] = self.prior + self._table[np.fromiter(map(get, words), np.int64, len(words))].sum(0)
        return out


def fit(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    vocabulary: str | None = None,
    docs_per_language: int = 2_000,
    iterations: int = 3,
    smoothing: float = 0.05,
) -> Model:
    """Fits piece probabilities on about ``docs_per_language`` documents of each language.

    The documents are those with the smallest hashes of id and text, so the sample's size is bounded
    however many there are, with or without ids.  Rows without text or language are not used.  Priors come from
    the counts of all labelled documents.
    """
    path = vocabulary or default_vocabulary_path()
    used = docs.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h")
    ).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in used.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    languages = list(sizes)
    if not languages:
        return Model(path, [], np.zeros(0), np.zeros((pieces(path).size, 0)))
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, docs_per_language / n))])
    picked = used.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")
    schema = ddl("lang string, word string, n long")

    def count(batches):
        found: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words_of(text))
        rows = [(g, w, n) for (g, w), n in found.items()]
        for at in range(0, len(rows), 50_000):
            yield batch_of(rows[at : at + 50_000], schema)

    counts = picked.mapInArrow(count, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, name="language-words")
    size, sc = pieces(path).size, docs.sparkSession.sparkContext
    at = {g: i for i, g in enumerate(languages)}
    p = np.full((size, len(languages)), 1 / size)
    p[-1] = 0
    out = ddl("l int, piece int, n double")
    for _ in range(iterations):
        shared = sc.broadcast(p)

        def step(batches, shared=shared):
            known, p = pieces(path), shared.value
            sums = np.zeros((len(at), known.size))
            for b in batches:
                by: dict[str, dict[str, int]] = {}
                for g, w, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    by.setdefault(g, {})[w] = n
                for g, words in by.items():
                    for group in by_length(list(words)):
                        weights = np.array([words[w] for w in group], float)
                        expected(known.lattice(group), p[:, at[g] : at[g] + 1], weights, sums[at[g]])
            rows = [(int(i), int(j), float(sums[i, j])) for i, j in zip(*np.nonzero(sums), strict=True)]
            yield batch_of(rows, out)

        found = counts.select("lang", "word", "n").mapInArrow(step, out).groupBy("l", "piece").agg(F.sum("n").alias("n"))
        c = np.full((size, len(languages)), smoothing)
        for r in found.collect():  # at most the vocabulary for each language
            c[r.piece, r.l] += r.n
        c[-1] = 0
        p = c / c.sum(0)
        shared.unpersist()
    total = sum(sizes.values())
    return Model(path, languages, np.log([n / total for n in sizes.values()]), p)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: id, lang_pred and score (its posterior probability).

    ``und`` with score 0 where the text is null, empty or without a letter, or the model
    knows no language.  Long texts are read whole.  Ties go to the language that sorts first.  Repeated rows get a row each,
    an empty table gives none, other columns are ignored.
    """
    schema = ddl(f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        for b in batches:
            ids = b.column(0).to_pylist()
            for at in range(0, len(ids), 500):
                part = ids[at : at + 500]
                texts = [words_of(t) for t in b.column(1).slice(at, 500).to_pylist()]
                if not m.languages:
                    yield batch_of([(i, "und", 0.0) for i in part], schema)
                    continue
                s = m.text_scores(texts)
                best = s.argmax(1)
                score = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
                yield batch_of(
                    [(i, m.languages[k], float(x)) if w else (i, "und", 0.0) for i, w, k, x in zip(part, texts, best, score, strict=True)],
                    schema,
                )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(task, schema)


def held_out_query(docs: DataFrame) -> DataFrame:
    """Learns from documents outside fold 0 and identifies all."""
    model = fit(docs.where(fold() != 0))
    return identify(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")
