"""Grouping of spelling variants by a symmetric-delete join.

Every word emits itself and what is left of it by each single deletion, with the place of the deletion.  Words that share
what is left by a deletion at the same place differ by a replaced code point there; a word that another one is left with
differs from it by an inserted one.  So the joins meet no pair that isn't near, and groups of a shared key have a word for each
letter of the alphabet at most.  The distance is verified all the same.  Links are added up to a form for each word, and forms
are followed by joins that double their steps.  All joins are by sorted runs: tables of words grow with the texts and are small
as Parquet, so Spark would build them in the driver and send them whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, stored

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def without(word: Column, at: Column) -> Column:
    """A word without the code point at a place, from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def counted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN, least_length: int = 5, least_count: int = 3, damage: int | None = None) -> DataFrame:
    """(word, n): the words of all whole texts with A-Z in lower case, as far as they are long and frequent enough.

    With ``damage``, an occurrence whose crc32 of ``<id>:<word>`` it divides loses the code point of that hash.  Null ids count
    as empty text, null texts have no words, repeated rows count each, very long texts are read whole; nothing else is read.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(pattern), 0)).alias("run"))
    word = F.col("run")
    if damage is not None:
        h = F.crc32(F.concat("i", F.lit(":"), "run"))
        word = F.when(h % damage == 0, without(word, (h % F.length("run")).cast("int"))).otherwise(word)
    found = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for all words (word, n) at a distance of exactly one, in both directions.  Words are distinct."""
    places = F.sequence(F.lit(0), F.length("word") - 1)
    left = words.where("word <> ''").select("word", "n", F.posexplode(F.transform(places, lambda i: without(F.col("word"), i))).alias("at", "key"))
    a, b = left.alias("a"), left.alias("b").hint("merge")
    replaced = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.at") == F.col("b.at")) & (F.col("a.word") != F.col("b.word")))
    replaced = replaced.select("a.word", F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    long = left.select(F.col("word").alias("long"), F.col("n").alias("long_n"), F.col("key").alias("word")).distinct()
    inserted = long.join(words.hint("merge"), "word")
    ends = F.array(
        F.struct(F.col("word"), F.col("long").alias("near"), F.col("long_n").alias("near_n")),
        F.struct(F.col("long").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    both = replaced.unionByName(inserted.select(F.inline(ends)))
    return both.where(F.levenshtein("word", "near", 1) == 1)


def forms(words: DataFrame, near: DataFrame, *, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the most frequent near word, ties to the smallest, if it has ``factor`` times the count."""
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best.hint("merge"), "word", "left")
    kept = -F.col("best.less") >= factor * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("best.near")).alias("form"), F.when(kept, -F.col("best.less")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form.  Counts at least double along forms, so there are no rings and seven rounds are enough."""
    now = stored(found.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), name="roots")
    while now.where("moved").limit(1).count():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        last, now = now, stored(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), name="roots")
        discard(last)
    return now.select("word", "root")


def variants(words: DataFrame, *, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n), both without nulls; an empty table gives none.

    A word of any length is taken whole, and extra columns are left out.
    """
    words = stored(words.select("word", "n"), name="words")
    found = stored(forms(words, links(words), factor=factor), name="forms")
    return found.join(roots(found).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_CRC = """list_reduce(list_transform(range(8), lambda x: 0::UBIGINT), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END, i::UBIGINT)"""

SQL = f"""WITH RECURSIVE crc AS (SELECT list({_CRC} ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
counts AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda b: ('0x' || b)::UBIGINT) AS b FROM counts),
hashes AS (SELECT run, n, xor(list_reduce(b, lambda h, x: xor(h // 256, t[(xor(h % 256, x) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS h FROM bytes, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashes)
WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, pos, word[:pos] || word[pos + 2:] AS key FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM words)),
shorter AS (SELECT DISTINCT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cuts c JOIN words w ON c.key = w.word),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (key, pos) WHERE a.word <> b.word
UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter),
best AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS place FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
FROM words w LEFT JOIN best b ON w.word = b.word AND place = 1),
steps AS (SELECT word, word AS top FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.top = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.top AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s USING (word) JOIN forms g ON g.word = s.top WHERE g.form IS NULL"""
