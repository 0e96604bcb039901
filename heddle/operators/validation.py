"""A suite of checks over a table of answers in one scan.

Checks of rows and of groups are added up side by side, first by group and then over all, with some examples of what failed: the smallest key of each
of a few hash bins, so their number is bounded however many rows fail.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Examples of a failed check at most.
EXAMPLES = 5


@dataclass
class Check:
    """``wrong`` marks what fails among what ``counts`` (all, if not given); ``least`` is the share that must pass.

    A check of rows has a condition on their columns; one of groups (``group``) on n, the group's rows, and on what ``sums`` adds up.
    """

    name: str
    wrong: Column
    counts: Column | None = None
    least: float = 1.0
    group: bool = False


def _bins(wrong: Column, key: Column) -> list[Column]:
    bin_ = F.pmod(F.xxhash64(key), F.lit(EXAMPLES))
    return [F.min(F.when(wrong & (bin_ == i), key)) for i in range(EXAMPLES)]


def report(rows: DataFrame, key: str, group: str, checks: list[Check], sums: dict[str, Column] | None = None) -> DataFrame:
    """(check, n_checked, n_failed, share, passed, examples) for each check.

    A null condition fails.  Examples are keys of rows, or of groups, as text.  A check that meets nothing passes with a null share.
    """
    sums = sums or {}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    wrong = lambda c: F.coalesce(c.wrong, F.lit(True)) & counted(c)
    counted = lambda c: F.lit(True) if c.counts is None else F.coalesce(c.counts, F.lit(False))
    marked, first = rows, [F.count("*").alias("n"), *[F.sum(v).alias(n) for n, v in sums.items()]]
    for i, c in enumerate(checks):
        if not c.group:
            marked = marked.withColumn(f"_w{i}", wrong(c)).withColumn(f"_c{i}", counted(c))
            first += [F.sum(F.col(f"_c{i}").cast("long")).alias(f"c{i}"), F.sum(F.col(f"_w{i}").cast("long")).alias(f"w{i}")]
            first += [e.alias(f"e{i}_{j}") for j, e in enumerate(_bins(F.col(f"_w{i}"), text(key)))]
    groups, last = marked.groupBy(group).agg(*first), []
    for i, c in enumerate(checks):
        if c.group:
            last += [F.sum(counted(c).cast("long")).alias(f"c{i}"), F.sum(wrong(c).cast("long")).alias(f"w{i}")]
            last += [e.alias(f"e{i}_{j}") for j, e in enumerate(_bins(wrong(c), text(group)))]
        else:
            last += [F.sum(f"c{i}").alias(f"c{i}"), F.sum(f"w{i}").alias(f"w{i}"), *[F.min(f"e{i}_{j}").alias(f"e{i}_{j}") for j in range(EXAMPLES)]]
    total = groups.agg(*last)
    each = []
    for i, c in enumerate(checks):
        n, bad = F.coalesce(F.col(f"c{i}"), F.lit(0)), F.coalesce(F.col(f"w{i}"), F.lit(0))
        share = F.when(n > 0, (n - bad) / n)
        each.append(
            F.struct(
                F.lit(c.name).alias("check"), n.alias("n_checked"), bad.alias("n_failed"), share.alias("share"), F.coalesce(share >= c.least, F.lit(True)).alias("passed"),
                F.array_sort(F.array_compact(F.array(*[f"e{i}_{j}" for j in range(EXAMPLES)]))).alias("examples"),
            )
        )
    return total.select(F.inline(F.array(*each)))


def asserted(found: DataFrame) -> DataFrame:
    """The report; fails, and names the checks and their examples, where one didn't pass."""
    bad = found.where("NOT passed").collect()  # a row a check
    if bad:
        raise ValueError("; ".join(f"{r.check}: {r.n_failed} of {r.n_checked} fail, such as {', '.join(r.examples)}" for r in bad))
    return found


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """Read once by each worker of an executor."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _round_trip(text: str, path: str) -> bool:
    t = _tokenizer(path)
    ids = t.encode(text, add_special_tokens=False).ids
    return t.encode(t.decode(ids, skip_special_tokens=False), add_special_tokens=False).ids == ids


def round_trips(text: str | Column, tokenizer: str) -> Column:
    """Whether a text's ids, decoded and encoded anew, are the same ids; null for null.  ``tokenizer`` is the path of a vocabulary file."""

    @F.pandas_udf("boolean")
    def same(texts):
        import pandas as pd

        # one text at a time: of a whole batch, the tokenizer's encodings take hundreds of bytes a token
        return pd.Series([None if x is None else _round_trip(x, tokenizer) for x in texts], dtype="boolean")

    return same(text)
