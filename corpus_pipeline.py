"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet in the shared folder and hands them to the next.  All but the last return the columns of
``documents``.  Their rules:

* toxicity: learns from labels outside fold 0 and drops the documents it predicts toxic.
* near_duplicates: keeps one document of each group linked at a Jaccard similarity of 0.8 or more.
* decontamination: drops the documents that hold a benchmark item.
* secrets: keeps all documents and replaces reported spans by a mark.
* packing: cuts what is left into full sequences, one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import decontaminate, neardup, packing, secrets, toxicity
from heddle.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; null and empty texts stay.  Odd rows as in ``toxicity.reject``."""
    return toxicity.reject(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group; null ids and texts stay.  Odd rows as in ``neardup.one_of_each``."""
    return neardup.one_of_each(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts stay.  Odd rows as in ``decontaminate.clean``."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all rows and replaces reported spans.  Odd rows as in ``secrets.redact``."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all rows into sequences; null text is its end id alone.  Odd rows as in ``packing.pack``."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Learned scores, MinHash and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name=f"stage-{name}")
    return docs
