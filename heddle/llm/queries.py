"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.llm import decontaminate, knn, language, lexical, lm, mixing, neardup, packing, secrets, sentences, spelling, suffixes, toxicity
from heddle.llm.common import read


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_query(read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return knn.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.dedup_spans(read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.spans(read(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup_substrings(read(spark, sf_dir, "documents")))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.held_out_query(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.counted(read(spark, sf_dir, "documents"), damage=97))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_knn": op3_knn,
    "op4_sentences": op4_sentences,
    "op5_secrets": op5_secrets,
    "op6_toxicity": op6_toxicity,
    "op7_suffixes": op7_suffixes,
    "op8_lm": op8_lm,
    "op9_decontaminate": op9_decontaminate,
    "op10_neardup": op10_neardup,
    "op11_search": op11_search,
    "op12_mixing": op12_mixing,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_knn": knn.SQL,
    "op5_secrets": secrets.SQL,
    "op11_search": lexical.SQL,
    "op13_spelling": spelling.SQL,
}
