"""An inventory of files that may hold answers' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields that may hold a text, the first of them first.  Fixed values.
FIELDS = ("generated", "generated_text", "completion", "text", "gen_text", "answer")


def _string(record: Column, path: str) -> Column:
    """What a variant holds at a path, if it is a string."""
    found = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(record, path, "string"))


def _records(texts: DataFrame) -> DataFrame:
    """(folder, text): a record of each element of arrays, and of other values; text is the record, or the first field, that is a string."""
    one = F.try_parse_json("value")
    many = F.when(F.schema_of_variant(one).startswith("ARRAY"), F.from_json("value", "array<variant>"))
    records = texts.select("folder", F.explode(F.coalesce(many, F.array(one))).alias("v"))
    return records.select("folder", F.coalesce(*[_string(F.col("v"), f"$.{f}") for f in FIELDS], _string(F.col("v"), "$")).alias("text"))


def _tables(spark: SparkSession, root: str) -> DataFrame:
    """(folder, text) of comma-separated files: by each file's own header, whose columns needn't be those of other files."""
    files = lambda: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
    raw = files().text(root).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # the widest header: Spark would take the width from one file, and fails where there is none
    commas = F.length(F.min_by("value", "row")) - F.length(F.translate(F.min_by("value", "row"), ",", ""))
    width = raw.where("block = 0 AND trim(value) <> ''").groupBy("file").agg((commas + 1).alias("n")).agg(F.max("n").alias("n")).first().n
    if width is None:
        return spark.createDataFrame([], "folder string, text string")
    lines = files().csv(root, schema=", ".join(f"_c{i} string" for i in range(width)), header=False, multiLine=True, escape='"')
    cells = F.array(*[F.col(c) for c in lines.columns])
    where = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), cells.alias("cells"), F.monotonically_increasing_id().alias("row"))
    # files are read whole by one task each, so a file's least row is its header
    heads = where.groupBy("file").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("first"))
    found = where.join(heads, "file").where("row > first")
    fields = [F.get("cells", (F.array_position("head", f) - 1).cast("int")) for f in FIELDS]
    has = [F.when(F.array_contains("head", f), F.coalesce(v, F.lit(""))) for f, v in zip(FIELDS, fields, strict=True)]
    return found.select(F.element_at(F.split("file", "/"), -2).alias("folder"), F.coalesce(*has).alias("text"))


def inventory(spark: SparkSession, root: str, expected: int) -> DataFrame:
    """By folder under ``root`` that holds JSON lines, JSON arrays or comma-separated files: its rows, those with a text that isn't empty, and
    COMPLETE where as many as expected, PARTIAL where fewer or more, NONE where no row has one.

    A text is the first of the fields that is a string; a line that isn't JSON is a row without one.  A file of one JSON value over several lines,
    which Spark can't split, is read whole by one task.
    """
    read = lambda glob, **how: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, **how)
    of = lambda d: d.select("value", F.col("_metadata.file_path").alias("file"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("folder")).where(F.trim("value") != "")
    lines = of(read("*.{json,jsonl}"))
    spread = lines.where(F.col("file").endswith(".json")).groupBy("file").agg(F.bool_or(F.trim("value").isin("[", "{")).alias("open")).where("open").select("file")
    whole = of(read("*.json", wholetext=True)).join(spread, "file", "left_semi")
    single = lines.join(spread, "file", "left_anti")
    found = _records(single.unionByName(whole)).unionByName(_tables(spark, root)).groupBy("folder").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("text") != "", 1)).alias("n_texts"))
    n = F.col("n_texts")
    return found.withColumn("verdict", F.when(n == 0, "NONE").when((n == expected) & (F.col("n_rows") == expected), "COMPLETE").otherwise("PARTIAL"))
