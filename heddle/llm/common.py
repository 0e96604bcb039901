"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.sources.scratch import discard, stored

__all__ = ["discard", "stored"]

#: The word pattern of the contracts: runs of anything but ASCII white space.
ASCII_SPACE = "\x09\x0a\x0b\x0c\x0d\x20"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, with underscores after it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def id_or_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row goes by: its id, or where that is null its text's hash."""
    return F.struct(F.col(id_col).alias("i"), F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).alias("h"))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds).cast("int")


def ascii_lower(text: str) -> str:
    """A-Z in lower case, every other character as it is."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_words(text: str) -> list[str]:
    """Runs of characters other than the six ASCII white-space characters, A-Z in lower case."""
    if text.isascii() and not _has_separators(text):
        return text.lower().split()
    encoded = text.encode("utf-8", "surrogatepass").lower().split()
    return [w.decode("utf-8", "surrogatepass") for w in encoded]


def ascii_word_bytes(text: str) -> list[bytes]:
    """The words of ``ascii_words`` as UTF-8; bytes.lower and bytes.split know ASCII alone."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _has_separators(text: str) -> bool:
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def ddl(text: str) -> StructType:
    """A schema from its text; needs the session, so call it on the driver."""
    return StructType.fromDDL(text)


def batch_of(rows: list[tuple], schema: StructType):
    """An Arrow batch of row tuples; for use in tasks."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    cols = zip(*rows, strict=True) if rows else [()] * len(out)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)
