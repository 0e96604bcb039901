"""Where queries are registered: name, function and, where SQL can express it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.views import SQL as VIEWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, without negative zeros, so that the order of sums doesn't show."""
    return df.select(*[(F.round(c, PLACES) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "", views: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``doubles`` are the SQL's columns to round."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            star = f" REPLACE ({', '.join(f'round({c}, {PLACES}) + 0.0 AS {c}' for c in doubles.split())})" if doubles else ""
            ORACLE_SQL[f.__name__] = (f"WITH {VIEWS}\n" if views else "") + f"SELECT *{star} FROM ({sql})"
        return f

    return register
