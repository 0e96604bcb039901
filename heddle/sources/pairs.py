"""States from elsewhere, keyed otherwise, beside our answers: joined by order within a prompt, with a proof that the order is the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, prompt: str, order: list[str], name: str = "nth") -> DataFrame:
    """Adds a row's place in its prompt, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(prompt).orderBy(*order)) - 1)


def aligned(ours: DataFrame, theirs: DataFrame, *, prompt: str, order: list[str], label: str, their_prompt: str, their_order: list[str], their_label: str) -> DataFrame:
    """Our rows with theirs of the same place in the prompt; their columns but the prompt keep their names, so they are others than ours.

    Fails where a prompt has more rows on one side, stands on one side alone, or where labels of a place differ: a shift that
    goes unseen would make up an effect.  Null labels are equal to each other.
    """
    a = numbered(ours, prompt, order, "_nth")
    b = numbered(theirs.withColumnRenamed(their_prompt, "_prompt"), "_prompt", their_order, "_their_nth")
    same = (F.col(prompt) == F.col("_prompt")) & (F.col("_nth") == F.col("_their_nth"))
    both = a.withColumn("_ours", F.lit(True)).join(b.withColumn("_theirs", F.lit(True)), same, "full")
    place = F.concat(F.coalesce(F.col(prompt), F.col("_prompt")).cast("string"), F.lit(", place "), F.coalesce(F.col("_nth"), F.col("_their_nth")).cast("string"))
    said = F.when(F.col("_theirs").isNull(), F.concat(F.lit("no state from elsewhere for prompt "), place))
    said = said.when(F.col("_ours").isNull(), F.concat(F.lit("no answer for the state of prompt "), place))
    said = said.when(~F.col(label).eqNullSafe(F.col(their_label)), F.concat(F.lit("labels differ at prompt "), place))
    checked = F.when(said.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(True)
    return both.withColumn("_ok", checked).where("_ok").drop("_ok", "_ours", "_theirs", "_prompt", "_nth", "_their_nth")


def projection(rows: DataFrame, index: str, column: str) -> np.ndarray:
    """A projection's matrix from its rows; fails where their numbers aren't 0 to n - 1 or their widths differ."""
    found = rows.select(index, column).orderBy(index).collect()  # as many as a state has numbers
    if [r[0] for r in found] != list(range(len(found))) or len({len(r[1]) for r in found}) > 1:
        raise ValueError("the projection's rows aren't numbered from 0, or differ in width")
    return np.array([r[1] for r in found], float)


def projected(rows: DataFrame, column: str, matrix: np.ndarray, name: str) -> DataFrame:
    """Adds ``name``: the column's vectors times the matrix; fails where a vector has another size."""

    @F.pandas_udf("array<double>")
    def times(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        wrong = {len(v) for v in x} - {len(matrix)}
        if wrong:
            raise ValueError(f"a state has {min(wrong)} numbers, the projection takes {len(matrix)}")
        return pd.Series(list(np.stack(x.to_numpy()).astype(np.float64) @ matrix))

    return rows.withColumn(name, times(column))
