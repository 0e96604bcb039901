"""Per-channel scaling whose parameters come from training rows alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions import ranks

#: Values of one number that a task puts in order as an array: 64 MB.
AT_ONCE = 8_000_000


def _with(cells: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(params, keys)  # one row a channel


@dataclass
class Scale:
    """Parameters of channels from training cells, by keys, or of one channel from its values in order, and what becomes of an array of
    values, given an array of each parameter."""

    fit: Callable[[DataFrame, list[str]], DataFrame]
    names: tuple[str, ...]
    apply: Callable[..., np.ndarray]
    of: Callable[[np.ndarray], tuple[float, ...]]


def _line(v: np.ndarray, share: float) -> float:
    """A quantile of values in order, between neighbours by line, to the last bit as Spark's ``percentile``."""
    if not len(v):
        return np.nan
    at = (len(v) - 1) * share
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(v[lo] if lo == hi or v[lo] == v[hi] else (hi - at) * v[lo] + (at - lo) * v[hi])


def _mad(train: DataFrame, keys: list[str]) -> DataFrame:
    mid = ranks.quantiles(train, keys, F.col("v"), {"mid": 0.5})
    dev = ranks.quantiles(_with(train, mid, keys), keys, F.abs(F.col("v") - F.col("mid")), {"dev": 0.5})
    return mid.join(dev, keys)


def _winsor(train: DataFrame, keys: list[str]) -> DataFrame:
    edge = ranks.quantiles(train, keys, F.col("v"), {"lo": 0.005, "hi": 0.995})
    clip = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
    return edge.join(ranks.quantiles(_with(train, edge, keys), keys, clip, {"mid": 0.5, "q1": 0.25, "q3": 0.75}), keys)


def _mad_of(v: np.ndarray) -> tuple[float, ...]:
    mid = _line(v, 0.5)
    return mid, _line(np.sort(np.abs(v - mid)), 0.5)


def _winsor_of(v: np.ndarray) -> tuple[float, ...]:
    lo, hi = _line(v, 0.005), _line(v, 0.995)
    clipped = np.minimum(np.maximum(v, lo), hi)
    return lo, hi, *(_line(clipped, p) for p in (0.5, 0.25, 0.75))


MAD = Scale(_mad, ("mid", "dev"), lambda v, mid, dev: (v - mid) / (dev + 1e-6), _mad_of)
WINSOR_IQR = Scale(_winsor, ("lo", "hi", "mid", "q1", "q3"), lambda v, lo, hi, mid, q1, q3: np.clip((np.clip(v, lo, hi) - mid) / ((q3 - q1) / 1.349 + 1e-8), -6, 6), _winsor_of)


def parameters(rows: DataFrame, column: str, fits: list[Column], scale: Scale, *, most: int = AT_ONCE) -> np.ndarray:
    """For each of several choices of training rows, the parameters of every number of an array column: (choices, names, numbers).

    All choices take one pass: a number's values travel once, as blocks with a bit for each choice, and are put in order once.
    With more than ``most`` rows no task holds all values of a number; they then go by cells, with the same results.  Null numbers count for nothing.
    """
    marked = rows.select(F.col(column).alias("x"), F.array(*[F.coalesce(f, F.lit(False)) for f in fits]).alias("fit"))
    if marked.count() > most:
        each = [scale.fit(marked.where(F.get("fit", F.lit(k))).select(F.posexplode("x").alias("i", "v")).withColumn("v", F.col("v").cast("double")), ["i"]) for k in range(len(fits))]
        return np.array([np.array(f.orderBy("i").select(*scale.names).collect(), float).T for f in each])  # a row a number
    n, names, of = len(fits), scale.names, scale.of
    kind = "<f4" if rows.schema[column].dataType.elementType.typeName() == "float" else "<f8"

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(0).flatten()
            x = pc.fill_null(flat.cast(pa.float32() if kind == "<f4" else pa.float64()), 0).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            bits = np.packbits(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), axis=1)
            there = flat.is_valid().to_numpy(zero_copy_only=False).reshape(x.shape) if flat.null_count else None
            kept = lambda v, i: (v if there is None else v[there[:, i]]).tobytes()  # noqa: B023, E731
            cells = range(x.shape[1])
            parts = pa.array([kept(x[:, i], i) for i in cells], pa.binary()), pa.array([kept(bits, i) for i in cells], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *parts], names=["i", "v", "fit"])

    def solve(f):
        import pandas as pd

        v = np.frombuffer(b"".join(f["v"]), kind).astype(np.float64)
        fit = np.unpackbits(np.frombuffer(b"".join(f["fit"]), np.uint8).reshape(len(v), -1), axis=1, count=n).astype(bool)
        order = np.argsort(v)
        v, fit = v[order], fit[order]
        return pd.DataFrame({"i": f["i"][:1], "found": [np.concatenate([of(v[fit[:, k]]) for k in range(n)])]})

    found = marked.mapInArrow(cut, "i int, v binary, fit binary").groupBy("i").applyInPandas(solve, "i int, found array<double>")
    return np.array([r.found for r in found.orderBy("i").collect()], float).reshape(-1, n, len(names)).transpose(1, 2, 0)  # a row a number


def mad(cells: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """(v - median) / (median absolute deviation + 1e-6)."""
    return _with(cells, _mad(train, keys), keys).withColumn("scaled", (F.col("v") - F.col("mid")) / (F.col("dev") + 1e-6)).drop("mid", "dev")


def winsor_iqr(cells: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Clipped to the 0.5 and 99.5 percentiles, then centred and scaled by median and IQR of the clipped values."""
    clip = F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi"))
    scaled = (clip - F.col("mid")) / ((F.col("q3") - F.col("q1")) / 1.349 + 1e-8)
    return _with(cells, _winsor(train, keys), keys).withColumn("scaled", F.least(F.greatest(scaled, F.lit(-6.0)), F.lit(6.0))).drop("lo", "hi", "mid", "q1", "q3")


def zscore(cells: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    """Population standard scores; a constant channel is divided by 1."""
    fit = train.groupBy(*keys).agg(F.avg("v").alias("mid"), F.stddev_pop("v").alias("dev"))
    dev = F.when(F.col("dev") > 0, F.col("dev")).otherwise(F.lit(1.0))
    return _with(cells, fit, keys).withColumn("scaled", (F.col("v") - F.col("mid")) / dev).drop("mid", "dev")


def rms_clip(cells: DataFrame, row: list[str], channel: str, q: float = 0.99) -> DataFrame:
    """Rows divided by their root mean square, then clipped at a percentile of each channel's size."""
    rms = F.sqrt(F.avg(F.col("v") ** 2).over(Window.partitionBy(*row)) + 1e-8)
    normed = cells.withColumn("scaled", F.col("v") / rms)
    edge = ranks.quantiles(normed, [channel], F.abs("scaled"), {"edge": q})
    return normed.join(edge, channel).withColumn("scaled", F.greatest(F.least(F.col("scaled"), F.col("edge")), -F.col("edge"))).drop("edge")


def centred(cells: DataFrame, group: list[str]) -> DataFrame:
    """The group's mean and what is left of each row."""
    mean = F.avg("v").over(Window.partitionBy(*group))
    return cells.withColumn("centroid", mean).withColumn("delta", F.col("v") - F.col("centroid"))
