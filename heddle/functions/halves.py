"""Arrays of numbers as 16-bit floats in binary columns, little-endian.

``float16`` has 11 significant bits: a value comes back within 2**-11 of its size, or within 2**-25 where it is below 2**-14.
``bfloat16`` has 8 of them and the range of 32-bit floats: within 2**-8 of its size, or within 2**-134 where it is below 2**-126.
Both round to the nearest, ties to even, and are exact on what they can hold.  What is too large for them fails, or with
``overflow="clip"`` becomes the largest number they hold; infinities and NaN stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = {"float16": 65504.0, "bfloat16": float(np.array([0x7F7F0000], np.uint32).view(np.float32)[0])}


def encoded(values: np.ndarray, kind: str = "bfloat16", overflow: str = "fail") -> np.ndarray:
    """16-bit patterns of the values."""
    v = np.asarray(values, np.float64)
    if kind == "float16":
        with np.errstate(over="ignore"):
            out = v.astype(np.float16)
        bits = out.view(np.uint16)
        over = np.isinf(out) & np.isfinite(v)
    else:
        with np.errstate(over="ignore"):
            single = v.astype(np.float32)
        single = np.where(np.abs(single.astype(np.float64)) > np.abs(v), np.nextafter(single, np.float32(0)), single)  # cut, so that it is rounded once
        cut = single.view(np.uint32)
        rest = (single.astype(np.float64) != v) & np.isfinite(v)
        low = (cut & 0xFFFF).astype(np.int64) * 2 + rest  # what is cut off, and whether there is more
        up = (low > 0x10000) | (low == 0x10000) & (cut >> 16 & 1 == 1)
        bits = ((cut >> 16) + (up & np.isfinite(v))).astype(np.uint16)
        bits = np.where(np.isnan(v), 0x7FC0, bits).astype(np.uint16)
        over = (bits & 0x7FFF == 0x7F80) & np.isfinite(v)
    if over.any():
        if overflow == "fail":
            raise ValueError(f"{float(v[over][0])!r} is too large for {kind}")
        top = encoded(np.array([LARGEST[kind]]), kind)[0]
        bits = np.where(over, np.where(v < 0, top | 0x8000, top), bits).astype(np.uint16)
    return bits


def decoded(bits: np.ndarray, kind: str = "bfloat16") -> np.ndarray:
    """32-bit floats of 16-bit patterns."""
    if kind == "float16":
        return bits.astype(np.uint16).view(np.float16).astype(np.float32)
    return (bits.astype(np.uint32) << 16).view(np.float32)


def packed(column: str | Column, kind: str = "float16", overflow: str = "fail") -> Column:
    """An array of numbers as a binary; null stays null, a null number becomes NaN."""

    @F.pandas_udf("binary")
    def pack(x):
        return x.map(lambda v: None if v is None else encoded(np.array(v, float), kind, overflow).astype("<u2").tobytes())

    return pack(F.col(column).cast("array<double>") if isinstance(column, str) else column.cast("array<double>"))


def unpacked(column: str | Column, kind: str = "float16") -> Column:
    """The array of floats that a binary of ``packed`` holds."""

    @F.pandas_udf("array<float>")
    def unpack(x):
        return x.map(lambda b: None if b is None else decoded(np.frombuffer(b, "<u2"), kind))

    return unpack(column)
