"""A store of raw states: answers of any number of tokens, each token a tensor of layers by channels, as 16-bit floats in blocks.

A block holds whole answers one after the other: their keys, the offsets of their first tokens, and all states as one binary.
Every derived stream comes from one pass over the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import halves

#: A block ends with the answer that brings it to so many bytes.
BLOCK_BYTES = 4 << 20
_BLOCK = "block string, beam_ids array<long>, prompt_ids array<long>, ys array<int>, offsets array<int>, layers int, channels int, kind string, states binary"


def write(tokens: DataFrame, path: str, layers: int, channels: int, *, kind: str = "bfloat16", block_bytes: int = BLOCK_BYTES, overflow: str = "fail") -> None:
    """Writes tokens (beam_id, prompt_id, y, pos, x) as blocks.  An answer without tokens has one row whose pos and x are null."""

    def blocks(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        open_: list[tuple] = []
        parts: list[bytes] = []
        size, width = 0, layers * channels

        def closed():
            nonlocal open_, parts, size, number
            ids, prompts, ys, lengths = zip(*open_, strict=True)
            row = (f"{task}-{number}", ids, prompts, ys, np.cumsum([0, *lengths]).tolist(), layers, channels, kind, b"".join(parts))
            open_, parts, size, number = [], [], 0, number + 1
            return pd.DataFrame([row], columns=[c.split()[0] for c in _BLOCK.split(", ")])

        for f in frames:
            for beam, prompt, y, x in zip(f["beam_id"].tolist(), f["prompt_id"].tolist(), f["y"].tolist(), f["x"], strict=True):
                if open_ and open_[-1][0] != beam and size >= block_bytes:
                    yield closed()
                if not open_ or open_[-1][0] != beam:
                    open_.append((beam, prompt, y, 0))
                if x is not None:
                    if len(x) != width:
                        raise ValueError(f"a state of answer {beam} has {len(x)} numbers for {layers} layers of {channels}")
                    parts.append(halves.encoded(x, kind, overflow).astype("<u2").tobytes())
                    size += 2 * width
                    open_[-1] = (*open_[-1][:3], open_[-1][3] + 1)
        if open_:
            yield closed()

    rows = tokens.select("beam_id", "prompt_id", "y", "pos", F.col("x").cast("array<double>").alias("x"))
    rows.repartition("beam_id").sortWithinPartitions("beam_id", "pos").mapInPandas(blocks, _BLOCK).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _answers(row: dict, keep: dict | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Number in its block and states [token, layer, channel] of each answer."""
    shape = (row["layers"], row["channels"])
    size, offsets = shape[0] * shape[1], row["offsets"]
    for i in range(len(row["beam_ids"])):
        lo, hi = offsets[i], offsets[i + 1]
        if keep is not None and keep.get(i) is not None:
            hi = min(hi, lo + max(0, keep[i]))
        bits = np.frombuffer(row["states"], "<u2", (hi - lo) * size, 2 * lo * size)
        yield i, halves.decoded(bits, row["kind"]).astype(np.float64).reshape(hi - lo, *shape)


def _rows(batches: Iterator) -> Iterator[dict]:
    for b in batches:
        for j in range(b.num_rows):
            yield b.slice(j, 1).to_pylist()[0]


def unpacked(blocks: DataFrame) -> DataFrame:
    """(beam_id, prompt_id, y, pos, x): a row for each token; answers without tokens have none."""
    import pyarrow as pa

    def task(batches):
        for row in _rows(batches):
            for i, x in _answers(row):
                each = lambda name: [row[name][i]] * len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(each("beam_ids"), pa.int64()), pa.array(each("prompt_ids"), pa.int64()), pa.array(each("ys"), pa.int32()), pa.array(range(len(x)), pa.int32()), pa.array([t.ravel() for t in x.astype(np.float32)], pa.list_(pa.float32()))],
                    names=["beam_id", "prompt_id", "y", "pos", "x"],
                )

    return blocks.mapInArrow(task, "beam_id long, prompt_id long, y int, pos int, x array<float>")


_fma = np.frompyfunc(math.fma, 3, 1)


def _between(x: np.ndarray, share: float) -> np.ndarray:
    """A quantile, between neighbours by line: the weighted sum of both with a fused step, as SQL has it, for halves' quantiles often lie right between two decimals."""
    if not len(x):
        return np.zeros(x.shape[1:])
    x, at = np.sort(x, axis=0), (len(x) - 1) * share
    low, part = x[int(at)], at - int(at)
    high = x[min(int(at) + 1, len(x) - 1)]
    with np.errstate(invalid="ignore"):
        out = low * (1 - part) + high * part if part else low.copy()
    some = np.isfinite(low) & np.isfinite(high)
    out[some] = _fma(low[some], 1 - part, high[some] * part)
    out[np.isnan(x[-1])] = np.nan  # stand last
    return out


def _mean(x: np.ndarray) -> np.ndarray:
    return x.mean(0) if len(x) else np.zeros(x.shape[1:])


def statistics(x: np.ndarray) -> dict[str, np.ndarray]:
    """All streams of one answer's states [token, layer, channel]; zeros, and place -1, where there are no tokens."""
    steps = np.diff(x, axis=1)
    speed = np.sqrt((steps**2).sum(-1))
    turn = 1 - (steps[:, :-1] * steps[:, 1:]).sum(-1) / (speed[:, :-1] * speed[:, 1:] + 1e-12)
    return {
        "v_max": x.max(0) if len(x) else np.zeros(x.shape[1:]),
        "at": x.argmax(0) if len(x) else np.full(x.shape[1:], -1),
        "s95": _between(x, 0.95), "s05": _between(x, 0.05),
        "v95": _between(steps, 0.95), "v05": _between(steps, 0.05),
        "speed_mean": _mean(speed), "speed_q90": _between(speed, 0.9),
        "turn_mean": _mean(turn), "turn_q90": _between(turn, 0.9),
    }


STREAMS = ("v_max", "at", "s95", "s05", "v95", "v05", "speed_mean", "speed_q90", "turn_mean", "turn_q90")


def streams(blocks: DataFrame, lengths: DataFrame | None = None, length: str = "canonical") -> DataFrame:
    """(beam_id, prompt_id, y, n and every stream, layer-major) from one pass over the blocks.

    The maximum and the place of its first token, quantiles of states and of steps between layers, and speeds and turns.  With ``lengths``
    (beam_id, length) an answer's tokens past its length are left out; an answer that isn't in there is whole.
    """
    if lengths is not None:
        keys = blocks.select("block", F.posexplode("beam_ids").alias("i", "beam_id")).join(lengths.select("beam_id", F.col(length).cast("int").alias("n")), "beam_id")
        kept = keys.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("keep"))  # a block's answers at most
        blocks = blocks.join(kept, "block", "left")
    schema = "beam_id long, prompt_id long, y int, n int, " + ", ".join(f"{s} array<double>" for s in STREAMS)

    def task(batches):
        import pyarrow as pa

        for row in _rows(batches):
            out = []
            keep = dict(row["keep"]) if row.get("keep") else None
            for i, x in _answers(row, keep):
                found = statistics(x)
                out.append((row["beam_ids"][i], row["prompt_ids"][i], row["ys"][i], len(x), *(found[s].ravel().astype(float) for s in STREAMS)))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.float64())] * len(STREAMS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["beam_id", "prompt_id", "y", "n", *STREAMS])

    return blocks.mapInArrow(task, schema)
