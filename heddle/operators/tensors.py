"""Gram matrices, truncated higher-order SVD, core projection and what it leaves, subspace angles.

Gram matrices are sums over rows, so each task adds up its own and the parts, of a size that depends on
the tensor's shape alone, are added up on the way; only the small eigenproblems are solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import sums


#: Channels whose Gram matrix is added up whole: 128 MB.
MOST_CHANNELS = 4096


def grams(packed: DataFrame, shape: tuple[int, ...]) -> DataFrame:
    """(mode, i, j, g): of every mode of the packed tensors x, sums over rows and the other modes of v[i] * v[j]."""

    def task(frames):
        import pandas as pd

        sums = [np.zeros((n, n)) for n in shape]
        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy()).reshape(-1, *shape).astype(np.float64)
                for mode, n in enumerate(shape):
                    flat = np.moveaxis(x, mode + 1, 0).reshape(n, -1)
                    sums[mode] += flat @ flat.T
        yield pd.DataFrame([(mode, i, row.tolist()) for mode, g in enumerate(sums) for i, row in enumerate(g)], columns=["mode", "i", "g"])

    parts = packed.select("x").mapInPandas(task, "mode int, i int, g array<double>")
    return parts.select("mode", "i", F.posexplode("g").alias("j", "v")).groupBy("mode", "i", "j").agg(F.sum("v").alias("g"))


def tucker(train: DataFrame, shape: tuple[int, ...], ranks: tuple[int, ...], offsets: tuple[int, ...] | None = None) -> list[np.ndarray]:
    """A factor for each mode: leading eigenvectors of its Gram matrix, after ``offsets`` of them are passed over."""
    offsets = offsets or (0,) * len(shape)
    if any(o + r > n for o, r, n in zip(offsets, ranks, shape, strict=True)):
        raise ValueError("offset and rank go past a mode's size")
    return [_top(m, r, o) for m, r, o in zip(gram_matrices(train, shape), ranks, offsets, strict=True)]


def gram_matrices(packed: DataFrame, shape: tuple[int, ...], column: str = "x") -> list[np.ndarray]:
    """``grams`` as arrays: what reaches the driver has the squares of the modes' sizes, in binary parts."""

    def part(f):
        x = np.stack(f["x"].to_numpy()).reshape(-1, *shape).astype(np.float64)
        flat = [np.moveaxis(x, mode + 1, 0).reshape(n, -1) for mode, n in enumerate(shape)]
        return np.concatenate([(m @ m.T).ravel() for m in flat])

    found = sums.added(packed.select(F.col(column).alias("x")), sum(n * n for n in shape), part)
    return [m.reshape(n, n) for m, n in zip(np.split(found, np.cumsum([n * n for n in shape])[:-1]), shape, strict=True)]


def _top(matrix: np.ndarray, rank: int, offset: int = 0) -> np.ndarray:
    """Leading eigenvectors; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(matrix)
    u = vectors[:, np.argsort(-values)][:, offset : offset + rank]
    return u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def hosvd(train: DataFrame, layers: int, channels: int, rank_l: int, rank_c: int, *, offset: int = 0, most: int = MOST_CHANNELS) -> tuple[np.ndarray, np.ndarray]:
    """Layer and channel factors from training rows (column x, layer-major); ``offset`` passes over channel directions.

    With more than ``most`` channels, whose Gram matrix is too much to hold, the channel factor comes from subspace iteration.
    """
    if channels > most:
        u_l, u_c = hosvd_randomised(train, layers, channels, rank_l, offset + rank_c)
        return u_l, u_c[:, offset:]
    u_l, u_c = tucker(train, (layers, channels), (rank_l, rank_c), (0, offset))
    return u_l, u_c


def hosvd_randomised(train: DataFrame, layers: int, channels: int, rank_l: int, rank_c: int, *, rounds: int = 4, extra: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """As ``hosvd`` where channels squared is too much to hold: the channel factor by subspace iteration from a random start.

    Each round is one job that adds up, over tasks, the Gram matrix times channels by ``rank_c + extra`` numbers.
    """
    width = min(channels, rank_c + extra)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((channels, width)))[0]
    for _ in range(rounds):

        def task(frames, q=q):
            import pandas as pd

            left, right = np.zeros((layers, layers)), np.zeros((channels, width))
            for f in frames:
                if len(f):
                    x = np.stack(f["x"].to_numpy()).reshape(-1, layers, channels).astype(np.float64)
                    left += np.einsum("nlc,nmc->lm", x, x)
                    flat = x.reshape(-1, channels)
                    right += flat.T @ (flat @ q)
            yield pd.DataFrame({"kind": [0] * layers + [1] * channels, "i": [*range(layers), *range(channels)], "g": [*left.tolist(), *right.tolist()]})

        parts = train.select("x").mapInPandas(task, "kind int, i int, g array<double>")
        cells = parts.select("kind", "i", F.posexplode("g").alias("j", "v")).groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))
        left, y = np.zeros((layers, layers)), np.zeros((channels, width))
        for r in cells.collect():  # layers squared, and channels times the width
            (y if r.kind else left)[r.i, r.j] = r.v
        small, before = q.T @ y, q
        q = np.linalg.qr(y)[0]
    return _top(left, rank_l), _signed(before @ _top((small + small.T) / 2, rank_c))


def _signed(u: np.ndarray) -> np.ndarray:
    return u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def basis_of_rows(matrix: DataFrame, width: int, rank: int, random_rank: int, *, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a matrix with a row of x each: its trailing right singular directions, as many random orthonormal ones, and the trailing ones' share of energy."""
    g = gram_matrices(matrix, (width,))[0]
    values, vectors = np.linalg.eigh(g)
    rank = min(rank, width)
    noise = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, random_rank)))[0]
    return _signed(vectors[:, :rank]), noise, float(values[:rank].sum() / values.sum())


def projected(packed: DataFrame, basis: np.ndarray) -> DataFrame:
    """Adds ``z``, x in the basis, and ``rms``, the root mean square of x."""

    @F.pandas_udf("array<double>")
    def times(x):
        import pandas as pd

        return pd.Series(list(np.stack(x.to_numpy()).astype(np.float64) @ basis)) if len(x) else pd.Series([], dtype=object)

    size = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") ** 2)
    return packed.withColumn("z", times("x")).withColumn("rms", F.sqrt(size / F.size("x")))


def core(packed: DataFrame, u_l: np.ndarray, u_c: np.ndarray) -> DataFrame:
    """Adds ``core``: the tensor in the factors' space, layer-major."""

    @F.pandas_udf("array<double>")
    def project(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        packed = np.stack(x.to_numpy()).reshape(-1, len(u_l), len(u_c)).astype(np.float64)
        return pd.Series(list((u_l.T @ (packed @ u_c)).reshape(len(packed), -1)))

    return packed.withColumn("core", project("x"))


def q_statistic(packed: DataFrame, u_l: np.ndarray, u_c: np.ndarray) -> DataFrame:
    """Squared norm of what the factors don't reach: in all, and by layer for the channel factor alone."""
    layers, channels = len(u_l), len(u_c)
    p_l, p_c = u_l @ u_l.T, u_c @ u_c.T

    def task(frames):
        import pandas as pd

        for f in frames:
            if len(f):
                x = np.stack(f["x"].to_numpy()).reshape(-1, layers, channels).astype(np.float64)
                rest = x - np.einsum("lm,nmc,cd->nld", p_l, x, p_c)
                by_layer = ((x - x @ p_c) ** 2).sum(2)
                yield pd.DataFrame({"beam_id": f["beam_id"], "q": (rest**2).sum((1, 2)), "q_layers": list(by_layer)})

    return packed.select("beam_id", "x").mapInPandas(task, "beam_id long, q double, q_layers array<double>")


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the angles between two subspaces, largest first; the bases are made orthonormal first."""
    a, b = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.clip(np.linalg.svd(a.T @ b, compute_uv=False), 0, 1)


def random_angles(size: int, rank: int, seed: int = 42) -> np.ndarray:
    """What ``principal_angles`` gives of two random subspaces."""
    rng = np.random.default_rng(seed)
    return principal_angles(*(np.linalg.qr(rng.standard_normal((size, rank)))[0] for _ in range(2)))


def shared_directions(cosines: np.ndarray, threshold: float = 0.5) -> int:
    return int((np.asarray(cosines) > threshold).sum())


def contrast(cores: DataFrame, train: Column, components: int = 32) -> DataFrame:
    """Of each answer against its prompt, from its ``core``: the difference from the prompt's mean in ``components`` principal
    directions of the training rows' differences, its norm and leverage, log of the prompt's leading eigenvalue, entropy and
    participation ratio of its spectrum, its log trace, and the size of the part along its leading direction.

    A prompt has few answers, so a group is one prompt.
    """
    size = len(cores.first()["core"])
    k = min(components, size)

    def solve(f):
        import pandas as pd

        d = np.stack(f["core"].to_numpy()).astype(np.float64)
        d = d - d.mean(0)
        squared = (d**2).sum(1)
        _, s, v = np.linalg.svd(d, full_matrices=False)
        e = s**2
        p = e / (e.sum() + 1e-12)
        p = p[p > 1e-12]
        n = len(f)
        return pd.DataFrame(
            {
                "beam_id": f["beam_id"],
                "fit": f["fit"],
                "delta": list(d),
                "norm": np.sqrt(squared),
                "leverage": squared / (squared.sum() + 1e-12),
                "log_lambda": [float(np.log(e[0] + 1e-8))] * n,
                "entropy": [float(-(p * np.log(p)).sum())] * n,
                "participation": [float(e.sum() ** 2 / ((e**2).sum() + 1e-12))] * n,
                "log_trace": [float(np.log(e.sum() + 1e-8))] * n,
                "leading": np.abs(d @ v[0]) if e[0] > 1e-10 else np.zeros(n),
            }
        )

    numbers = "norm double, leverage double, log_lambda double, entropy double, participation double, log_trace double, leading double"
    blocks = cores.select("beam_id", "prompt_id", "core", train.alias("fit")).groupBy("prompt_id").applyInPandas(solve, f"beam_id long, fit boolean, delta array<double>, {numbers}")
    n, first, second = moments(blocks.where("fit"), "delta")
    mean = first / max(1, n)
    v = _top(second / max(1, n) - np.outer(mean, mean), k)
    out = times(blocks, v, -mean @ v, "delta", "scores")
    return out.select("beam_id", "scores", *[c.split()[0] for c in numbers.split(", ")])


def spectral_concentration(packed: DataFrame, rows: int, columns: int, column: str, *, leading: int = 3) -> DataFrame:
    """Adds ``concentration``: the sum of a matrix's leading singular values over that of the others."""

    @F.pandas_udf("double")
    def share(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=float)
        s = np.linalg.svd(np.stack(x.to_numpy()).reshape(-1, rows, columns).astype(np.float64), compute_uv=False)
        return pd.Series(s[:, :leading].sum(1) / (s[:, leading:].sum(1) + 1e-9))

    return packed.withColumn("concentration", share(column))


def spectral_invariants(states: DataFrame, key: str, *, ridge: float = 1e-3) -> DataFrame:
    """Of a trajectory's states (pos, x): log of the leading eigenvalue of the ridged Gram matrix over its places, minus twice
    the log of its condition, and the slope of the states' log norms.  A group is one answer's tokens."""

    def solve(f):
        import pandas as pd

        f = f.sort_values("pos")
        x = np.stack(f["x"].to_numpy()).astype(np.float64)
        n = len(x)
        e = np.linalg.eigvalsh(x @ x.T / n + ridge * np.eye(n))
        logs, t = np.log(np.linalg.norm(x, axis=1) + 1e-9), np.arange(n) - (n - 1) / 2
        drift = float(t @ (logs - logs.mean()) / (t @ t + 1e-9))
        return pd.DataFrame({key: f[key][:1], "log_leading": [np.log(e[-1] + 1e-9)], "condition": [-2 * np.log(e[-1] / (e[0] + 1e-9))], "drift": [drift]})

    kind = states.schema[key].dataType.simpleString()
    return states.select(key, "pos", "x").groupBy(key).applyInPandas(solve, f"{key} {kind}, log_leading double, condition double, drift double")


def block_terms(states: DataFrame, key: str, streams: dict[str, tuple[np.ndarray, int, int]], layers: int, channels: int) -> DataFrame:
    """Of each stream (projection, layer rank, channel rank): the mean core of an answer's tokens, in the stream's own factors,
    and the share of its norm that the channel factor leaves."""
    out = None
    for name, (projection, rank_l, rank_c) in streams.items():
        inside = layer_times(states.select(key, F.transform("x", lambda v: v.cast("double")).alias("x")), projection, "x")
        u_l, u_c = hosvd(inside, layers, channels, rank_l, rank_c)
        both = without_directions(core(inside, u_l, u_c), u_c, "x", "rest")
        square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
        sizes = both.groupBy(key).agg((F.sqrt(F.sum(square("rest"))) / (F.sqrt(F.sum(square("x"))) + 1e-9)).alias(f"{name}_rest"))
        means = both.select(key, F.posexplode("core").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("v")).groupBy(key)
        part = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias(f"{name}_core")).join(sizes, key)
        out = part if out is None else out.join(part, key)
    return out


def moments(train: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sum and sum of outer products of a vector column; tasks add up their own."""
    one = train.select(column).first()
    if one is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    width = len(one[0])

    def part(f):
        x = np.stack(f["x"].to_numpy()).astype(np.float64)
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    found = sums.added(train.select(F.col(column).alias("x")), 1 + width + width * width, part)
    return int(found[0]), found[1 : width + 1], found[width + 1 :].reshape(width, width)


def layer_times(rows: DataFrame, matrices: np.ndarray, column: str, name: str | None = None) -> DataFrame:
    """A packed tensor's layers, each times its own matrix [layer, channels, new channels], or all times one [channels, new channels]."""
    shared = rows.sparkSession.sparkContext.broadcast(matrices)

    @F.pandas_udf("array<double>")
    def product(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        m = shared.value
        packed = np.stack(x.to_numpy()).astype(np.float64)
        parts = packed.reshape(len(packed), -1, m.shape[-2])
        return pd.Series(list((np.einsum("nlc,lcd->nld", parts, m) if m.ndim == 3 else parts @ m).reshape(len(packed), -1)))

    return rows.withColumn(name or column, product(column))


def without_directions(rows: DataFrame, directions: np.ndarray, column: str, name: str | None = None) -> DataFrame:
    """A packed tensor's layers, each without its own orthonormal directions [layer, channels, k], or all without the same [channels, k]."""
    shared = rows.sparkSession.sparkContext.broadcast(directions)

    @F.pandas_udf("array<double>")
    def rest(x):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype=object)
        v = shared.value
        packed = np.stack(x.to_numpy()).astype(np.float64)
        parts = packed.reshape(len(packed), -1, v.shape[-2])
        back = np.einsum("nlk,lck->nlc", np.einsum("nlc,lck->nlk", parts, v), v) if v.ndim == 3 else parts @ v @ v.T
        return pd.Series(list((parts - back).reshape(len(packed), -1)))

    return rows.withColumn(name or column, rest(column))


def times(rows: DataFrame, matrix: np.ndarray, shift: np.ndarray, column: str, name: str | None = None) -> DataFrame:
    """A vector column times a matrix, plus a shift."""

    @F.pandas_udf("array<double>")
    def product(x):
        import pandas as pd

        return pd.Series(list(np.stack(x.to_numpy()).astype(np.float64) @ matrix + shift)) if len(x) else pd.Series([], dtype=object)

    return rows.withColumn(name or column, product(column))
