"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become integers and each distinct one counts once; the list of those is written, and
its covariance V is never formed. A pass over the list gives V @ Q for a block Q of a few
columns: tasks centre their rows and add up Xt (X Q), Spark adds up the tasks. Each round
applies a Chebyshev polynomial of V to the block, by its three-term recurrence, one pass a
degree: on the unwanted part of the spectrum it stays within one, above that it grows
steeply. That part ends at the block's least Ritz value and begins where a few Lanczos steps
put the spectrum's lower end. Then come QR and Rayleigh-Ritz. The
residuals V u - e u certify the wanted pairs: rounds go on until they are at the level of
rounding, or no longer fall.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import settle

GUARD, DEGREE, ROUNDS, STEPS = 12, 8, 60, 8
#: Residuals of so many roundings of the largest eigenvalue are taken for zero.
EXACT = 8.0
#: Scaled entries from here on cannot be added up exactly.
LARGEST = float(2**52)


def matrix(batch) -> np.ndarray:
    """The vectors x of a batch, rows of long."""
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(batch.num_rows, -1)


def in_parts(batches, rows: int = 4096):
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def scaled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Rows (vec_id, x) of usable vectors of the commonest length (the longest of equally common), and that length, 0 without rows."""
    fits = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * 256 < LARGEST))
    fits = F.coalesce((F.size("embedding") > 0) & fits, F.lit(False))
    rows = vectors.select("vec_id", "embedding").where(fits)
    common = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common.dims if common else 0
    return rows.where(F.size("embedding") == dims).select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * 256)).alias("x")), dims


def summed(batches):
    """Sums of each dimension, in two halves that stay exact, and the number of rows."""
    import pyarrow as pa

    low = high = None
    n = 0
    for batch in in_parts(batches):
        x = matrix(batch)
        parts = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
        low, high = parts if low is None else (low + parts[0], high + parts[1])
        n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high), pa.array(np.full(len(low), n))], names=["i", "low", "high", "n"])


def added(mean: np.ndarray, block: np.ndarray | None):
    """Xt (X Q) of a task's centred rows; without Q the squares of each dimension."""

    def run(batches):
        import pyarrow as pa

        total = None
        for batch in in_parts(batches):
            x = matrix(batch) - mean
            part = x.T @ (x @ block) if block is not None else (x * x).sum(axis=0)[:, None]
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["i", *(f"c{j}" for j in range(total.shape[1]))])

    return run


def totals(parts: DataFrame) -> list[tuple]:
    """The sums over tasks of rows (i, numbers), in order of i: as many rows as dimensions."""
    rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in parts.columns[1:])).collect()
    return [tuple(r)[1:] for r in sorted(rows)]


class Covariance:
    """V of a list of vectors x, known by its products; n, S and trace as attributes."""

    def __init__(self, fit: DataFrame):
        self.fit = fit
        sums = totals(fit.mapInArrow(summed, "i int, low long, high long, n long"))
        self.n = sums[0][2] if sums else 0
        self.S = [(high << 32) + low for low, high, _ in sums]
        self.mean = np.array([s / self.n for s in self.S])
        self.trace = float(self.times(None).sum()) if self.n else 0.0

    def times(self, block: np.ndarray | None) -> np.ndarray:
        width = 1 if block is None else block.shape[1]
        names = [f"c{j}" for j in range(width)]
        return np.array(totals(self.fit.mapInArrow(added(self.mean, block), "i int, " + ", ".join(f"{c} double" for c in names)))) / self.n


def filtered(times, block: np.ndarray, product: np.ndarray, low: float, cut: float, top: float, degree: int) -> np.ndarray:
    """The block under a Chebyshev polynomial that is small on low..cut and 1 at ``top``; ``product`` is V @ block."""
    half, middle = (cut - low) / 2, (cut + low) / 2
    sigma = first = half / (top - middle)
    before, now = block, (product - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, 2 * after / half * (times(now) - middle * now) - sigma * after * before
        sigma = after
    return now


def lower_end(times, dims: int) -> float:
    """Where the spectrum begins, as far as a few Lanczos steps tell; rather too low than too high."""
    basis = [np.random.default_rng(12).normal(size=dims)]
    basis[0] /= np.linalg.norm(basis[0])
    small = np.zeros((STEPS, STEPS))
    for k in range(STEPS):
        w = times(basis[k][:, None])[:, 0]
        for _ in range(2):
            for j, q in enumerate(basis):
                part = q @ w
                small[j, k] += part
                w = w - part * q
        beta = np.linalg.norm(w)
        if k + 1 == STEPS or beta <= 1e-10 * np.abs(small).max():
            break
        basis.append(w / beta)
    k = len(basis)
    values, turn = np.linalg.eigh(small[:k, :k], UPLO="U")
    return max(0.0, values[0] - 2 * beta * abs(turn[-1, 0]))


def leading(times, dims: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite V, eigenvectors as columns, and residual norms."""
    width = min(dims, wanted + GUARD)
    wanted = min(wanted, dims)
    block = np.linalg.qr(np.random.default_rng(11).normal(size=(dims, width)))[0]
    kept, stuck, low = None, 0, lower_end(times, dims) if width < dims else 0.0
    for _ in range(ROUNDS):
        product = times(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        residual = np.linalg.norm(product - block * values, axis=0)[:wanted]
        worst = residual.max()
        stuck = 0 if kept is None or worst < kept[2].max() / 2 else stuck + 1
        if kept is None or worst < kept[2].max():
            kept = values[:wanted].copy(), block[:, :wanted].copy(), residual
        top = max(values[0], 0.0)
        if worst <= EXACT * np.finfo(float).eps * top or (stuck >= 2 and worst <= 1e-12 * top) or top == 0:
            break
        low = 0.0 if stuck else low  # the lower end was guessed too high
        cut = min(max(values[-1], 1e-6 * top), 0.999 * top)
        block = filtered(times, block, product, min(low, 0.9 * cut), cut, top, DEGREE)
        block = np.linalg.qr(block / np.linalg.norm(block, axis=0))[0]
    values, vectors, residual = kept
    sign = np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0) < 0, -1.0, 1.0)
    return values, vectors * sign, residual


def squared(mean: np.ndarray, turn: np.ndarray):
    """Sums of the whitened rows of a task and of their products."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((turn.shape[1] + 1, turn.shape[1]))
        for batch in in_parts(batches):
            w = (matrix(batch) - mean) @ turn
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["i", *(f"c{j}" for j in range(turn.shape[1]))])

    return run


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def projected(n: int, S: list[int], mean: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float):
    def run(batches):
        import pyarrow as pa

        k = turn.shape[1]
        for batch in in_parts(batches):
            x = matrix(batch)
            if len(S) * (float(n) * max(np.abs(x).max(), 1) + max(map(abs, S))) ** 2 < 2**62:
                deviation = ((n * x - np.array(S)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [v if v < 2**63 else None for v in ((n * x.astype(object) - np.array(S, object)) ** 2).sum(axis=1)]
            white = (x - mean) @ turn
            rows = len(x)
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)),
                pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(white.ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])

    return run


def whitened(vectors: DataFrame, components: int = 4) -> DataFrame:
    """One row for each usable row of ``vectors`` (vec_id, embedding, any others) and leading component; see OUT.

    Usable: not null or empty, every entry finite and below 2**44 in size, of the commonest length.
    Each distinct scaled vector counts once in n, sums and covariance; repeated rows and rows
    without vec_id have their own result rows. Components without variance are left out, so a
    table with fewer than two different vectors gives no rows. deviation is null beyond a long.
    """
    rows, dims = scaled(vectors)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    fit = settle(rows.select("x").distinct(), "white-fit")
    v = Covariance(fit)
    if v.n < 2 or v.trace == 0:
        return vectors.sparkSession.createDataFrame([], OUT)
    values, turn, _ = leading(v.times, dims, components)
    real = values > dims * np.finfo(float).eps * values[0]
    turn, explained = turn[:, real] / np.sqrt(values[real]), values[real] / v.trace
    names = [f"c{j}" for j in range(turn.shape[1])]
    sums = np.array(totals(fit.mapInArrow(squared(v.mean, turn), "i int, " + ", ".join(f"{c} double" for c in names)))) / v.n
    error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(names))).max())
    return rows.mapInArrow(projected(v.n, v.S, v.mean, turn, explained, error), OUT)
