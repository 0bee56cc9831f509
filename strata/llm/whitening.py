"""Embedding whitening by a distributed Jacobi-Davidson iteration.

The covariance is never formed. Its products with a block of vectors are sums
over the rows, ``sum_i c_i (c_i^T Q) / n`` with centred rows ``c_i``, made inside
the tasks and added up by Spark; the driver sees blocks of (dimension x vectors)
numbers alone. From a random block, each round takes the Ritz pairs of the search
space, asks for corrections of the pairs whose residuals are not yet at double
precision (the others are locked: they stay in the space and cost nothing
more), solves all correction equations, projected against the Ritz vectors, by
some steps of MINRES side by side (one product a step for the whole block) and
widens the space by the solutions. The space is cut back to its best Ritz vectors
when it grows too wide.

Entries become integers ``x = floor(64 c) + 1000000``, so that sums are exact:
with S = n m + r, a centred entry is (x - m) - r/n, rounded only once.

Defined cases: a row whose vector is NULL or empty, holds a NULL, NaN or infinity,
or has another length than most rows (the longer one of equally common lengths)
is dropped; 64 c saturates at +-2^52; repeated rows and ids count each; without
rows, or where all rows are equal, the result is empty; components whose
eigenvalue is below 10^-11 of the largest (no direction of the data) are left
out; a ``deviation`` beyond 64 bits is NULL; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from strata.llm.common import settle

#: Scale and shift of an entry, largest scaled entry.
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 52
#: Residual of an accepted pair, and least eigenvalue of a component, as shares of the largest eigenvalue.
RESIDUAL, RANK = 1e-13, 1e-11
_LOW = 26


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]  # of x by dimension, exact
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # dimension x components, unit columns
    trace: float
    identity_error: float


# ------------------------------------------------------------ eigenpairs ----


def _minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``apply(x) = b``, a symmetric system by column."""
    over = lambda x, by: np.divide(x, by, out=np.zeros(np.broadcast(x, by).shape), where=by > 0)
    x, zero = np.zeros_like(b), np.zeros(b.shape[1])
    beta = np.linalg.norm(b, axis=0)
    v_old, v, w_old, w_older = np.zeros_like(b), over(b, beta), np.zeros_like(b), np.zeros_like(b)
    eta, beta = beta, zero
    cos, cos_old, sin, sin_old = zero + 1, zero + 1, zero, zero
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * v_old
        next_beta = np.linalg.norm(p, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        length = np.hypot(delta, next_beta)
        w = over(v - sin_old * beta * w_older - (sin * alpha + cos_old * cos * beta) * w_old, length)
        cos_old, cos, sin_old, sin = cos, over(delta, length), sin, over(next_beta, length)
        x = x + cos * eta * w
        eta = -sin * eta
        v_old, v, w_older, w_old, beta = v, over(p, next_beta), w_old, w, next_beta
    return x


def _new_directions(block: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``block`` beyond the orthonormal ``space``."""
    out = space
    for column in block.T:
        norm = np.linalg.norm(column)
        for _ in range(2):  # twice is enough
            column = column - out @ (out.T @ column)
        if norm > 0 and np.linalg.norm(column) > 1e-8 * norm:
            out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, space.shape[1] :]


def jacobi_davidson(
    product: Callable[[np.ndarray], np.ndarray], size: int, k: int, steps: int = 4, rounds: int = 100, seed: int = 1
) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of the
    symmetric positive semidefinite operator ``product`` on ``size`` numbers."""
    k = min(k, size)
    block = min(size, k + max(4, k // 4))  # some more, to keep the last wanted ones apart
    widest = min(size, 3 * block)
    space = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, block)))[0]
    image = product(space)
    for _ in range(rounds):
        h = space.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, ritz_image = space @ turn, image @ turn
        residual = ritz_image - ritz * values
        left = np.flatnonzero(np.linalg.norm(residual[:, :k], axis=0) > RESIDUAL * max(values[0], 0.0))
        if not len(left) or space.shape[1] == size:  # a whole space is invariant
            return values[:k], ritz[:, :k]
        if space.shape[1] + len(left) > widest and space.shape[1] > 2 * block:
            ritz, ritz_image = ritz[:, : 2 * block], ritz_image[:, : 2 * block]
        space, image = ritz, ritz_image
        against, shift = ritz[:, :block], values[left]
        project = lambda z: z - against @ (against.T @ z)  # noqa: B023, E731

        def shifted(z: np.ndarray) -> np.ndarray:
            z = project(z)  # noqa: B023
            return project(product(z) - z * shift)  # noqa: B023

        wider = _new_directions(_minres(shifted, -project(residual[:, left]), steps), space)
        if not wider.shape[1]:
            wider = _new_directions(residual[:, left], space)
        if not wider.shape[1]:
            return values[:k], ritz[:, :k]  # nothing left to correct in double precision
        space, image = np.column_stack([space, wider]), np.column_stack([image, product(wider)])
    raise RuntimeError(f"residuals did not reach {RESIDUAL} of the largest eigenvalue in {rounds} rounds")


# -------------------------------------------------------------- products ----


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _added(x: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``part(rows)``, an array of ``shape``: summed
    inside each task, then by row of the array."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(_matrix(batch.column(0), size))
                total = more if total is None else total + more
        if total is not None:
            columns = [pa.array(np.arange(shape[0]), pa.int64()), pa.array(list(total), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["at", "v"])

    sums = (
        x.select("x")
        .mapInArrow(tasks, "at bigint, v array<double>")
        .groupBy("at")
        .agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(shape[1])])
    )
    out = np.zeros(shape)
    for row in sums.collect():  # as many rows as the array has
        out[row["at"]] = row[1:]
    return out


def _centre(n: int, sums: tuple[int, ...]) -> Callable[[np.ndarray], np.ndarray]:
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return lambda x: (x - base).astype(np.float64) - rest


def _exact_sums(x: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    """Number of rows and sums of x by dimension, in two halves of 26 bits and
    more so that no sum overflows."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            m = _matrix(batch.column(0), size)
            n, high, low = n + len(m), high + (m >> _LOW).sum(axis=0), low + (m & ((1 << _LOW) - 1)).sum(axis=0)
        if n:
            columns = [np.arange(size), np.full(size, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["at", "n", "high", "low"])

    parts = x.select("x").mapInArrow(tasks, "at bigint, n bigint, high bigint, low bigint")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    rows = sorted(rows.collect(), key=lambda r: r["at"])
    return (rows[0]["n"], tuple((r["high"] << _LOW) + r["low"] for r in rows)) if rows else (0, ())


# ------------------------------------------------------------- interface ----


def integers(rows: DataFrame, vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, int]:
    """(key, x) of the rows that remain, stored, and their dimension."""
    entries = F.transform(F.col("v"), lambda c: c.cast("double"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    bounded = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    good = (
        rows.select(F.col(key).alias("id"), F.col(vector).alias("v"))
        .withColumn("v", entries)
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(whole, F.lit(False)))
        .select("id", F.transform("v", lambda c: F.floor(bounded(c)) + SHIFT).alias("x"))
    )
    stored = settle(good, "integer-vectors")
    common = stored.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    size = common["d"] if common else 0
    return stored.where(F.size("x") == size), size


def fit(x: DataFrame, size: int, components: int = 32) -> Whitening | None:
    """The whitening of ``integers()``; None where no direction is left."""
    n, sums = _exact_sums(x, size) if size else (0, ())
    if not n:
        return None
    centre = _centre(n, sums)
    trace = float(_added(x, lambda m: (centre(m) ** 2).sum(axis=0)[None, :], size, (1, size)).sum()) / n
    if not trace > 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = centre(m)
            return c.T @ (c @ q)

        return _added(x, part, size, q.shape) / n

    values, vectors = jacobi_davidson(product, size, components)
    kept = int((values > RANK * values[0]).sum())
    values, vectors = values[:kept], vectors[:, :kept]
    turn = vectors / np.sqrt(values)
    mean = _added(x, lambda m: (centre(m) @ turn).sum(axis=0)[None, :], size, (1, kept)) / n

    def square(m: np.ndarray) -> np.ndarray:
        w = centre(m) @ turn - mean
        return w.T @ w

    error = float(np.abs(_added(x, square, size, (kept, kept)) / n - np.eye(kept)).max())
    return Whitening(n, sums, values, vectors, trace, error)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums over the dimensions of (n x - S)^2."""
    base, rest = [s // n for s in sums], [s % n for s in sums]
    off = x - np.array(base, np.int64)
    largest = n * (int(np.abs(off).max(initial=0)) + 1)
    if largest * largest * max(len(sums), 1) < 1 << 63:
        return ((n * off - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(x: DataFrame, size: int, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """A row per row of ``x`` and component: (key, component, n, deviation,
    whitened, explained, identity_error)."""
    schema = StructType().add(key, x.schema["id"].dataType).add("component", IntegerType()).add("n", LongType())
    schema = schema.add("deviation", LongType())
    for name in ("whitened", "explained", "identity_error"):
        schema = schema.add(name, DoubleType())
    if model is None:
        return x.sparkSession.createDataFrame([], schema)
    n, sums, error = model.n, model.sums, model.identity_error
    centre, turn, explained = _centre(n, sums), model.vectors / np.sqrt(model.values), model.values / model.trace
    k, names = len(explained), schema.names

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), size)
            w, rows = centre(m) @ turn, len(m)
            of = pa.array(np.repeat(np.arange(rows), k))
            deviation = pa.array(_deviations(m, n, sums), pa.int64()) if rows else pa.array([], pa.int64())
            columns = [
                batch.column(0).take(of),
                pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                pa.array(np.full(rows * k, n), pa.int64()),
                deviation.take(of),
                pa.array(w.reshape(-1)),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return x.select("id", "x").mapInArrow(tasks, schema)
