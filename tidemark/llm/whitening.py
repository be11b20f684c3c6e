"""Whitening of embeddings: randomised range finder, power passes over all rows, Rayleigh-Ritz.

The fit list holds every distinct quantised vector once. A pass multiplies the covariance V of the fit list
by a thin basis Q without V ever being whole in one place: a task centres its rows c and adds up c'(cQ), and the
sums of the tasks are added up by a shuffle on the place in the result. From Q and VQ follow both the next basis and, by
Rayleigh-Ritz, the components with their residuals. Once the residuals show the components to double precision the passes
end; if they don't within POWER passes, as with a flat spectrum, the basis is widened to the full dimension, where one pass
is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize

OVERSAMPLE, POWER = 8, 4
# Error of a component that its residual, as a share of the gap to the next value, may show.
TOLERANCE = 1e-12
# Values below this share of the trace are no variance but rounding.
FLAT = 1e-13
CHUNK = 4096


def quantized(embedding: Column, scale: int) -> Column:
    """Each entry as long floor(scale * entry); entries beyond a long become the largest or smallest one."""
    return F.transform(embedding, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def usable(embedding: Column) -> Column:
    """Not null and all entries finite numbers."""
    bound = float(np.finfo(np.float64).max)
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) <= bound, F.lit(False))), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _chunks(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, len(batch), CHUNK):
            part = batch.slice(k, CHUNK)
            yield part, _matrix(part.column(at), dim)


def column_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sums S of each dimension: high and low halves are added up in longs by chunk, then as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches, 0, dim):
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, len(part))), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    sums = fit.select("x").mapInArrow(run, "at long, n long, high long, low long").groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")))
    rows = sorted(sums.collect())  # one row a dimension
    return rows[0].n, [int(r.high) * (1 << 32) + int(r.low) for r in rows]


def times_covariance(fit: DataFrame, mean: np.ndarray, n: int, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """V @ basis and the trace of V. A task sends dim x width sums however many rows it has."""
    dim, width = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, trace = np.zeros((dim, width)), 0.0
        for _, x in _chunks(batches, 0, dim):
            c = x - mean
            total += c.T @ (c @ basis)
            trace += float((c * c).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * width + 1)), pa.array(np.append(total.ravel(), trace))], ["at", "v"])

    rows = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # dim * width + 1 rows
    out = np.zeros(dim * width + 1)
    for at, v in rows:
        out[at] = v
    return out[:-1].reshape(dim, width) / n, float(out[-1]) / n


def rayleigh_ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), unit vectors and residual norms of V within the span of basis, from image = V @ basis."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def fit_components(fit: DataFrame, dim: int, n: int, mean: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest values of V that aren't rounding, their vectors (dim x k) and the trace."""
    width = k + OVERSAMPLE
    basis = np.eye(dim) if width >= dim else np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    tried = 0
    while True:
        image, trace = times_covariance(fit, mean, n, basis)
        values, vectors, residuals = rayleigh_ritz(basis, image)
        if basis.shape[1] == dim:
            break
        gaps = np.abs(np.diff(values))[: k]  # of each component to the next; the one before has the same gap or is seen before
        near = np.minimum(gaps, np.append(np.inf, gaps[:-1]))
        if tried and (residuals[:k] <= TOLERANCE * near).all() or trace == 0:
            break
        tried += 1
        basis = np.linalg.qr(image)[0] if tried <= POWER else np.eye(dim)
    keep = int((values[:k] > FLAT * trace).sum())
    return values[:keep], vectors[:, :keep], trace


def identity_error(fit: DataFrame, dim: int, n: int, mean: np.ndarray, whiten: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by a pass over the fit list."""
    k = whiten.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for _, x in _chunks(batches, 0, dim):
            w = (x - mean) @ whiten
            total += w.T @ w
            first += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.append(total.ravel(), first))], ["at", "v"])

    rows = fit.select("x").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * k + k rows
    out = np.zeros(k * k + k)
    for at, v in rows:
        out[at] = v / n
    # The rows are centred; what rounding leaves of the mean is taken off.
    return float(np.abs(out[: k * k].reshape(k, k) - np.outer(out[k * k :], out[k * k :]) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exactly; None where that is beyond a long."""
    far = np.abs(x.astype(np.float64) * n - np.array(sums, np.float64)).max(1, initial=0)
    large = max((abs(s) for s in sums), default=0) >= 1 << 62
    safe = (far**2 * x.shape[1] < 2.0**62) & (np.abs(x).max(1, initial=0) * float(n) < 2.0**62) & (not large)
    out: list[int | None] = [None] * len(x)
    if safe.any():
        d = x[safe] * n - np.array(sums, np.int64)
        for at, v in zip(np.flatnonzero(safe).tolist(), (d * d).sum(1).tolist()):
            out[at] = v
    for at in np.flatnonzero(~safe).tolist():
        v = sum((n * a - s) ** 2 for a, s in zip(x[at].tolist(), sums))
        out[at] = v if v < 1 << 63 else None
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten_one(rows: DataFrame, dim: int, components: int) -> DataFrame:
    fit = materialize(rows.select("x").distinct(), "whitening-fit", "zstd")
    n, sums = column_sums(fit, dim)
    mean = np.array([s / n for s in sums])
    values, vectors, trace = fit_components(fit, dim, n, mean, min(components, dim))
    k, whiten = len(values), vectors / np.sqrt(values)
    error = identity_error(fit, dim, n, mean, whiten) if k else 0.0
    explained = (values / trace).tolist() if k else []
    discard(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches, 1, dim):
            w, m = (x - mean) @ whiten, len(part)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array([d for d in deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(explained, m).astype(np.float64)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, SCHEMA)


def whiten(df: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each usable row and component: its whitened value beside n, deviation, explained, identity_error.

    Rows whose vector is null or holds null, NaN or infinite entries are left out, before fit and result. Entries become
    whole numbers, floor(scale * entry); equal vectors count once in the fit and have equal results. Vectors of different
    length have no covariance in common: those of each length are fitted and whitened by themselves (an empty vector has no component).
    Components without variance can't be whitened and have no rows: a table of equal vectors gives none, nor does an
    empty one. Null and repeated ids and repeated rows each keep rows of their own. deviation is null where it is
    beyond a long. Other columns aren't read.
    """
    spark: SparkSession = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("e")).where(usable(F.col("e"))).select("vec_id", quantized(F.col("e"), scale).alias("x"))
    dims = sorted(r[0] for r in rows.select(F.size("x").alias("d")).distinct().collect())  # lengths, not rows
    parts = [_whiten_one(rows.where(F.size("x") == d) if len(dims) > 1 else rows, d, components) for d in dims if d]
    out = spark.createDataFrame([], SCHEMA) if not parts else parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
