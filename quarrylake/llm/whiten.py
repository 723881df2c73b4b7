"""Whitening of vectors by the leading principal components, found by a randomised range finder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Components returned, columns of the range finder beyond them, passes that multiply by the covariance before Rayleigh-Ritz.
COMPONENTS, OVERSAMPLE, POWERS = 16, 16, 3
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: A component is taken from the range finder if its residual is at most this part of the gap to the next eigenvalue.
RESIDUAL = 1e-11
#: Scaled entries of this size or more don't fit 64 bits with room for a difference, and count as non-finite.
LARGEST = 2.0**61

Sums = dict[int, np.ndarray]


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, size, u): the rows that take part; u is floor(64 c) for each entry c, without the offset."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = F.coalesce(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST / SCALE)), F.lit(False)) & (F.size("v") > 0)
    return rows.where(usable).select("id", F.size("v").alias("size"), F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("u"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(size, matrix of longs, its rows), for rows of one size at a time, of at most about 2 million entries."""
    for batch in batches:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        for size in np.unique(sizes).tolist():
            some = batch.take(pa.array(np.flatnonzero(sizes == size)))
            step = max(1, 2_000_000 // size)
            for i in range(0, some.num_rows, step):
                part = some.slice(i, step)
                yield size, part.column("u").flatten().to_numpy(zero_copy_only=False).reshape(-1, size), part


def _summed(fit: DataFrame, of: Callable[[int, np.ndarray], np.ndarray]) -> Sums:
    """For each size the sum over the fit list of the matrices that `of` (size, rows) gives.

    A task adds up its own rows and sends a row for each entry; entries of all
    tasks are added by Spark, so the driver gets one matrix a size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Sums = {}
        for size, u, _ in _parts(batches):
            now = of(size, u)
            mine[size] = mine[size] + now if size in mine else now
        for size, m in mine.items():
            i, j = np.indices(m.shape, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, size, np.int32)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], names=["size", "i", "j", "v"])

    cells = fit.mapInArrow(run, "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for size, g in cells.groupby("size"):
        out[int(size)] = np.zeros((g["i"].max() + 1, g["j"].max() + 1))
        out[int(size)][g["i"], g["j"]] = g["v"]
    return out


@dataclass
class Model:
    """One length's fit: n distinct rows, `sums` of u by dimension, unit `axes` in columns, their eigenvalues, the trace of the
    covariance, and whether all dimensions had to be the span."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    whole: bool
    identity_error: float = 0.0

    def centred(self, u: np.ndarray) -> np.ndarray:
        """u minus its mean. The whole part of the mean is taken off exactly, before anything is a double."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (u - base).astype(np.float64) - rest

    def whitened(self, u: np.ndarray) -> np.ndarray:
        return self.centred(u) @ self.axes / np.sqrt(self.values)

    def deviation(self, u: np.ndarray) -> list[Decimal]:
        """The exact sum over dimensions of (n u - sum) ** 2 for each row."""
        most = max(abs(int(u.min())), abs(int(u.max()))) * self.n + max(map(abs, self.sums))
        if most >= 2**52 or u.shape[1] > 1000:
            rows = [[self.n * x - s for x, s in zip(r, self.sums)] for r in u.tolist()]
            return [Decimal(sum(x * x for x in r)) for r in rows]
        a = u * self.n - np.array(self.sums, np.int64)
        high, low = a >> 26, a & (2**26 - 1)
        return [Decimal((x << 52) + (y << 27) + z) for x, y, z in zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())]


def _moments(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each size the number of rows and the exact sums of each dimension; a batch adds halves of each entry apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, list] = {}
        for size, u, _ in _parts(batches):
            now = mine.setdefault(size, [0, [0] * size])
            high, low = (u >> 31).sum(0).tolist(), (u & (2**31 - 1)).sum(0).tolist()
            now[0] += len(u)
            now[1] = [s + (h << 31) + k for s, h, k in zip(now[1], high, low)]
        for size, (n, sums) in mine.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["size", "i", "n", "s"])

    cells = fit.mapInArrow(run, "size int, i int, n long, s decimal(38,0)").groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(cells, key=lambda r: (r["size"], r["i"])):
        out.setdefault(r["size"], (r["n"], []))[1].append(int(r["s"]))
    return out


def _trials(z: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz in the span of q's columns, where z is the covariance times q: values (falling), vectors, residual norms."""
    t = q.T @ z
    values, turn = np.linalg.eigh((t + t.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    axes = q @ turn
    return values, axes, np.linalg.norm(z @ turn - axes * values, axis=0)


def _good(values: np.ndarray, residuals: np.ndarray, k: int, d: int) -> bool:
    """Whether the first k residuals are small against the gaps between eigenvalues, or too small to tell from rounding."""
    if len(values) <= k < d:
        return False
    gaps = np.full(k, np.inf)
    steps = -np.diff(values[: k + 1])
    gaps[: len(steps)] = np.minimum(gaps[: len(steps)], steps[:k])
    gaps[1:] = np.minimum(gaps[1:], steps[: k - 1])
    floor = 8 * np.finfo(float).eps * max(values[0], 0.0)
    return bool((residuals[:k] <= np.maximum(RESIDUAL * gaps, floor)).all())


def fit_components(fit: DataFrame, components: int = COMPONENTS, oversample: int = OVERSAMPLE, powers: int = POWERS, seed: int = 12) -> dict[int, Model]:
    """A model for each length of the vectors in `fit` (size, u), one row each.

    A random matrix of components + oversample columns is multiplied by the
    covariance `powers` times, orthonormalised between; each time is a pass over
    all rows, centred. Rayleigh-Ritz in the span gives the components, and what
    it multiplied gives the residuals. A length whose residuals are too large is
    done again with all dimensions as the span, where Rayleigh-Ritz is exact but
    for rounding. Eigenvalues that rounding can't tell from zero are left out.
    The driver holds the moments and matrices of d x (components + oversample),
    d x d at the most, for each length.
    """
    models = {size: Model(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0, False) for size, (n, sums) in _moments(fit).items()}
    if not models:
        return models
    spans = {size: np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, min(size, components + oversample))))[0] for size in models}

    def times(spans: dict[int, np.ndarray]) -> Sums:
        def of(size: int, u: np.ndarray) -> np.ndarray:
            x = models[size].centred(u)
            # The last row is each dimension's square sum, for the trace.
            product = x.T @ (x @ spans[size])
            return np.vstack([product, np.full((1, product.shape[1]), (x * x).sum())]) / models[size].n

        part = fit.where(F.col("size").isin(list(spans))) if len(spans) < len(models) else fit
        return _summed(part, of)

    for _ in range(powers):
        spans = {size: np.linalg.qr(z[:-1])[0] if np.abs(z).max() > 0 else spans[size] for size, z in times({s: q for s, q in spans.items() if q.shape[1] < s}).items()} | {s: q for s, q in spans.items() if q.shape[1] == s}
        if all(q.shape[1] == s for s, q in spans.items()):
            break
    again: dict[int, np.ndarray] = {}
    for turn in range(2):
        for size, z in times(spans if turn == 0 else again).items():
            q, model = (spans if turn == 0 else again)[size], models[size]
            model.trace = float(z[-1, 0])
            values, axes, residuals = _trials(z[:-1], q)
            k = min(components, size)
            model.whole = q.shape[1] == size
            if not model.whole and not _good(values, residuals, k, size):
                again[size] = np.eye(size)
                continue
            real = values[:k] > size * np.finfo(float).eps * max(values[0], 0.0)
            model.values, model.axes = values[:k][real], axes[:, :k][:, real]
        if not again:
            break
    seen = _summed(fit.where(F.col("size").isin([s for s, m in models.items() if len(m.values)])), lambda size, u: (w := models[size].whitened(u)).T @ w / models[size].n)
    for size, m in seen.items():
        models[size].identity_error = float(np.abs(m - np.eye(len(m))).max())
    return models


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, oversample: int = OVERSAMPLE, powers: int = POWERS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row of `vectors` and component.

    Vectors that are null or empty, or hold entries that are null, non-finite or
    of 2**55 and more, give no row. Vectors of each length are fitted apart, over
    their distinct scaled vectors; every row is projected, repeated ids and
    vectors too, and a null id stays null. A length has as many components as it
    has eigenvalues above rounding, 16 at most: one distinct vector has none, so
    its rows don't appear. deviation is a decimal(38, 0), null beyond that. Of
    equal eigenvalues the vectors are any orthonormal ones of their span. An
    empty table gives an empty table; other columns aren't read.
    """
    rows = scaled(vectors, id_col, vector_col)
    fit = stored(rows.select("size", "u").distinct(), "fit")
    models = {size: m for size, m in fit_components(fit, components, oversample, powers).items() if len(m.values)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, u, part in _parts(batches):
            m = models.get(size)
            if m is None:
                continue
            w, k = m.whitened(u), len(m.values)
            each = pa.array(np.repeat(np.arange(len(u)), k))
            deviation = pa.array([d if abs(d) < Decimal(10) ** 38 else None for d in m.deviation(u)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(u))), pa.array(np.full(w.size, m.n)), deviation.take(each), pa.array(w.ravel()), pa.array(np.tile(m.values / m.trace, len(u))), pa.array(np.full(w.size, m.identity_error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # A deviation beyond 64 bits is null here; the operator has it as a decimal.
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error")
