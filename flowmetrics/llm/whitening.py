"""Whitening of vectors by shifted Cholesky QR.

``integers`` gives every vector as whole numbers ``x = floor(scale * c) + shift``, so that row counts, sums and deviations
are exact. ``fit`` finds the principal components of all rows:

* A first pass adds up ``n`` and the sums ``S`` of each dimension. Rows are centred as ``(n*x - S) / n`` from then on.
* A Gram pass adds up ``A'A`` of the centred rows. Its Cholesky factor, with a small multiple of the identity added so that
  it exists for ill-conditioned rows, is ``R1``. The next pass solves ``Q R1 = A`` row by row (triangular) and adds up
  ``Q'Q``, whose factor is ``R2``, and so on until ``Q'Q`` is the identity up to rounding. Then ``A = Q (Rk ... R2 R1)``,
  and the singular values and right vectors of that small product are those of ``A``.
* If the rows do not span all dimensions, ``Q'Q`` keeps its zeros; after ``MOST_PASSES`` its symmetric root takes the place
  of the last factor, which leaves the product's singular values right.

Each pass reads the settled rows once; a task adds up its rows, Spark adds up the tasks, and dimensions squared numbers
reach the driver. ``whiten`` returns the projections, and one more pass measures their covariance. No pass shuffles rows.

Rows whose vector is null, empty or holds null or non-finite entries take no part, nor rows with another number of
components than most rows have. Repeated rows count as often as they occur. A component without variance (one row, equal
rows, fewer rows than dimensions) has null ``whitened``; ``explained`` is null if no component has variance. Where
``deviation`` exceeds the range of a long, it is null. A null key stays null. Equal eigenvalues: any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import free_name
from flowmetrics.llm.vectors import matrix, summed, usable
from flowmetrics.session import settle

MOST_PASSES = 5
LONG = 2**63


def integers(rows: DataFrame, key: str, vector: str, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``key, x``: the vectors of :func:`usable` as whole numbers."""
    x = F.transform("v", lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(shift).cast("long"))
    return settle(usable(rows, key, vector, zero=True).select("key", x.cast("array<bigint>").alias("x")))


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``q`` with ``q r = a`` for an upper triangular ``r``, column by column."""
    q = np.empty_like(a)
    for j in range(r.shape[0]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


@dataclass
class Whitening:
    """``components``: a column each, by falling ``eigenvalues``; ``trace`` of the covariance; ``identity_error`` of the
    covariance of the whitened fit rows; ``passes``: Gram passes made."""

    n: int
    sums: np.ndarray
    wide: bool
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None
    passes: int = 0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n*x - S``, exact."""
        return self.n * (x.astype(object) if self.wide else x) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def projection(self) -> np.ndarray:
        """Maps centred rows to whitened ones; NaN for components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.components / np.sqrt(np.where(self.eigenvalues > 0, self.eigenvalues, np.nan))


def _shifted(gram: np.ndarray, n: int) -> np.ndarray:
    """The Cholesky factor of a Gram matrix with the shift that makes it exist: ``11 (n d + d (d + 1)) u |A|^2``."""
    d = len(gram)
    share = min(0.1, 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2)
    return np.linalg.cholesky(gram + share * np.linalg.norm(gram, 2) * np.eye(d)).T


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """Of ``rows`` (``key, x`` from :func:`integers`); None without rows."""
    some = rows.select("x").head()
    if some is None:
        return None
    d = len(some["x"])
    totals = summed(rows, lambda b: np.concatenate([[b.num_rows], matrix(b.column(1)).sum(0)]), "bigint")
    n, sums = int(totals[0]), totals[1:]
    most = rows.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).head()[0]
    model = Whitening(n, sums, n * (int(most) + 1) * 2 >= LONG, np.zeros(0), np.zeros((d, 0)), 0.0)
    factors: list[np.ndarray] = []

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        a = model.centred(matrix(batch.column(1)))
        q = a
        for r in factors:
            q = solved(q, r)
        return np.concatenate([(q.T @ q).ravel(), a.sum(0)])

    while True:
        found = summed(rows, moments)
        gram, rest = found[: d * d].reshape(d, d), found[d * d :] / n
        gram = (gram + gram.T) / 2
        model.passes += 1
        if model.passes == 1:
            model.trace = float(np.trace(gram)) / n
            if model.trace == 0:
                model.eigenvalues, model.components = np.zeros(min(d, components)), np.eye(d)[:, :components]
                return model
            factors.append(_shifted(gram, n))
        elif np.abs(gram - np.eye(d)).max() < 1e-10 * d or model.passes == MOST_PASSES:
            values, vectors = np.linalg.eigh(gram)
            # Directions with variance have come to about 1 by now, the others hold rounding errors.
            last = np.sqrt(np.where(values > 1e-6 * values[-1], values, 0))[:, None] * vectors.T
            break
        else:
            try:
                factors.append(np.linalg.cholesky(gram).T)
            except np.linalg.LinAlgError:
                factors.append(_shifted(gram, n))
    product = last
    for r in reversed(factors):
        product = product @ r
    _, singular, right = np.linalg.svd(product)
    values = np.where(singular > singular[0] * d * 16 * np.finfo(float).eps, singular**2 / n, 0)
    model.eigenvalues, model.components = values[:components], right[:components].T
    onto = model.projection()[:, model.eigenvalues > 0]
    k = onto.shape[1]
    middle = rest @ onto

    def covariance(batch: pa.RecordBatch) -> np.ndarray:
        w = model.centred(matrix(batch.column(1))) @ onto - middle
        return (w.T @ w).ravel()

    model.identity_error = float(np.abs(summed(rows, covariance).reshape(k, k) / n - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None, key: str) -> DataFrame:
    """Per row of ``rows`` (``key, x``) and component: ``key`` under its own name, ``component`` (from 1), ``n``,
    ``deviation`` (sum of squares of ``n*x - S``), ``whitened``, ``explained``, ``identity_error``. An output column that the
    key's name would clash with gets an underscore."""
    names = [free_name([key], c) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([T.StructField(key, rows.schema["key"].dataType), *[T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]])
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    onto, k = model.projection(), len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if model.trace > 0 else np.full(k, np.nan)

    def squares(difference: np.ndarray) -> pa.Array:
        about = (difference.astype(np.float64) ** 2).sum(1)
        if not model.wide and (about < LONG * 0.999).all():
            return pa.array((difference**2).sum(1), pa.int64())
        exact = (int(sum(int(v) ** 2 for v in row)) for row in difference)
        return pa.array([v if v < LONG else None for v in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            difference = model.deviations(matrix(batch.column(1)))
            w = (difference / model.n).astype(np.float64) @ onto
            row = pa.array(np.repeat(np.arange(batch.num_rows), k))
            each = lambda values: pa.array(np.tile(values, batch.num_rows), from_pandas=True)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(row), each(np.arange(1, k + 1, dtype=np.int32)), each(np.full(k, model.n)), squares(difference).take(row),
                pa.array(w.ravel(), from_pandas=True), each(explained), each(np.full(k, np.nan if model.identity_error is None else model.identity_error)),
            ], [key, *names])

    return rows.mapInArrow(project, schema)
