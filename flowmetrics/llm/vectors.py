"""What the operators on vectors share: which rows count, and sums over tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmetrics.session import settle


def usable(rows: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """``key, v``: the rows whose vector is there and has only finite components; without ``zero``, not those of length 0.

    Vectors must have one number of components to be compared: that of most rows (the larger in a tie), or no row stays.
    """
    v = F.col("v")
    found = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where(v.isNotNull() & (F.size(v) > 0))
    finite = found.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    if not zero:
        finite = finite.where(F.exists(v, lambda c: c != 0))
    finite = settle(finite)
    common = finite.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head()
    return finite.where(F.size("v") == (common["size"] if common else 0))


def matrix(column: pa.Array, dtype=None) -> np.ndarray:
    """An Arrow list column without nulls, all of one length, as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(dtype or flat.dtype, copy=False)


def summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], kind: str = "double") -> np.ndarray:
    """The sum over all Arrow batches of ``of(batch)``, arrays of one length that does not depend on the input.

    Tasks add up their batches, Spark adds up the tasks by position; one number per position reaches the driver.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["part"])

    parts = rows.mapInArrow(part, f"part array<{kind}>")
    sums = parts.select(F.posexplode("part").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in sums], np.float64 if kind == "double" else np.int64)
