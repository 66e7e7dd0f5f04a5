"""Quality by pairwise ranking (Bradley-Terry): a good text should beat a bad one.

A text's strength is a weighted sum of surface features. The weights maximise the likelihood of all preference pairs (one
row labelled 1, one labelled 0): logistic loss on the difference of their features. Pairs are never formed: a pair's loss
depends on two strengths only, so every Newton step adds up all rows by label and narrow cell of strength (number, strength,
features and their products), and the driver pairs cells at their mean strengths. The threshold is the exact quantile of all
training strengths at the share of rows labelled 0, so the share of rejected rows follows the labels; scores are the
logistic of the strength, shifted so that the threshold gets ``cut``.

Null and empty texts have all features 0 and get their score like any other; without rows of both labels every score
is 0.5. Every row keeps its place, repeated rows get equal scores, only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import free_name, slices
from flowmetrics.operators.order_stats import quantiles
from flowmetrics.session import settle

FEATURES = ("symbols", "capital_runs", "repeats", "distinct", "distinct_pairs", "digits", "stops", "word_length", "log_words")
#: Cells a unit of strength up to ``EVEN``; behind it cells a factor of e, as pairs with such a strength are decided.
PER_UNIT, EVEN, PER_FACTOR = 32, 16.0, 64


def _kinds() -> np.ndarray:
    kinds = np.zeros((256, 5), np.int64)
    for i in range(128):
        c = chr(i)
        kinds[i] = [not c.isalnum() and not c.isspace() and c not in ".,'-", c.isupper(), c.isdigit(), c in ".,", c.isalpha()]
    kinds[128:, 4] = 1
    return kinds.astype(np.uint8)


KINDS = _kinds()


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.concatenate([[0], ends])])


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text (no nulls)."""
    n = len(texts)
    sizes = pc.binary_length(texts).to_numpy().astype(np.int64)
    ends, words = np.cumsum(sizes), pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
    symbols, capitals, digits, stops, letters = (_sums(KINDS[data, k], ends) for k in range(5))
    upper = KINDS[data, 1]
    runs = _sums(np.concatenate([[0], upper[1:] & upper[:-1]]) if len(data) else upper, ends)
    index = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
    count = np.diff(words.offsets.to_numpy()).astype(np.int64)
    row = np.repeat(np.arange(n), count)
    same_row = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    before = np.concatenate([[0], index[:-1]]) if len(index) else index
    repeats = np.bincount(row[same_row & (index == before)], minlength=n)
    distinct = np.bincount(np.unique(row << 32 | index) >> 32, minlength=n)
    width = int(index.max()) + 1 if len(index) else 1
    pair, of = before[same_row] * width + index[same_row], row[same_row]
    by_row = np.lexsort((pair, of))
    pair, of = pair[by_row], of[by_row]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    pairs = np.bincount(of[new], minlength=n)
    some, size = np.maximum(1, count), np.maximum(1, sizes)
    return np.stack([
        np.log1p(50 * symbols / size), np.log1p(20 * runs / np.maximum(1, letters)), np.sqrt(repeats / some),
        np.log(np.maximum(1, distinct)) - np.log(some), np.log(np.maximum(1, pairs)) - np.log(np.maximum(1, count - 1)),
        digits / size, stops / some, np.log1p(letters / some), np.log(some),
    ], axis=1).astype(np.float64)


@dataclass
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Summed feature by feature, so that equal texts have equal strengths in batches of any size."""
        total = np.zeros(len(x))
        for j, w in enumerate(self.weights):
            total += (x[:, j] - self.centre[j]) / self.spread[j] * w
        return total

    def score(self, x: np.ndarray, cut: float) -> np.ndarray:
        z = np.clip(self.strength(x) - self.threshold + np.log(cut / (1 - cut)), -500, 500)
        return 1 / (1 + np.exp(-z))


def _newton(size: int, slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], penalty: float, steps: int, close: float) -> np.ndarray:
    """Weights from Newton steps; ``slopes`` gives the likelihood's gradient and curvature, per pair."""
    w = np.zeros(size)
    for _ in range(steps):
        gradient, curvature = slopes(w)
        step = np.linalg.solve(curvature + penalty * np.eye(size), gradient - penalty * w)
        w = w + step
        if np.abs(step).max() < close:
            break
    return w


def fit_pairs(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights that maximise the likelihood of ``better`` beating ``worse`` row by row (Newton steps)."""
    d = better - worse

    def slopes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        return d.T @ p / len(d), (d * (p * (1 - p))[:, None]).T @ d / len(d)

    return _newton(d.shape[1], slopes, penalty, steps, 1e-8)


def _cells(strength: np.ndarray) -> np.ndarray:
    size = np.abs(strength)
    far = PER_UNIT * EVEN + PER_FACTOR * np.log(np.maximum(size, EVEN) / EVEN)
    return np.floor(np.sign(strength) * np.where(size <= EVEN, PER_UNIT * size, far)).astype(np.int64)


def _cell_sums(rows: DataFrame, model: Ranking) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For label 0 and 1: number, strength, features and their products, summed over all rows of each cell of strength."""
    d = len(model.weights)
    width = 2 + d + d * d

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros((0, width))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            strength, z = model.strength(x), (x - model.centre) / model.spread
            each = np.concatenate([np.ones((len(x), 1)), strength[:, None], z, (z[:, :, None] * z[:, None, :]).reshape(len(x), d * d)], axis=1)
            found, at = np.unique(np.concatenate([keys, _cells(strength) * 2 + batch.column(0).to_numpy()]), return_inverse=True)
            every, keys = np.concatenate([sums, each]), found
            sums = np.stack([np.bincount(at, every[:, j], len(found)) for j in range(width)], axis=1)
        if len(keys):
            key = (keys[:, None] * width + np.arange(width)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums.ravel())], ["key", "total"])

    table = rows.mapInArrow(part, "key long, total double").groupBy("key").agg(F.sum("total").alias("total")).orderBy("key").toArrow()
    first, total = table.column("key").to_numpy()[::width] // width, table.column("total").to_numpy().reshape(-1, width)
    sides = [total[first % 2 == label] for label in (0, 1)]
    return [(t[:, 0], t[:, 1], t[:, 2 : 2 + d], t[:, 2 + d :].reshape(-1, d, d)) for t in sides]


def _slopes(rows: DataFrame, model: Ranking) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature over all pairs of a row labelled 1 and one labelled 0, at the weights of ``model``."""
    (n0, s0, x0, xx0), (n1, s1, x1, xx1) = _cell_sums(rows, model)
    p = 1 / (1 + np.exp(np.clip((s1 / n1)[:, None] - s0 / n0, -500, 500)))
    q = p * (1 - p)
    pairs = n1.sum() * n0.sum()
    gradient = (p @ n0) @ x1 - (n1 @ p) @ x0
    cross = x1.T @ q @ x0
    curvature = np.tensordot(q @ n0, xx1, 1) + np.tensordot(n1 @ q, xx0, 1) - cross - cross.T
    return gradient / pairs, curvature / pairs


def _measured(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``label, x`` of every labelled document. Features are measured before the join, so that no text is shuffled."""
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).where("label in (0, 1)").distinct()
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(features(texts)), pa.list_(pa.float64()))], ["key", "x"])

    schema = T.StructType([chosen.schema["key"], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return chosen.mapInArrow(measure, schema).join(known, "key").select("label", "x")


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, penalty: float = 1e-3, steps: int = 50) -> Ranking | None:
    """Fit on every labelled document and all pairs of them; only sums per cell of strength reach the driver.

    Rows of ``labels`` without a document do not count.
    """
    rows = settle(_measured(docs, labels, key, text, label))
    moments = [f(F.col("x")[j]).alias(f"{name}{j}") for j in range(len(FEATURES)) for name, f in (("mean", F.avg), ("spread", F.stddev_pop))]
    whole = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("bad"), *moments).first()
    if not 0 < whole["bad"] < whole["n"]:
        return None
    centre, spread = (np.array([whole[f"{name}{j}"] for j in range(len(FEATURES))]) for name in ("mean", "spread"))
    model = Ranking(centre, np.maximum(spread, 1e-6), np.zeros(len(FEATURES)), 0.0)
    at = lambda w: Ranking(model.centre, model.spread, w, 0.0)
    # cells move with the weights, which leaves steps of about 1e-6 however long it goes on
    model = at(_newton(len(FEATURES), lambda w: _slopes(rows, at(w)), penalty, steps, 1e-4))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(model.strength(x))], ["strength"])

    strengths = rows.select("x").mapInArrow(rate, "strength double")
    middle = (whole["bad"] - 0.5) / (whole["n"] - 1)
    model.threshold = quantiles(strengths, [], {"threshold": ("strength", middle)}).first()["threshold"]
    return model


def score(docs: DataFrame, text: str, model: Ranking | None, cut: float = 0.3) -> DataFrame:
    """``docs`` with one more column ``score`` (a leading underscore more per clash); scores from ``cut`` on are accepted."""
    name = free_name(docs.columns, "score")
    if model is None:
        return docs.withColumn(name, F.lit(0.5))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(features(texts), cut))], [*batch.schema.names, name])

    return docs.mapInArrow(rate, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
