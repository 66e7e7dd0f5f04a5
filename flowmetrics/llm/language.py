"""Language by string kernels: n-gram presence, Nyström landmarks, one-versus-rest kernel ridge regression.

Two texts are compared by the n-grams (one to three letters, blended) that both hold, divided by the geometric mean of
their numbers. N-grams are hashed to ``SLOTS`` slots. Every labelled text is mapped to its kernel values with a few landmark
texts; ridge regression per language on those gives one weight per landmark and language, and all texts are scored in
batches by two matrix products. Landmarks span the space of the regression; its sums are over all labelled texts.

A null text, or one without letters, gives ``und`` with score 0; without any labelled text everything is ``und``. Rows
keep their number, repeated rows get equal results, and only key and text are read. A tie goes to the language that
sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import slices
from flowmetrics.llm.sampling import first_per_class

SLOTS = 1 << 16
LONGEST = 3
BATCH = 256
_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for anything else; U+0000 stays, as the end of a text."""
    global _LETTER
    if _LETTER is None:
        points = (chr(i) for i in range(0x110000))
        _LETTER = np.fromiter((ord(c.lower()[0]) if c.isalpha() else 32 for c in points), np.uint32, 0x110000)
        _LETTER[0] = 0
    return _LETTER


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """texts x SLOTS, true where a text holds an n-gram of the slot; and whether it has a letter."""
    joined = "".join([t.replace("\0", " ") + "\0" for t in texts])
    codes = letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    found = np.zeros((len(texts), SLOTS), bool)
    has_letter = np.zeros(len(texts), bool)
    has_letter[row[codes > 32]] = True
    value, inside = np.zeros(len(codes), np.uint32), codes > 0
    for n in range(1, LONGEST + 1):
        end = len(codes) - n + 1
        if end <= 0:
            break
        value = value[:end] * np.uint32(1_000_003) + codes[n - 1 :]
        inside = inside[:end] & (codes[n - 1 :] > 0)
        slot = (value * np.uint32(2_654_435_769) + np.uint32(n * 40_503)) >> np.uint32(16)
        found[row[:end][inside], slot[inside]] = True
    return found, has_letter


@dataclass
class Model:
    languages: list
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of texts and landmarks; and whether a text has a letter."""
        found, has_letter = presence(texts)
        size = np.sqrt(np.maximum(1, found.sum(axis=1)))[:, None]
        return found[:, self.columns].astype(np.float32) @ self.landmarks / size, has_letter

    def score(self, texts: list[str]) -> tuple[list, np.ndarray]:
        values, has_letter = self.kernel(texts)
        values = values @ self.weights
        best = values.argmax(axis=1)
        score = np.where(has_letter, np.clip(values[np.arange(len(texts)), best], 0, 1), 0.0)
        return [self.languages[b] if h else "und" for b, h in zip(best, has_letter, strict=True)], score


def _landmarks(labelled: DataFrame, landmarks: int) -> tuple[np.ndarray, dict]:
    """Slots of the first texts of every language in turn, by hash, ``landmarks`` in all; and the text count of every language."""
    first, counts = first_per_class(labelled, ["key", "text"], "lang", landmarks)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            packed = [np.packbits(presence([t])[0][0]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], ["slots", "lang", "at"])

    order = F.xxhash64("key", "text", F.lit("sample"))
    rows = first.select("text", "lang", order.alias("at")).mapInArrow(held, "slots binary, lang string, at long").collect()
    rows.sort(key=lambda r: (r["at"], r["lang"], bytes(r["slots"])))
    turn: dict = {}
    for r in rows:
        turn.setdefault(r["lang"], []).append(r)
    rows = [r for i in range(landmarks) for c in sorted(turn) for r in turn[c][i : i + 1]][:landmarks]
    return np.stack([np.unpackbits(np.frombuffer(r["slots"], np.uint8)) for r in rows]).astype(np.float32) if rows else np.zeros((0, SLOTS), np.float32), counts


def fit(labelled: DataFrame, key: str, text: str, lang: str, landmarks: int = 96, penalty: float = 1e-3) -> Model | None:
    """Fit on every text with a language; the landmarks' n-gram slots and the sums of the regression reach the driver.

    Each language weighs the same, however many texts it has.
    """
    labelled = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("text is not null and lang is not null")
    found, counts = _landmarks(labelled, landmarks)
    if not counts:
        return None
    languages = sorted(counts)
    columns = np.flatnonzero(found.any(axis=0))
    size = np.sqrt(np.maximum(1, found.sum(axis=1)))
    chosen = (found[:, columns] / size[:, None]).T
    value, vector = np.linalg.eigh((found[:, columns] @ chosen / size[:, None]).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    d = root.shape[1]
    basis = labelled.sparkSession.sparkContext.broadcast(Model(languages, columns, np.ascontiguousarray(chosen, np.float32), root))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: i for i, c in enumerate(languages)}
        total, seen = np.zeros((d + len(languages), d)), False
        for batch, texts in slices(batches, "text"):
            values, at, seen = texts.to_pylist(), [place[c] for c in batch.column(1).to_pylist()], True
            for i in range(0, len(values), BATCH):
                x = basis.value.kernel(values[i : i + BATCH])[0] @ root
                own = np.array(at[i : i + BATCH])
                weighted = x / np.array([counts[languages[c]] for c in own])[:, None]
                total[:d] += x.T @ weighted
                np.add.at(total, d + own, weighted)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "total"])

    table = labelled.select("text", "lang").mapInArrow(sums, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").toArrow()
    total = table.column("total").to_numpy().reshape(-1, d)
    weights = root @ np.linalg.solve(total[:d] + penalty * np.eye(d), total[d:].T)
    return Model(languages, columns, np.ascontiguousarray(chosen, np.float32), weights.astype(np.float32))


def predict(docs: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """``key, lang_pred, score`` of every row."""
    chosen = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([chosen.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if model is None:
        return chosen.select(f"`{key}`", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            values = texts.to_pylist()
            parts = [sent.value.score(values[i : i + BATCH]) for i in range(0, len(values), BATCH)]
            langs, scores = [x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])

    return chosen.mapInArrow(score, schema)
