"""Personal data: fixed patterns, made consistent over each document by a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these spans always stay. The field runs over the
tokens with a digit or an at sign. A token has surface features; neighbours in the text share a chain potential, and
tokens that repeat (the same token, or the same six or more digits) share a skip potential however far apart they are.
Tokens within pattern spans are observed, the others are inferred by loopy sum-product messages, so a number that is a
phone number in one place gets the same label where no pattern sees it. A span is added for an inferred token if its
label has probability ``SURE`` and a repeat of it, directly or over other repeats, lies in a pattern span of that kind.

The weights are trained by pseudo-likelihood on the pattern labels: every token given the labels of its neighbours, over
a sample of documents whose bound is a parameter; tokens meet as counts of equal cases. Without cases all weights are 0,
and nothing is added. Null texts count as empty; every row gives a row. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
SURE = 0.5
ROUNDS = 10
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_EDGE = "\"'.,;:!?[]{}<>*#$%&|="
#: Bits of the surface features of a token.
FEATURES = 16


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern spans, in that order; leftmost and not overlapping within a kind."""
    spans, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            done = found.end()
            spans.append((begin, 0, done))
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def surface(token: str) -> int:
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    at = token.find("@")
    bits = (
        True, at >= 0, at > 0 and "." in token[at:], digits == len(token), digits >= 6, digits >= 9, 12 <= digits <= 19, token.count(".") == 3,
        "-" in token, token[:1] == "+", "(" in token or ")" in token, letters > 0, letters > 0 and digits >= 6, len(token) > 20, digits in (3, 4), "/" in token or "_" in token,
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


class Graph:
    """Tokens of a text: spans, features, observed labels (0: none), chain and skip links."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]]):
        self.place, self.mask, chain, skip = [], [], [], []
        label, last, k, last_end = [], {}, 0, -9
        reach = np.maximum.accumulate([e for _, _, e in spans]) if spans else []
        for m in _TOKEN.finditer(text):
            begin, end = m.span()
            while begin < end and text[begin] in _EDGE:
                begin += 1
            while begin < end and text[end - 1] in _EDGE:
                end -= 1
            if begin == end:
                continue
            n, token = len(self.place), text[begin:end]
            while k < len(spans) and reach[k] <= begin:
                k += 1
            over = [kind + 1 for s, kind, e in spans[k : k + 8] if s < end and e > begin]
            self.place.append((begin, end))
            self.mask.append(surface(token))
            label.append(min(over) if over else 0)
            if n and begin - last_end <= 2:
                chain.append((n - 1, n))
            last_end = end
            digits = "".join(c for c in token if "0" <= c <= "9")
            keys = ([token.lower()] if "@" in token else []) + ([digits] if len(digits) >= 6 else [])
            for key in keys:
                if key in last and (last[key], n) not in skip[-2:]:
                    skip.append((last[key], n))
                last[key] = n
        self.label = np.array(label, np.int64)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(skip, np.int64).reshape(-1, 2)

    def cases(self) -> np.ndarray:
        """Per token one number: features, own label, and how often each label occurs among its neighbours (3 at most)."""
        n = len(self.place)
        code = np.array(self.mask, np.int64) | self.label << FEATURES
        shift = FEATURES + 3
        for links in (self.chain, self.skip):
            near = np.zeros((n, len(KINDS) + 1), np.int64)
            np.add.at(near, (links[:, 0], self.label[links[:, 1]]), 1)
            np.add.at(near, (links[:, 1], self.label[links[:, 0]]), 1)
            for y in range(len(KINDS) + 1):
                code |= np.minimum(near[:, y], 3) << shift
                shift += 2
        return code


class Field:
    """Weights: ``own`` (label x feature), ``chain`` and ``skip`` (label x label, symmetric)."""

    def __init__(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.own, self.chain, self.skip = own, chain, skip

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of every token, by loopy messages with tokens in pattern spans observed."""
        bits = (np.array(graph.mask)[:, None] >> np.arange(FEATURES)) & 1
        base = bits @ self.own.T
        seen = graph.label > 0
        base[seen] = -50.0
        base[seen, graph.label[seen]] = 0.0
        links = np.concatenate([graph.chain, graph.skip])
        pair = np.concatenate([np.repeat(self.chain[None], len(graph.chain), 0), np.repeat(self.skip[None], len(graph.skip), 0)])
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        pair, reverse = np.concatenate([pair, pair]), np.roll(np.arange(2 * len(links)), len(links))
        message = np.zeros((len(source), base.shape[1]))
        for _ in range(ROUNDS):
            belief = base.copy()
            np.add.at(belief, target, message)
            new = (belief[source] - message[reverse])[:, :, None] + pair
            top = new.max(axis=1)
            new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            change = np.abs(new - message).max(initial=0)
            message = 0.5 * message + 0.5 * new
            if change < 1e-4:
                break
        belief = base
        np.add.at(belief, target, message)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def added(self, graph: Graph) -> list[tuple[int, int, int]]:
        """Spans of inferred tokens; only texts with a repeat of an observed token need the messages."""
        if not len(graph.skip) or not (graph.label > 0).any() or (graph.label > 0).all():
            return []
        reached = graph.label.copy()
        for _ in range(len(graph.place)):
            before = reached.copy()
            for a, b in (graph.skip.T, graph.skip.T[::-1]):
                open_ = reached[b] == 0
                reached[b[open_]] = reached[a[open_]]
            if (before == reached).all():
                break
        asked = np.flatnonzero((graph.label == 0) & (reached > 0))
        if not len(asked):
            return []
        p = self.marginals(graph)
        return [(graph.place[i][0], int(reached[i]) - 1, graph.place[i][1]) for i in asked if p[i].argmax() == reached[i] and p[i].max() >= SURE]


def train(cases: list[tuple[int, int]], penalty: float = 0.01, steps: int = 1500, rate: float = 0.1) -> Field:
    """Pseudo-likelihood: labels given features and neighbours' labels, weighted by the number of equal cases (Adam).

    Every case counts twice, the second time without its chain neighbours, so that repeats learn to speak for themselves.
    """
    labels = len(KINDS) + 1
    if not cases:
        return Field(np.zeros((labels, FEATURES)), np.zeros((labels, labels)), np.zeros((labels, labels)))
    code, times = np.array(sorted(cases), np.int64).T
    x = ((code[:, None] >> np.arange(FEATURES)) & 1).astype(float)
    y = np.eye(labels)[(code >> FEATURES) & 7]
    near = [((code[:, None] >> (FEATURES + 3 + 2 * (labels * k + np.arange(labels)))) & 3).astype(float) for k in range(2)]
    x, y, times = np.concatenate([x, x]), np.concatenate([y, y]), np.concatenate([times, times])
    near = [np.concatenate([near[0], 0 * near[0]]), np.concatenate([near[1], near[1]])]
    weights = [np.zeros((labels, FEATURES)), np.zeros((labels, labels)), np.zeros((labels, labels))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        z = x @ weights[0].T + near[0] @ weights[1].T + near[1] @ weights[2].T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - y) * times[:, None]
        slopes = [error.T @ x, error.T @ near[0], error.T @ near[1]]
        slopes[1:] = [(s + s.T) / 2 for s in slopes[1:]]
        for w, s, m, v in zip(weights, slopes, first, second, strict=True):
            s = (s + penalty * w) / times.sum()
            m += 0.1 * (s - m)
            v += 0.001 * (s * s - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(*weights)


def fit(docs: DataFrame, key: str, text: str, documents: int = 20_000) -> Field:
    """Train on about ``documents`` documents, chosen by a hash of the key; only counts of cases reach the driver."""
    total = docs.count()
    share = min(1.0, documents / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("pii")), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(f"`{text}`").alias("text"))

    def cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text"):
            codes = [Graph(t, pattern_spans(t)).cases() for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes))], ["case"])

    rows = sample.mapInArrow(cases, "case long").groupBy("case").count().collect()
    return train([(r["case"], r["count"]) for r in rows])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def find(docs: DataFrame, key: str, text: str, field: Field) -> DataFrame:
    """``key, base, spans``: pattern spans, and all spans with the added ones, as ``kind:start:end`` joined by commas."""
    chosen = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([chosen.schema[0], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            base, all_spans = [], []
            for t in texts.to_pylist():
                spans = pattern_spans(t)
                base.append(written(spans))
                more = field.added(Graph(t, spans)) if spans else []
                all_spans.append(written(sorted(spans + more)) if more else base[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.string()), pa.array(all_spans, pa.string())], [key, "base", "spans"])

    return chosen.mapInArrow(look, schema)
