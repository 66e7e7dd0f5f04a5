"""Benchmark decontamination by the q-gram lemma: where does a document hold a benchmark item, up to a few edits?

Texts are compared as letters and digits without case; every run of other characters is one blank. A region that
differs from an item of ``m`` characters by at most ``k`` edits shares at least ``m - q + 1 - k * q`` q-grams with it,
all within ``k`` diagonals (text position minus item position). Shared q-grams are counted per item in bands of ``2 k``
diagonals that overlap by half; bands that reach the bound are verified by an alignment banded around their diagonals,
which also gives the region and its distance.

``k`` is ``rate * m``, less for short items so that the lemma asks for ``LEAST`` q-grams at least; items shorter than
``q + LEAST`` characters are searched as they are, between word ends. Items without letters and digits, and null items,
match nothing; null and empty texts hold nothing. Items with equal text give a row each, repeated documents too.
Overlapping regions of one item in a document are one row, the one with the fewest edits (the first of equals).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowmetrics.llm.common import free_name, slices

LEAST = 4
BLOCK_CHARS = 20_000_000
FILTER_BITS = 22
_FOLD: np.ndarray | None = None


def fold() -> np.ndarray:
    """Code point -> lower-case letter or digit, a blank for anything else; U+0000 stays."""
    global _FOLD
    if _FOLD is None:
        points = (chr(i) for i in range(0x110000))
        _FOLD = np.fromiter((ord(c.lower()[0]) if c.isalnum() else 32 for c in points), np.uint32, 0x110000)
        _FOLD[0] = 0
    return _FOLD


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Compared characters of all texts in a row, each text closed by U+0000, and their positions in the row of texts."""
    joined = "".join([t.replace("\0", " ") + "\0" for t in texts])
    codes = fold()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` characters from each position on (``q`` a power of two), by doubling."""
    value, base, n = codes.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while n < q:
        value = value[:-n] * np.uint64(base) + value[n:]
        base, n = base * base % (1 << 64), 2 * n
    value ^= value >> np.uint64(32)
    return value * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    keys: list
    items: list[np.ndarray]
    edits: np.ndarray
    need: np.ndarray
    q: int
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    short: list[int]


def build(rows: list[tuple], q: int, rate: float) -> Index:
    """Index of items ``(key, text)``."""
    items = []
    for _, text in rows:
        codes = folded([text or ""])[0][:-1]
        codes = codes[1:] if len(codes) and codes[0] == 32 else codes
        items.append(codes[:-1] if len(codes) and codes[-1] == 32 else codes)
    size = np.array([len(c) for c in items], np.int64)
    edits = np.maximum(0, np.minimum((rate * size).astype(np.int64), (size - q + 1 - LEAST) // q))
    hashes, item, place = [], [], []
    for i, codes in enumerate(items):
        if len(codes) >= q + LEAST:
            hashes.append(grams(codes, q))
            item.append(np.full(len(codes) - q + 1, i))
            place.append(np.arange(len(codes) - q + 1))
    hashes, item, place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hashes, item, place))
    order = np.argsort(hashes, kind="stable")
    gram, first = np.unique(hashes[order].astype(np.uint64), return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[(gram >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    short = [i for i, codes in enumerate(items) if 0 < len(codes) < q + LEAST]
    return Index([k for k, _ in rows], items, edits, size - q + 1 - edits * q, q, gram, np.append(first, len(order)), item[order], place[order], seen, short)


def align(item: np.ndarray, text: np.ndarray, base: int, width: int) -> tuple[int, int]:
    """Fewest edits that turn ``item`` into a part of ``text`` near the diagonals ``base .. base + width - 1``; its end."""
    lane = np.arange(width)
    padded = np.concatenate([np.zeros(max(0, -base), text.dtype), text[max(0, base):], np.zeros(len(item) + width, text.dtype)])
    far = 1 << 30
    cost = np.zeros(width, np.int64)
    for i, c in enumerate(item):
        new = np.minimum(cost + (padded[i : i + width] != c), np.append(cost[1:], far) + 1)
        cost = np.minimum.accumulate(new - lane) + lane
    ends = base + len(item) + lane
    cost[(ends < 0) | (ends > len(text))] = far
    best = int(cost.argmin())
    return int(cost[best]), int(ends[best])


def verify(item: np.ndarray, text: np.ndarray, band: int, edits: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best region on the diagonals ``band .. band + 2 edits``, if within ``edits``."""
    low, high = max(0, band - edits), min(len(text), band + 3 * edits + len(item) + 1)
    spot = text[low:high].tobytes().find(item.tobytes())
    if spot >= 0 and spot % text.itemsize == 0:
        return low + spot // text.itemsize, low + spot // text.itemsize + len(item), 0
    width = 4 * edits + 1
    distance, end = align(item, text, band - edits, width)
    if distance > edits:
        return None
    back, start = align(item[::-1], text[:end][::-1], -edits, 2 * edits + 1)
    return end - start, end, min(distance, back)


def search(texts: list[str], index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) for all texts; positions are code points of the text as it is, end exclusive."""
    codes, at = folded(texts)
    ends = np.flatnonzero(codes == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    candidates: set[tuple[int, int, int]] = set()
    if len(index.gram) and len(codes) >= index.q:
        hashes = grams(codes, index.q)
        maybe = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(index.gram, hashes[maybe]), len(index.gram) - 1)
        hit = index.gram[slot] == hashes[maybe]
        spot, slot = maybe[hit], slot[hit]
        times = index.first[slot + 1] - index.first[slot]
        entry = np.repeat(index.first[slot] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        spot = np.repeat(spot, times)
        doc = np.searchsorted(ends, spot)
        item = index.item[entry]
        step = np.maximum(1, index.edits[item])
        band = (spot - begins[doc] - index.place[entry] + len(codes)) // step
        for shift in (0, -1):
            order = np.lexsort((band + shift, item, doc))
            cells = np.stack([doc[order], item[order], band[order] + shift], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]).any(axis=1)])) if len(cells) else np.empty(0, np.int64)
            count = np.diff(np.append(new, len(cells)))
            enough = count >= index.need[cells[new, 1]] if len(new) else np.empty(0, bool)
            candidates.update(map(tuple, cells[new[enough]].tolist()))
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, i, b in sorted(candidates):
        text = codes[begins[d] : ends[d]]
        region = verify(index.items[i], text, b * max(1, int(index.edits[i])) - len(codes), int(index.edits[i]))
        if region:
            found.setdefault((d, i), []).append(region)
    for i in index.short:
        whole = np.concatenate([[32], index.items[i], [32]]).astype(np.uint32).tobytes()
        for d in range(len(texts)):
            text = np.concatenate([[32], codes[begins[d] : ends[d]], [32]]).astype(np.uint32).tobytes()
            spot = text.find(whole)
            if spot >= 0 and spot % 4 == 0:
                found.setdefault((d, i), []).append((spot // 4, spot // 4 + len(index.items[i]), 0))
    for (d, i), regions in found.items():
        taken: list[tuple[int, int, int]] = []
        for start, end, distance in sorted(regions, key=lambda r: (r[2], r[0])):
            if all(end <= s or start >= e for s, e, _ in taken):
                taken.append((start, end, distance))
        for start, end, distance in sorted(taken):
            where = at[begins[d] : ends[d]]
            yield d, i, int(where[start] - offset[d]), int(where[end - 1] - offset[d]) + 1, distance


def matches(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, q: int = 8, rate: float = 0.1) -> DataFrame:
    """``key, item_key, start, end, edits`` (a leading underscore per name clash): every region that holds an item.

    Items are sent to the executors in blocks of bounded size, chosen by a hash; each block is searched in all documents.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_key}`").alias("key"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    types = chosen.schema["key"].dataType, asked.schema["key"].dataType
    names = [key]
    for name in (item_key, "start", "end", "edits"):
        names.append(free_name(names, name))
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [*types, *[T.LongType()] * 3], strict=True)])

    kind = to_arrow_type(types[1])

    def block(number: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number).collect()
        index = spark.sparkContext.broadcast(build([(r["key"], r["text"]) for r in rows], q, rate))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in slices(batches, "text", 1_000_000):
                rows = list(search(texts.to_pylist(), index.value))
                doc, item, start, end, edits = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array([index.value.keys[i] for i in item], kind), *(pa.array(x, pa.int64()) for x in (start, end, edits))],
                    schema.names,
                )

        return chosen.mapInArrow(look, schema)

    found = block(0)
    for number in range(1, blocks):
        found = found.unionByName(block(number))
    return found
