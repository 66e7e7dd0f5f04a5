"""Near-duplicate documents: Jaccard similarity of word n-grams, candidates pruned by Bayes, survivors counted exactly.

1. Every text gives its distinct shingles (``WORDS`` words without case; a shorter text is one shingle), a digest of
   them, ``HASHES`` MinHash values and ``BANDS`` band keys. Texts with equal shingles count as one from there on.
2. Texts that share a band key are candidates; a pair at the threshold shares none with a probability of 5e-8. Buckets
   are dealt into tiles of bounded size. Per pair the MinHash values are compared ``STEP`` at a time, and the pair is
   dropped when the posterior probability of reaching the threshold (uniform prior) falls below ``TOLERANCE``. A tile
   returns one link per text, which joins the texts of its survivors, never its pairs.
3. The components of these links are dealt into tiles again, now with the shingles; all pairs of a component pass the
   same pruning and then an exact count of common shingles. Tiles return per text its number of links and one joining
   link, from which the classes are formed.

Result: one row per document with its class (the smallest key of a connected group) and its number of links, copies
included. Null texts count as empty; empty texts are copies of each other. A null key can't name a class: the smallest
other key does, or null. Rows that repeat a key and text count as copies. Only key and text are read. Rows are told
apart by a number of their own, settled with them; keys may be null or repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import free_name, slices, small
from flowmetrics.llm.components import components
from flowmetrics.session import settle

WORDS, THRESHOLD = 5, 0.8
HASHES, BANDS, STEP, TOLERANCE = 128, 32, 16, 1e-7
TILE = 512
TILE_SHINGLES = 500_000
SMALL_ROWS = 200_000
_ODD = np.random.default_rng(20240229).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.random.default_rng(20240301).integers(0, 1 << 63, HASHES, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts as 64-bit hashes, ascending within each text, and where each text ends."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat = lists.flatten().dictionary_encode()
    known = flat.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    hashes[[i for i, w in enumerate(known) if not w]] = 0
    word = hashes[flat.indices.to_numpy()]
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    doc, word = doc[word != 0], word[word != 0]
    size = np.bincount(doc, minlength=len(texts))
    begin = np.cumsum(size) - size
    count = np.where(size == 0, 0, np.maximum(1, size - words + 1))
    owner = np.repeat(np.arange(len(texts)), count)
    at = begin[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    value = np.zeros(len(owner), np.uint64)
    for j in range(words):
        inside = at + j < begin[owner] + size[owner]
        value = mixed(value + np.where(inside, word[np.minimum(at + j, max(0, len(word) - 1))] if len(word) else 0, np.uint64(0)).astype(np.uint64) + np.uint64(1))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.cumsum(np.bincount(owner, minlength=len(texts)))


def signatures(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """texts x HASHES MinHash values (unsigned 32 bits); all ones for an empty text."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    some = np.flatnonzero(ends > begins)
    out = np.full((len(ends), HASHES), 0xFFFFFFFF, np.uint32)
    if len(some):
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat(((value ^ _MASK[k]) * _ODD[k]) >> np.uint64(32), begins[some]).astype(np.uint32)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Compared values -> fewest equal ones with which a pair may still reach the threshold.

    With a uniform prior, ``m`` equal of ``n`` give P(similarity >= t) = P(binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


LEAST = least_matches()


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows ``a, b`` of the 8-bit MinHash values are not pruned."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(alive):
            break
        part = slice(n - STEP, n)
        equal = equal + (sig[a[alive], part] == sig[b[alive], part]).sum(axis=1)
        keep = equal >= LEAST[n]
        alive, equal = alive[keep], equal[keep]
    return alive


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is joined to by the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from rows that are sorted by ``keys``, a batch or so at a time."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        if held:
            table = pa.concat_tables([*held, table])
        code = np.stack([table[k].to_numpy() for k in keys])
        cut = int(np.flatnonzero((code != code[:, -1:]).any(axis=0))[-1]) + 1 if (code != code[:, -1:]).any() else 0
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield held[0]


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    code = np.stack([table[k].to_numpy() for k in keys])
    return np.concatenate([[0], np.flatnonzero((code[:, 1:] != code[:, :-1]).any(axis=0)) + 1, [code.shape[1]]])


def _pairs(bounds: np.ndarray, side: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows within groups: of side 0 with side 1, or all pairs where the side is 2."""
    a, b, held = [], [], 0
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = side[begin:end]
        if own[0] < 2:
            x, y = np.meshgrid(begin + np.flatnonzero(own == 0), begin + np.flatnonzero(own == 1), indexing="ij")
            x, y = x.ravel(), y.ravel()
        else:
            x, y = np.triu_indices(end - begin, 1)
            x, y = x + begin, y + begin
        a.append(x)
        b.append(y)
        held += len(x)
        if held >= limit:
            yield np.concatenate(a), np.concatenate(b)
            a, b, held = [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b)


def _tiled(rows: DataFrame, group: str, chunks: str) -> DataFrame:
    """Deal each group into tiles: every two of its chunks (chosen by a hash of the node) meet in one, so does each
    chunk with itself. ``side``: 0 and 1 for the two chunks of a tile, 2 in a tile of one chunk."""
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col(chunks))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks).cast("long") - 1)))
    tile = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.withColumn("tile", tile).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") > F.col("other"), 1).otherwise(0)).drop("own", "other", chunks)
    return rows.repartition("tile").sortWithinPartitions("tile", group)


def _candidate_links(texts: DataFrame) -> DataFrame:
    """``a, b``: nodes joined by pairs that share a bucket and survive the pruning."""

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["band", "node"])

    bands = texts.select("node", "bands").mapInArrow(banded, "band long, node long")
    shared = bands.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1")
    members = bands.join(shared, "band").select("band", "node", F.ceil(F.col("rows") / TILE).alias("chunks"))
    members = members.join(texts.select("node", "sig"), "node")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["tile", "band"]):
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
            node, row = np.unique(table["node"].to_numpy(), return_inverse=True)
            found = []
            for a, b in _pairs(_bounds(table, ["tile", "band"]), table["side"].to_numpy()):
                kept = survivors(sig, a, b)
                found.append(np.unique(np.stack([row[a[kept]], row[b[kept]]], axis=1), axis=0))
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            label = joined(len(node), pairs[:, 0], pairs[:, 1])
            moved = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["a", "b"])

    return _tiled(members, "band", "chunks").mapInArrow(prune, "a long, b long")


def _exact(value: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of shingle sets reach the threshold; many pairs of few sets by products of presence matrices."""
    size = np.array([len(v) for v in value])
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(used):
        common = np.array([len(np.intersect1d(value[i], value[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    else:
        place = np.full(len(value), -1)
        place[used] = np.arange(len(used))
        owner = np.repeat(np.arange(len(used)), size[used])
        term, times = np.unique(np.concatenate([value[i] for i in used]), return_inverse=True, return_counts=True)[1:]
        column = np.cumsum(times > 1) - 1
        repeated = times[term] > 1
        owner, term = owner[repeated], column[term[repeated]]
        order = np.argsort(term, kind="stable")
        owner, term = owner[order], term[order]
        matrix = np.zeros((len(used), len(used)), np.float32)
        width = 4096
        for begin in range(0, int(term[-1]) + 1 if len(term) else 0, width):
            i, j = np.searchsorted(term, [begin, begin + width])
            held = np.zeros((len(used), width), np.float32)
            held[owner[i:j], term[i:j] - begin] = 1
            matrix += held @ held.T
        common = np.rint(matrix[place[a], place[b]]).astype(np.int64)
    return common >= threshold * (size[a] + size[b] - common) - 1e-9


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number of each row as ``row``, settled, so that every later read sees the same numbers."""
    return settle(docs.withColumn(row, F.monotonically_increasing_id()))


def _classes(rows: DataFrame, key: str, text: str, row: str, threshold: float, words: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """From settled rows with a number each: all rows ``key, digest, row, node``, the nodes ``node, rep, copies``, the
    links ``node, links`` and the classes ``node, component`` of linked nodes."""
    if threshold < THRESHOLD:
        raise ValueError(f"the bands find pairs from {THRESHOLD} on")
    chosen = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("digest"), F.col(f"`{row}`").alias("row"))
    kind = chosen.schema["key"].dataType

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            value, ends = shingles(texts, words)
            sig = signatures(value, ends)
            rows = sig.reshape(len(ends), BANDS, -1)
            bands = mixed(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] + np.zeros((len(ends), 1), np.uint64))
            for r in range(rows.shape[2]):
                bands = mixed(bands + rows[:, :, r])
            begins = np.concatenate([[0], ends[:-1]]).tolist()
            node = [xxhash.xxh3_64_intdigest(value[i:j].tobytes()) - (1 << 63) for i, j in zip(begins, ends.tolist(), strict=True)]
            low = (sig & 0xFF).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(node, pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([x.tobytes() for x in bands], pa.binary()), pa.array([x.tobytes() for x in low], pa.binary())],
                ["key", "digest", "row", "node", "size", "bands", "sig"],
            )

    schema = T.StructType([T.StructField("key", kind), T.StructField("digest", T.LongType()), T.StructField("row", T.LongType()), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    described = settle(chosen.mapInArrow(describe, schema))
    texts = described.groupBy("node").agg(F.min("key").alias("rep"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    texts = settle(texts)
    linked = components(_candidate_links(texts.where("size > 0")))
    sizes = linked.join(texts.select("node", "copies", "size", "sig", "row"), "node")
    sizes = settle(sizes)
    chunks = sizes.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_SHINGLES)).alias("chunks"))
    wanted = settle(sizes.join(chunks, "component").select("row", "node", "component", "copies", "sig", "chunks"))
    spelt = chosen.select("row", "text").join(small(wanted, SMALL_ROWS), "row")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in slices(batches, "text"):
            value, ends = shingles(found, words)
            begins = np.concatenate([[0], ends[:-1]]).tolist()
            parts = [value[i:j].tobytes() for i, j in zip(begins, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(parts, pa.binary())], ["node", "component", "copies", "sig", "chunks", "value"])

    spelt = spelt.select("text", "node", "component", "copies", "sig", "chunks").mapInArrow(spell, "node long, component long, copies long, sig binary, chunks long, value binary")
    spelt = settle(spelt)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["tile", "component"]):
            sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, HASHES)
            node, copies, side = (table[c].to_numpy() for c in ("node", "copies", "side"))
            value = [np.frombuffer(v, np.uint64) for v in table["value"].to_pylist()]
            links, label = np.zeros(len(node), np.int64), np.arange(len(node))
            bounds = _bounds(table, ["tile", "component"])
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for a, b in _pairs(np.array([0, end - begin]), side[begin:end]):
                    kept = survivors(sig[begin:end], a, b)
                    a, b = a[kept], b[kept]
                    near = _exact(value[begin:end], a, b, threshold) if len(a) else np.empty(0, bool)
                    a, b = a[near], b[near]
                    links[begin:end] += np.bincount(a, copies[begin:end][b], end - begin).astype(np.int64) + np.bincount(b, copies[begin:end][a], end - begin).astype(np.int64)
                    label[begin:end] = begin + joined(end - begin, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links), pa.array(node[label])], ["node", "links", "label"])

    counted = settle(_tiled(spelt, "component", "chunks").mapInArrow(count, "node long, links long, label long"))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(counted.select(F.col("node").alias("a"), F.col("label").alias("b")))
    return described.select("key", "digest", "row", "node"), texts.select("node", "rep", "copies"), links, classes


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``key, class_id, n_links`` of every document."""
    row = free_name([key, text], "row")
    rows = numbered(docs.select(f"`{key}`", f"`{text}`"), row)
    described, texts, links, classes = _classes(rows, key, text, row, threshold, words)
    named = classes.join(texts.select("node", "rep"), "node")
    names = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    verdict = texts.join(links, "node", "left").join(classes.join(names, "component").select("node", "class_id"), "node", "left")
    verdict = verdict.select("node", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return described.select(F.col("key").alias(key), "node").join(verdict, "node").drop("node")


def one_per_class(rows: DataFrame, key: str, text: str, row: str, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``row`` of one row per class, chosen among ``numbered`` rows: the smallest key, null keys last, then the smallest
    digest of the text; of rows that repeat both, any one."""
    described, _, _, classes = _classes(rows, key, text, row, threshold, words)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "digest", "row")
    best = described.groupBy("node").agg(F.min(order).alias("best")).join(classes, "node", "left")
    chosen = best.groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("best").alias("best"))
    return chosen.select(F.col("best.row").alias(row))
