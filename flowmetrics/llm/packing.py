"""Pack token pieces into sequences: first-fit decreasing in randomised groups.

Documents are cut into full pieces and one rest; the pieces of a group are placed, longest first, into the first
sequence with room, found in a tournament tree of free capacities. Groups are formed by a hash of the piece, so a long
document spreads over many groups, and groups are packed independently. Where many rows share key and start (a null or
repeated key), the hash takes a settled row number instead, so each group has a bounded number of pieces.

Null and empty texts give one piece that holds the end id only; repeated rows are packed as often as they occur; an empty
table gives an empty result; ``carry`` columns pass through, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import free_name, slices, small
from flowmetrics.llm.encoding import encoder
from flowmetrics.session import settle

SMALL_ROWS = 500_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item. ``sizes`` must not increase; an item that fills a bin takes one without a search."""
    full = int(np.searchsorted(-sizes, -capacity, side="right"))
    bins, offsets = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
    rest = sizes[full:].tolist()
    if not rest:
        return bins, offsets
    leaves = 1 << (len(rest) - 1).bit_length()
    free = [capacity] * (2 * leaves)
    for i, size in enumerate(rest, full):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = full + node - leaves, capacity - free[node]
        free[node] -= size
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
    return bins, offsets


def token_pieces(docs: DataFrame, key: str, text: str, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: ``key, start, length, doc_tokens, ids`` (ids as little-endian unsigned 32-bit integers)."""
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch, texts in slices(batches, "text"):
            ids, count = encode(texts)
            ids = np.insert(ids, np.cumsum(count), end_id).astype("<u4")
            tokens = count + 1
            pieces = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
            length = np.minimum(capacity, tokens[doc] - start)
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]), data],
                [key, "start", "length", "doc_tokens", "ids"],
            )

    schema = T.StructType([
        T.StructField(key, chosen.schema["key"].dataType), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return chosen.mapInArrow(cut, schema)


def pack(pieces: DataFrame, key: str, capacity: int = 1024, group_pieces: int = 2048, seed: int = 0) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with ``start`` and ``length`` (a leading underscore per name clash).

    Settles the pieces first. About ``group_pieces`` pieces form a group.
    """
    own = pieces.columns
    row, start, kept, many, group = (free_name(own, n) for n in ("row", "same_start", "same_key", "many", "group"))
    schema = T.StructType([*pieces.schema.fields, *[T.StructField(free_name(own, n), T.LongType()) for n in ("sequence_id", "offset")]])
    pieces = settle(pieces.withColumn(row, F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    same = pieces.groupBy(F.col(f"`{key}`").alias(kept), F.col("start").alias(start)).count().where(F.col("count") > max(1, group_pieces // 8))
    same = small(settle(same.select(kept, start, F.lit(True).alias(many))), SMALL_ROWS)
    pieces = pieces.join(same, F.col(f"`{key}`").eqNullSafe(F.col(kept)) & (F.col("start") == F.col(start)), "left")
    number = F.when(F.col(many), F.xxhash64(row, F.lit(seed))).otherwise(F.xxhash64(F.col(f"`{key}`"), F.col("start"), F.lit(seed)))
    pieces = pieces.select(*[F.col(f"`{c}`") for c in own], F.pmod(number, F.lit(groups)).alias(group))

    def place(of: tuple, table: pa.Table) -> pa.Table:
        table = table.select(own)
        table = table.take(pc.sort_indices(table.select(["length", key, "start"]), [("length", "descending"), (key, "ascending"), ("start", "ascending")]))
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        return pa.table([*table.columns, pa.array((of[0].as_py() << 32) + bins), pa.array(offsets)], schema.names)

    return pieces.groupBy(group).applyInArrow(place, schema)
