"""Token counts without ids: every distinct pre-token is counted once, then joined to pre-token frequencies.

1. Documents are gathered into blocks of bounded size. A block keeps its distinct pre-tokens, dealt into buckets by
   hash, and per document the frequency of each of them.
2. Per bucket the pre-tokens of all blocks are united and the library counts the pieces of each distinct one once.
3. The counts go back to their blocks, are multiplied with the frequencies and summed.

Pre-tokens are runs of blanks with the word behind them, and line breaks: no piece of a SentencePiece model that splits
by white space holds a blank behind another character, and a line break is a piece of its own. Null and empty texts
have no tokens; repeated rows are counted each; columns other than key and text are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowmetrics.llm.common import slices
from flowmetrics.session import settle

BLOCK_CHARS = 32_000_000
DOCS_PER_ROW = 500
_PRE_TOKEN = re.compile(" *[^ \n]+| +|\n")


def chunk_of(key: str) -> str:
    """The pre-token behind a key: U+0000 marks one that is spelt out, else a blank is implied unless it is a line break."""
    if key[:1] == "\0":
        return key[1:]
    return key if key[:1] == "\n" else " " + key


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        pieces = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if len(self.library.encode("\n")) != 2 or any(mark in p.lstrip(mark) or "\n" in p for p in pieces):
            raise ValueError(f"{path} joins words across white space: its pre-tokens can't be counted apart")

    def count(self, keys: list[str]) -> np.ndarray:
        """Pieces of each pre-token; a line break before it takes the model's own leading blank."""
        found = self.library.encode(["\n" + chunk_of(k) for k in keys], num_threads=1)
        return np.fromiter(map(len, found), np.int64, len(keys)) - 2


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _bytes(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays, compressed with equal-weight bytes side by side."""
    planes = (np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<Q", len(a)) + p for a, p in zip(arrays, planes, strict=True)))


def _arrays(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        n = struct.unpack_from("<Q", raw, at)[0]
        planes = np.frombuffer(raw, np.uint8, 4 * n, at + 8).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 8 + 4 * n
    return out


class _Block:
    def __init__(self, number: int, buckets: int, key_type: pa.DataType):
        self.number, self.buckets, self.key_type = number, buckets, key_type
        self.rows: dict[str, int] = {}
        self.chars, self.docs = 0, []

    def _row(self, key: str) -> int:
        return self.rows.setdefault(key, len(self.rows))

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        odd = pc.or_(pc.match_substring_regex(texts, "  |^ |▁|\\x00"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        distinct = lists.flatten().dictionary_encode()
        row = np.fromiter(map(self._row, distinct.dictionary.to_pylist()), np.int64, len(distinct.dictionary))
        doc = [np.repeat(np.flatnonzero(~odd), np.diff(lists.offsets.to_numpy()))]
        rows = [row[distinct.indices.to_numpy()]]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py().replace("▁", " ")
            found = [self._row("\0" + chunk) for chunk in _PRE_TOKEN.findall(" " + text)] if text else []
            doc.append(np.full(len(found), i))
            rows.append(np.array(found, np.int64))
        pairs, times = np.unique(np.concatenate(doc) << 32 | np.concatenate(rows), return_counts=True)
        terms = np.bincount(pairs >> 32, minlength=len(texts))
        self.docs.append((keys, pc.binary_length(texts).cast(pa.int64()), terms, pairs & 0xFFFFFFFF, times))
        self.chars += int(pc.sum(pc.utf8_length(texts)).as_py() or 0)

    def batches(self) -> Iterator[pa.RecordBatch]:
        names = ["block", "bucket", "keys", "sizes", "words", "numbers"]
        kinds = [pa.int64(), pa.int32(), pa.list_(self.key_type), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for keys, sizes, terms, rows, times in self.docs:
            ends = np.concatenate([[0], np.cumsum(terms)])
            for i in range(0, len(keys), DOCS_PER_ROW):
                j = min(len(keys), i + DOCS_PER_ROW)
                part = slice(ends[i], ends[j])
                data = [[self.number], [-1], [keys.slice(i, j - i).to_pylist()], [sizes.slice(i, j - i).to_pylist()], [None], [_bytes(terms[i:j], np.diff(rows[part], prepend=0), times[part])]]
                yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], names)
        dealt: dict[int, list[tuple[bytes, int]]] = {}
        for key, row in self.rows.items():
            word = key.encode()
            dealt.setdefault(zlib.crc32(word) % self.buckets, []).append((word, row))
        for bucket, words in dealt.items():
            text = zstandard.ZstdCompressor(level=1).compress(b"".join(w for w, _ in words))
            numbers = _bytes(np.array([len(w) for w, _ in words]), np.array([r for _, r in words]))
            data = [[self.number], [bucket], [None], [None], [text], [numbers]]
            yield pa.RecordBatch.from_arrays([pa.array(d, k) for d, k in zip(data, kinds, strict=True)], names)


def count_tokens(docs: DataFrame, key: str, text: str, path: str, buckets: int | None = None) -> DataFrame:
    """``key, n_bytes`` (UTF-8), ``n_tokens`` of every row. ``buckets`` (default: the session's shuffle partitions, 64 at
    least) must grow with the vocabulary of the corpus: a bucket's distinct pre-tokens are held by one task."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key_type = chosen.schema["key"].dataType
    buckets = buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, None
        for batch, texts in slices(batches, "text"):
            block = block or _Block(number, buckets, batch.schema.field("key").type)
            block.add(batch.column(0), texts)
            if block.chars >= BLOCK_CHARS:
                yield from block.batches()
                number, block = number + 1, None
        if block:
            yield from block.batches()

    def count(group: pa.Table) -> pa.Table:
        rows: dict[str, int] = {}
        parts = []
        for text, numbers in zip(group["words"].to_pylist(), group["numbers"].to_pylist(), strict=True):
            raw, (size, row) = zstandard.ZstdDecompressor().decompress(text), _arrays(numbers)
            ends = np.cumsum(size, dtype=np.int64).tolist()
            words = [raw[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            parts.append((row, np.fromiter((rows.setdefault(w, len(rows)) for w in words), np.int64, len(words))))
        words, pieces = list(rows), [np.empty(0, np.int64)]
        for i in range(0, len(words), 10_000):
            pieces.append(counter(path).count(words[i : i + 10_000]))
        found = np.concatenate(pieces)
        return pa.table({"block": group["block"], "counts": pa.array([_bytes(row, found[at]) for row, at in parts], pa.binary())})

    def total(documents: pa.Table, counts: pa.Table) -> pa.Table:
        pairs = [_arrays(c) for c in counts["counts"].to_pylist()]
        pieces = np.zeros(max((int(row.max()) + 1 for row, _ in pairs if len(row)), default=0), np.int64)
        for row, n in pairs:
            pieces[row] = n
        keys, sizes, tokens = [], [], []
        for k, s, numbers in zip(documents["keys"].to_pylist(), documents["sizes"].to_pylist(), documents["numbers"].to_pylist(), strict=True):
            terms, step, times = _arrays(numbers)
            row = np.cumsum(step, dtype=np.uint32)
            ends = np.concatenate([[0], np.cumsum(pieces[row] * times)])
            keys += k
            sizes += s
            tokens += np.diff(ends[np.concatenate([[0], np.cumsum(terms, dtype=np.int64)])]).tolist()
        kind = documents.schema.field("keys").type.value_type
        return pa.table({key: pa.array(keys, kind), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())})

    fields = [T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("keys", T.ArrayType(key_type)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("numbers", T.BinaryType())]
    blocks = settle(chosen.mapInArrow(gather, T.StructType(fields)))
    counts = blocks.where("bucket >= 0").select("bucket", "block", "words", "numbers").groupBy("bucket").applyInArrow(count, "block long, counts binary")
    frequencies = blocks.where("bucket < 0").select("block", "keys", "sizes", "numbers")
    schema = T.StructType([T.StructField(key, key_type), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return frequencies.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(total, schema)
