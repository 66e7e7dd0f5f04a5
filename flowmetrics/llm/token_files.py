"""Token files: one zstandard frame per document, a document index and a trailing seek table.

A shard is a sequence of independent frames, a skippable frame with the document index (an Arrow stream: key, frames,
tokens), and a skippable frame in zstandard's public seekable format: per frame its compressed size, its size, and the
low half of the XXH64 of its content. Any zstandard reader can read a shard from the start; this module's reader fetches
the end of the file and then only the frames of the documents asked for, each checked against its checksum.

Documents lie in ascending key order over all shards (equal keys by text). Null texts count as empty: such a document
has the end id only. A document above ``FRAME_TOKENS`` has several frames. Shards are written under a name of the task
attempt and then renamed, so a task that runs again replaces its own file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from flowmetrics.llm.common import parts_for, slices
from flowmetrics.llm.encoding import encoder

FRAME_TOKENS = 1 << 24
INDEX_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri)


class ShardWriter:
    def __init__(self, sink, level: int, key_type: pa.DataType):
        self.sink, self.compress = sink, zstandard.ZstdCompressor(level=level).compress
        self.seek, self.index, self.key_type = [], [], key_type

    def add(self, keys: pa.Array, ids: np.ndarray, count: np.ndarray) -> None:
        data, width, ends, frames = memoryview(ids.tobytes()), ids.itemsize, np.cumsum(count).tolist(), []
        begin = 0
        for end in ends:
            at = begin
            while True:
                until = min(end, at + FRAME_TOKENS)
                raw = data[at * width : until * width]
                frame = self.compress(raw)
                self.sink.write(frame)
                self.seek.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                at = until
                if at == end:
                    break
            frames.append(max(1, -(-(end - begin) // FRAME_TOKENS)))
            begin = end
        self.index.append(pa.RecordBatch.from_arrays([keys, pa.array(frames, pa.int32()), pa.array(count)], ["key", "frames", "tokens"]))

    def close(self, width: int) -> tuple[int, int]:
        buffer = pa.BufferOutputStream()
        schema = pa.schema([("key", self.key_type), ("frames", pa.int32()), ("tokens", pa.int64())], metadata={"width": str(width)})
        with pa.ipc.new_stream(buffer, schema) as out:
            for batch in self.index:
                out.write_batch(batch.cast(schema) if hasattr(batch, "cast") else batch)
        index = buffer.getvalue().to_pybytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        self.seek.append(struct.pack("<III", len(index) + 8, 0, 0))
        table = b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEK_END)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        return sum(len(b) for b in self.index), sum(int(np.sum(b.column(2).to_numpy())) for b in self.index)


def read_shard(uri: str, wanted: set | None = None, batch_tokens: int = 1 << 20) -> Iterator[tuple[list, list[int], list[int], list[bytes]]]:
    """Batches of (keys, tokens before the document in this shard, token counts, ids as unsigned 32-bit bytes)."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        size = f.size()
        number, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEK_END or not flags & 0x80:
            raise ValueError(f"no seek table in {uri}")
        table = np.frombuffer(f.read_at(12 * number, size - 9 - 12 * number), "<u4").reshape(-1, 3)
        at = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        index = pa.ipc.open_stream(f.read_at(int(table[-1, 0]) - 8, int(at[-2]) + 8))
        kind = "<u2" if index.schema.metadata[b"width"] == b"2" else "<u4"
        docs = index.read_all()
        frames, tokens = docs["frames"].to_numpy(), docs["tokens"].to_numpy()
        first, before = np.cumsum(frames) - frames, np.cumsum(tokens) - tokens
        decompress = zstandard.ZstdDecompressor().decompress
        keys, begins, counts, ids, held = [], [], [], [], 0
        for i, key in enumerate(docs["key"].to_pylist()):
            if wanted is not None and key not in wanted:
                continue
            parts = []
            for k in range(int(first[i]), int(first[i] + frames[i])):
                raw = decompress(f.read_at(int(table[k, 0]), int(at[k])), max_output_size=max(1, int(table[k, 1])))
                if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != table[k, 2]:
                    raise ValueError(f"frame {k} of {uri} is damaged")
                parts.append(raw)
            keys.append(key)
            begins.append(int(before[i]))
            counts.append(int(tokens[i]))
            ids.append(np.frombuffer(b"".join(parts), kind).astype("<u4").tobytes())
            held += counts[-1]
            if held >= batch_tokens:
                yield keys, begins, counts, ids
                keys, begins, counts, ids, held = [], [], [], [], 0
        if keys:
            yield keys, begins, counts, ids


def write_token_files(docs: DataFrame, key: str, text: str, path: str, folder: str, end_id: int, shard_docs: int = 8192, level: int = 3) -> None:
    """Encode all texts and write shards and their manifest (Parquet) to ``folder``, which all executors must share."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    parts = parts_for(spark, chosen.count(), shard_docs)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        table = encoder(path)
        width = 2 if max(table.library.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/shard-{task.partitionId():08d}.tokens"
        writer = sink = None
        for batch, texts in slices(batches, "text"):
            if writer is None:
                sink = fs.open_output_stream(f"{name}.{task.taskAttemptId()}")
                writer = ShardWriter(sink, level, batch.schema.field("key").type)
            ids, count = table.encode(texts)
            writer.add(batch.column(0), np.insert(ids, np.cumsum(count), end_id).astype(f"<u{width}"), count + 1)
        if writer is not None:
            number, tokens = writer.close(width)
            sink.close()
            if fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(name)
            fs.move(f"{name}.{task.taskAttemptId()}", name)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([task.partitionId()], pa.int64()), "file": [name.rpartition("/")[2]],
                "docs": pa.array([number], pa.int64()), "tokens": pa.array([tokens], pa.int64()),
            })

    shards = chosen.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    shards.mapInArrow(write, "shard long, file string, docs long, tokens long").write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, key: str, key_type: T.DataType, wanted: set | None = None) -> DataFrame:
    """``key, start`` (ids of all documents before it), ``n_tokens, ids`` of all documents, or of the ``wanted`` keys."""
    manifest = spark.read.schema("shard long, file string, docs long, tokens long").parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", "file", before.alias("begin"))
    shards = shards.repartition(max(1, manifest.count()), "shard")
    arrow_type = to_arrow_type(key_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for keys, begins, counts, ids in read_shard(f"{folder}/{row['file']}", wanted):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, arrow_type), pa.array([row["begin"] + b for b in begins], pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                        [key, "start", "n_tokens", "ids"],
                    )

    schema = T.StructType([T.StructField(key, key_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return shards.mapInArrow(read, schema)
