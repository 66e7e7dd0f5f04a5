"""What the operators share: sessions, tables, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmetrics.session import checkpoint_dir, configure

#: Characters of text that one numpy step handles at a time; a longer text forms a step of its own.
SLICE_CHARS = 2_000_000


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of these operators: UTC, adaptive plans, and Arrow batches of bounded size since texts can be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the folder that driver and executors share."""
    return f"{checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def free_name(columns: list[str], wanted: str) -> str:
    """A column name that does not clash with ``columns`` (compared without case, as Spark does)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def parts_for(spark: SparkSession, rows: int, per_part: int) -> int:
    """How many partitions hold ``rows`` at ``per_part`` each; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut Arrow batches into pieces of about ``limit`` characters: the piece and its texts, null as ''."""
    for batch in batches:
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
        step = np.cumsum(pc.utf8_length(texts).to_numpy()) // limit
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > begin:
                yield batch.slice(begin, end - begin), texts.slice(begin, end - begin)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is: a table of checked size."""
    return F.broadcast(df) if df.count() <= rows else df
