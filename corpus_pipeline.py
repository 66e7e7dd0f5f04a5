"""From raw documents to packed token sequences: five stages, each written and read again before the next.

``run`` applies them to the documents of a folder; each stage also stands alone as ``(spark, docs, sf_dir)``. All but the
last return the columns of their input. A stage's decision takes effect on the rows or texts it returns: documents of
low quality go, repeated and near-equal lines leave their texts, one document of each near-duplicate class stays, and
documents that hold a benchmark item go. Decisions are made per row, so rows with a null or repeated key are kept or
dropped by their own text like others; a document that loses all its lines stays as an empty text until the
near-duplicate stage, which keeps one of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmetrics.llm import decontamination, lines, quality, similarity_join
from flowmetrics.llm.common import free_name, prepare, small, table
from flowmetrics.llm.packing import pack, token_pieces
from flowmetrics.session import settle

KEY, TEXT = "doc_id", "text"
#: The classifier's accepted scores begin here; the fold of labelled rows that it never sees.
CUT, FOLDS, HELD_OUT = 0.3, 5, 0
SMALL_ROWS = 200_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col(KEY).cast("string")) % FOLDS != HELD_OUT)
    scored = quality.score(docs, TEXT, quality.fit(docs, labels, KEY, TEXT, "quality"), CUT)
    return scored.where(F.col(scored.columns[-1]) >= CUT).select(*docs.columns)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    kept = lines.dedup_lines(docs, KEY, TEXT)
    columns = [F.char_length(TEXT).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    row = free_name(docs.columns, "row")
    rows = similarity_join.numbered(docs, row)
    kept = similarity_join.one_per_class(rows, KEY, TEXT, row)
    gone = settle(rows.select(row).join(kept, row, "left_anti"))
    return rows.join(small(gone, SMALL_ROWS), row, "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # Key and digest of the text: rows that share them hold the same items.
    own = free_name(docs.columns, "own")
    rows = docs.withColumn(own, F.struct(KEY, F.xxhash64(TEXT).alias("digest")))
    found = decontamination.matches(rows, own, TEXT, table(spark, sf_dir, "benchmark"), "item_id", "text")
    gone = settle(found.select(own).distinct())
    same = F.col(f"{own}.{KEY}").eqNullSafe(F.col(f"gone.{KEY}")) & (F.col(f"{own}.digest") == F.col("gone.digest"))
    return rows.join(small(gone.withColumnRenamed(own, "gone"), SMALL_ROWS), same, "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    pieces = token_pieces(docs, KEY, TEXT, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), KEY)


STAGES = [
    ("quality", good_quality),
    ("line_dedup", unique_lines),
    ("near_duplicates", one_of_each_class),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Quality scores come from a fitted model and pieces from a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
