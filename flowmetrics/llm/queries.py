"""The checked queries of the corpus operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmetrics.llm import collision_search, decontamination, fingerprints, language, lines, pii, prefix_trie, quality, similarity_join, whitening
from flowmetrics.llm.common import shared_folder, table
from flowmetrics.llm.packing import pack, token_pieces
from flowmetrics.llm.token_counts import count_tokens
from flowmetrics.llm.token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return kept.select("doc_id", F.col("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join("gone", ",").alias("removed"))


ORACLES["op2_line_dedup"] = lines.ORACLE_SQL


def remainder(key: str, of: int):
    """crc32 of the key as text, modulo ``of``: the folds of the contracts."""
    return F.crc32(F.col(key).cast("string")) % of


def held_out(key: str, of: int, fold: int):
    """Whether the key falls into ``fold``; a null key does not."""
    return F.coalesce(remainder(key, of) == fold, F.lit(False)).alias("held_out")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull()), "doc_id", "text", "lang")
    found = language.predict(docs, "doc_id", "text", model)
    return found.select("doc_id", held_out("doc_id", 4, 2), "lang_pred", "score")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))
    return pack(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), "doc_id")


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(remainder("doc_id", 5) != 0), "doc_id", "text", "quality")
    found = quality.score(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "tokens")
    write_token_files(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    read = read_token_files(spark, folder, "doc_id", docs.schema["doc_id"].dataType)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, "doc_id", "text", pii.fit(docs, "doc_id", "text"))
    counts = [F.regexp_count("spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


@query
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit_and_next(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = prefix_trie.turn_sequences(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(prefix_trie.with_shared_heads(sequences)).withColumnRenamed("saved", "saved_tokens")


ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE_SQL


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows), "vec_id")


@query
def op13_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0)


ORACLES["op13_collision_search"] = collision_search.ORACLE_SQL
