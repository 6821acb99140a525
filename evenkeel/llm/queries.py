"""Registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import (angle_windows, chat_events, feistel_shards, grouping_packer, id_files, line_rules, lsh_forest,
                          pareto_mix, pivotal_grams, pseudo_likelihood, quadratic_classifier, secret_scan,
                          spherical_cells)
from evenkeel.llm.common import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the verdict of cross-document line frequency for every document."""
    return line_rules.apply_rules(table(spark, sf_dir, "documents"))


def op2_mixing_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, read back from range-coded id files."""
    path = id_files.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return id_files.read_documents(spark, path)


def op3_event_sourced_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of conversations read back from formatted turns folded out of an event log."""
    chats = chat_events.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat_events.read_back(chat_events.format_chats(chat_events.log_of(chats)))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under a Feistel permutation of row numbers."""
    placed = feistel_shards.shard(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a weighted mix of sources takes of every document."""
    return pareto_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from a regularised quadratic discriminant."""
    return quadratic_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-log-likelihood of every document."""
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


def op8_grouping_genetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 ids."""
    return grouping_packer.pack_documents(table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("word_bpe_49k.json"))


def op9_spherical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group and links of every embedding."""
    return spherical_cells.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return lsh_forest.join(table(spark, sf_dir, "documents"))


def op11_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, also inside nested encodings."""
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("found")


def op12_angle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive among all embeddings."""
    return angle_windows.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of the documents."""
    return pivotal_grams.group(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_line_frequency, op2_mixing_coder, op3_event_sourced_chats, op4_feistel_shards, op5_pareto_mix,
    op6_quadratic_discriminant, op7_pseudo_likelihood, op8_grouping_genetic, op9_spherical_cells, op10_lsh_forest,
    op11_decoding_worklist, op12_angle_windows, op13_pivotal_grams)}
ORACLE = {"op1_line_frequency": line_rules.ORACLE, "op5_pareto_mix": pareto_mix.oracle(),
          "op12_angle_windows": angle_windows.ORACLE}
