"""Registers the queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mldiag.llm import (
    divergence,
    exact_dedup,
    language,
    licences,
    lines,
    merkle,
    mixing,
    repair,
    simhash,
    slots,
    sql,
    transducer,
    turns,
    weak_labels,
)
from mldiag.llm.common import documents, new_path
from mldiag.llm.registry import query


@query("op1_repair_blocks")
def op1_repair_blocks(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "tokens")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        repair.write_tokens(documents(spark, folder), path, file.read())
    return repair.read_documents(spark, path)


@query("op2_distribution_divergence")
def op2_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.measures(documents(spark, folder))


@query("op3_virtual_slots")
def op3_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    return slots.assign(documents(spark, folder))


@query("op4_weak_label_model")
def op4_weak_label_model(spark: SparkSession, folder: str) -> DataFrame:
    return weak_labels.classify(documents(spark, folder))


@query(
    "op5_patricia_owners",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op5_patricia_owners(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder))


@query("op6_shortest_path_pieces")
def op6_shortest_path_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return transducer.digest(documents(spark, folder), transducer.read_model(public_tokenizers.path("piece_bpe_32k.model")))


@query("op7_golay_simhash")
def op7_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(documents(spark, folder))


@query("op8_subset_sum_mix")
def op8_subset_sum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(documents(spark, folder))


@query("op9_kneser_ney_language")
def op9_kneser_ney_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(documents(spark, folder))


@query("op10_licence_paragraphs")
def op10_licence_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(documents(spark, folder))


@query("op11_turn_repair", sql.TURNS)
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turns.repair_damaged(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("op12_interval_manifest", sql.MANIFEST)
def op12_interval_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(documents(spark, folder), merkle.tampering())


@query("op13_perfect_hash_lines", sql.LINES)
def op13_perfect_hash_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_lines(documents(spark, folder))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
