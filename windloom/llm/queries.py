"""The registered queries of this subpackage. Each one applies its operator to the whole table of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, conversation, decontaminate, hard_negatives, html_extract, license_scan, oracle, orc_output, packing, quality, simhash, substring_dedup, suffix_dedup, toxicity
from .common import Scratch, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = chroma.fingerprints(chroma.recordings(table(spark, sf_dir, "embeddings")))
    return chroma.linked(prints, F.coalesce(F.col("media_id") % 100 == 0, F.lit(False)))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.labels(license_scan.scan(table(spark, sf_dir, "documents")))


def op5_html_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-ids").path("orc")
    orc_output.write_orc(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return orc_output.ids_crc32(orc_output.read_orc(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hirschberg_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")))


def op12_tree_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.prepared(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = suffix_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"], digest=True)
    return marked.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_simhash_pivots, op3_chroma_fingerprints, op4_license_scan, op5_html_min_cut, op6_toxicity_fm, op7_substring_doubling, op8_decontamination, op9_orc_token_ids, op10_quality_qda, op11_hirschberg_repair, op12_tree_hard_negatives, op13_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
