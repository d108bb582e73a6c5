"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages go, documents
that hold benchmark passages go, and the rest is packed.

Each stage reads what the one before wrote. All but the last return the columns of documents, whatever they are: a stage
keeps a document's columns in one struct while it works, so no name can clash with its own.

Defined results: a null text counts as empty; an empty document is scored by the model's constant alone, is a near duplicate of
other empty ones, holds no passage and is packed as its end id; rows without doc_id go through all stages like any other,
but are never the document of a group that stays while it has others, and never lose passages; repeated rows are near
duplicates, so one of them stays; of rows that share a doc_id but not the text each is judged by its own text; very long
texts are worked on whole; ties are settled by doc_id, then by a hash of the text; an empty table goes through as an
empty table, and without labels, or without a benchmark, nothing is dropped by the stage that needs them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import decontaminate, packing, simhash, substring_dedup, toxicity
from windloom.llm.common import Scratch, table, text_or_empty, whole_row


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with a toxicity score below one half."""
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels")).where("score < 0.5").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: the one of the least doc_id, and of its rows the one whose text has the least hash."""
    kept = simhash.near_duplicates(docs).where("is_first").select(F.col("doc_id").alias("kept_id"), F.col("tie").alias("kept_tie")).distinct()
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("id"), F.xxhash64(text_or_empty()).alias("tie"))
    one = rows.groupBy("id", "tie").agg(F.first("row").alias("row"))  # repeated rows meet within each task before any of them travels
    return one.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("tie") == F.col("kept_tie")), "left_semi").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; documents of which no word is left go, untouched texts stay as they are."""
    marked = substring_dedup.mark(docs).where("n_removed = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")), "n_chars": F.when(cut, F.length("kept").cast("long"))}
    return marked.select(*[(F.coalesce(new[c], F.col(f"row.`{c}`")) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that benchmark passages cover to a twentieth or more."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack token pieces into sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Hash fingerprints, a trained model and a tokenizer aren't SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
