"""Labelled rows for the two classifiers: a bounded sample, never of the held-out fifth.

Labels other than 0 and 1 don't count, nor do those of a doc_id that has both. Of several documents of one doc_id the one
whose text has the least hash stands for the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The most labelled rows that a classifier is fitted on. Its rows (an id and a label) are broadcast, so this bounds it.
MAX_LABELLED = 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text is divisible by five; rows without an id are held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_LABELLED, balanced: bool = False) -> DataFrame:
    """text and label of at most max_rows documents, those of the labelled ids with the least hash; if ``balanced``, half of them at most of each label."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where("label = other")
    least = lambda rows, n: rows.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = least(known.where("label = 0"), max_rows // 2).unionByName(least(known.where("label = 1"), max_rows // 2)) if balanced else least(known, max_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select(F.col("least.text").alias("text"), "label")
