"""Operator 9: token ids as ORC files.

Documents are range-partitioned by doc_id, encoded, and written in ascending order: one file for each range, with
integer run-length encoding, row indexes every ``row_stride`` rows and Bloom filters on doc_id, so a reader can take
stripes in parallel and skip those that cannot hold a document. A row stores where it starts within its range; the
ranges' totals (one row for each file) turn that into the place in the whole corpus.

Ranges follow the bytes of text, and equal doc_ids may span several: they are ordered by a hash of the text, then by the
partition that held them.

Defined results: null texts are empty (the end id alone); null doc_ids come first; rows of equal doc_id stand in the
order of a hash of their text, repeated rows one after the other; a very long text is one row; an empty table gives an
empty table; other input columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_steps, text_or_empty
from .encoding import encoder


def ranges_for(docs: DataFrame, range_bytes: int) -> int:
    """A range for each ``range_bytes`` of text, at least one for each core."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // range_bytes))


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, range_bytes: int = 64 << 20, row_stride: int = 1000, stripe_bytes: int = 16 << 20) -> None:
    """Write range_id, doc_id, local_start, n_tokens and token_ids."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        enc, at = encoder(tokenizer), 0
        for batch in batches:
            for a, z in byte_steps(batch.column(2)):
                ids, stops = enc.encode(batch.column(2).slice(a, z - a))
                ids, stops = np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)
                starts = np.concatenate([[0], stops[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(at + starts), pa.array(stops - starts), lists], names=["range_id", "doc_id", "local_start", "n_tokens", "token_ids"])
                at += int(stops[-1])

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    keyed = texts.withColumn("tie", F.xxhash64("text")).withColumn("part", F.spark_partition_id())  # one id or one text may be in a third of all rows
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("part")]
    ordered = keyed.repartitionByRange(ranges_for(docs, range_bytes), *order).sortWithinPartitions(*order)
    rows = ordered.select(F.spark_partition_id().alias("range_id"), "doc_id", "text").mapInArrow(run, f"range_id int, doc_id {id_type.simpleString()}, local_start long, n_tokens long, token_ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(row_stride), "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "compression": "zstd"}
    rows.write.mode("overwrite").options(**options).orc(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """range_id, doc_id, start, n_tokens, token_ids, read from the files."""
    rows = spark.read.orc(path)
    totals = sorted(rows.groupBy("range_id").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each file
    starts, at = [], 0
    for r in totals:
        starts.append((r["range_id"], at))
        at += r["n"]
    first = spark.createDataFrame(starts, "range_id int, range_start long")
    joined = rows.join(F.broadcast(first), "range_id")  # as many rows as there are files
    return joined.select("range_id", "doc_id", (F.col("range_start") + F.col("local_start")).alias("start"), "n_tokens", "token_ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace token_ids by the crc32 of the ids as little-endian unsigned 32-bit integers."""
    fields = [f for f in rows.schema if f.name != "token_ids"]

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(names.index("token_ids"))
            raw, cuts = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes(), lists.offsets.to_numpy()
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(names.index(f.name)) for f in fields] + [pa.array(crc, pa.int64())], names=[f.name for f in fields] + ["ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{schema}, ids_crc32 long")
