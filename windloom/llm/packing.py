"""Operator 1: best-two-fit packing of token pieces into fixed-length sequences.

A sequence is filled greedily with the longest pieces that still fit. Where a gap stays, the smallest piece of the
sequence gives way to the two unpacked pieces that fill the widened gap best, if they fill it more tightly.

Pieces are written once, then dealt by a hash into groups of about ``group_rows`` pieces, each packed by its own task, so the
work spreads with the corpus and no task ever sees more than its group. A group wastes less than about one sequence.

Defined results: a null text counts as empty (one piece, the end id alone); a null doc_id and repeated rows are packed
like any other row, however many there are; a very long text becomes as many pieces as it needs; ties between pieces of
one length are settled by doc_id and piece; an empty table gives an empty table; other input columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_steps, text_or_empty
from .encoding import encoder

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(document, piece, start, length) of all pieces: a document's pieces are full but the first, which holds the remainder."""
    pieces = -(-sizes // capacity)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = sizes[owner] - (pieces[owner] - 1) * capacity
    return owner, piece, np.where(piece, first + (piece - 1) * capacity, 0), np.where(piece, capacity, first)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them: doc_id, piece, start, length, ids_crc32 and, if asked for, token_ids."""
    id_type = docs.schema["doc_id"].dataType

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for a, z in byte_steps(batch.column(1)):
                ids, stops = enc.encode(batch.column(1).slice(a, z - a))
                ids, stops = np.insert(ids, stops, end_id), stops + np.arange(1, len(stops) + 1)
                owner, piece, start, length = cut(np.diff(stops, prepend=0), capacity)
                ends = np.cumsum(length)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * k]) for i, k in zip((ends - length).tolist(), ends.tolist())]
                columns = [batch.column(0).slice(a, z - a).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = PIECES.format(id=id_type.simpleString()) + (", token_ids array<int>" if keep_ids else "")
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. Equal lengths are interchangeable and taken in the given order."""
    count = np.bincount(lengths, minlength=capacity + 1)
    present = bytearray((count > 0).astype(np.uint8).tobytes())
    sizes = np.arange(capacity + 1)

    def take(size: int, by: int = 1) -> None:
        count[size] -= by
        present[size] = bool(count[size] > 0)

    def best_pair(room: int) -> tuple[int, int]:
        """The two unpacked pieces of the largest joint length up to ``room``; (0, 0) if none."""
        here = np.frombuffer(present, np.uint8)[: room + 1]
        large = np.flatnonzero(here)
        if not len(large):
            return 0, 0
        below = np.maximum.accumulate(np.where(here, sizes[: room + 1], 0))  # the largest unpacked length up to each length
        small = np.minimum(room - large, large)
        other = below[small]
        single = (other == large) & (count[large] < 2)
        other = np.where(single, below[np.maximum(small - 1, 0)], other)
        total = np.where(other > 0, large + other, 0)
        k = int(total.argmax())
        return (int(large[k]), int(other[k])) if total[k] else (0, 0)

    bins: list[list[int]] = []
    left = len(lengths)
    while left:
        chosen, gap = [], capacity
        while gap and (size := present.rfind(1, 1, gap + 1)) > 0:
            n = min(int(count[size]), gap // size)
            chosen += [size] * n
            take(size, n)
            gap -= n * size
        if gap:
            least = chosen[-1]
            a, b = best_pair(gap + least)
            if a + b > least:
                chosen.pop()
                take(least, -1)
                take(a)
                take(b)
                chosen += [a, b]
        bins.append(chosen)
        left -= len(chosen)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    next_of = np.concatenate([[0], np.cumsum(np.bincount(lengths, minlength=capacity + 1))])[:-1]
    for k, chosen in enumerate(bins):
        at = 0
        for size in chosen:
            row = order[next_of[size]]
            next_of[size] += 1
            sequence[row], offset[row] = k, at
            at += size
    return sequence, offset


def pack(pieces: DataFrame, capacity: int, group_rows: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces, which should be a written table: it is counted first.

    Repeated rows are told apart by the partition that holds them and their number there, so that they spread over groups too.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    columns = pieces.columns
    once = pieces.withColumn("pack_part", F.spark_partition_id()).groupBy(*columns, "pack_part").agg(F.count("*").alias("pack_copies"))
    each = once.withColumn("pack_copy", F.explode(F.sequence(F.lit(1), F.col("pack_copies"))))
    key = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "pack_part", "pack_copy"), F.lit(groups)).cast("long")

    def run(key, group):
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_two_fit(group["length"].to_numpy(), capacity)
        base = key[0].as_py() << 32
        return group.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(base + sequence)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return each.select(*columns, key.alias("pack_group")).groupBy("pack_group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Every document's pieces with the sequence and offset where each one stands."""
    pieces = Scratch(docs.sparkSession, "packing").save(token_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    return pack(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (of pieces with token_ids): sequence_id, token_ids, doc_ids. A group is one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "token_ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.token_ids")).alias("token_ids"), F.col("parts.doc_id").alias("doc_ids"))
