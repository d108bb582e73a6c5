"""Operator 2: SimHash near-duplicates through pivot distance tables.

Each text gets a 64-bit fingerprint: a bit is set if it is set in over half of the hashes of the text's shingles. Texts
of one fingerprint are one class from then on. The pivot table holds the Hamming distances of each class to 49 reference
fingerprints. References are zero and, for each group of four bits, three that are set in three of these bits: what a
distance exceeds that to zero by depends on one group only, and the three coordinates of a group tell its bits apart.

Candidates come from the table. Two classes within two bits differ in two groups at most, so of four blocks of four
groups at least two have equal coordinates, and a pair shares one of six keys made of them. Buckets of over ``BUCKET``
classes are split by more coordinates of the same table: of the eight groups outside of the bucket's two blocks, six must
agree, which gives 28 finer keys. A finer bucket leaves eight bits free, so it never holds more than 256 classes, and
pairs stay proportional to the rows, however large a group of near copies is. Of the pairs that meet, those with a
coordinate difference above two are discarded (no pair within two bits has one), and the survivors are verified by their own
distance. No link is lost at any size.

Defined results: a null, empty or blank text has no words and fingerprint zero, which links like any other; very long texts
are hashed whole; a null doc_id is never a component_id unless all ids of the component are null; repeated rows and rows
that share a doc_id get their own text's result; an empty table gives an empty table; other input columns are not read,
whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_steps, join_heavy, text_or_empty
from .components import components

#: Buckets of more classes are split by further coordinates before pairs are formed.
BUCKET = 48
#: Groups of four bits, and the differing bits that link.
GROUPS, RADIUS = 16, 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    stops = ends[-n:].tolist()
    hashes = np.fromiter(map(xxh64_intdigest, [joined[a:z] for a, z in zip(starts, stops)], repeat(seed)), np.uint64, n)
    bits = np.zeros(64, np.int64)
    for a in range(0, n, 4096):
        bits += np.unpackbits(hashes[a : a + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, tie (a hash of the text) and fingerprint (signed long)."""

    def run(batches):
        for batch in batches:
            for a, z in byte_steps(batch.column(2), 1 << 20):
                found = [fingerprint(t, width) for t in batch.column(2).slice(a, z - a).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), batch.column(1).slice(a, z - a), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "tie", "fp"])

    texts = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    return texts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, fp long")


def references() -> list[int]:
    """The reference fingerprints: zero, and for each group of four bits the three that are set in three of its bits as named."""
    return [0, *(mask << 4 * g for g in range(GROUPS) for mask in (0b1101, 0b1011, 0b0111))]


def pivot_row(fp: Column) -> list[Column]:
    """The distances (0 to 64) to all references, a byte each, seven to a long."""
    distance = [F.bit_count(fp.bitwiseXOR(F.lit(p if p < 2**63 else p - 2**64))).cast("long") for p in references()]
    return [reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * k) for k, d in enumerate(distance[i : i + 7])]) for i in range(0, len(distance), 7)]


PIVOTS = [f"pivots_{i}" for i in range(7)]


def _coordinate(k: int) -> Column:
    return F.shiftrightunsigned(F.col(PIVOTS[k // 7]), 8 * (k % 7)).bitwiseAND(F.lit(127).cast("long"))


def _group(g: int) -> Column:
    """What the table tells of four bits: their three coordinates against the coordinate of reference zero, 3 bits each."""
    beyond = [_coordinate(1 + 3 * g + k) - _coordinate(0) + 3 for k in range(3)]
    return reduce(Column.bitwiseOR, [F.shiftleft(d, 3 * k) for k, d in enumerate(beyond)])


def _near(a: str, b: str) -> Column:
    """No coordinate differs by more than the radius: in every byte, 2 + a - b and 2 + b - a are not negative."""
    high, room = F.lit(0x80808080808080), F.lit(RADIUS * 0x01010101010101)
    keep = F.lit(True)
    for p in PIVOTS:
        x, y = F.col(f"{a}.{p}"), F.col(f"{b}.{p}")
        keep &= ((x.bitwiseOR(high) + room - y).bitwiseAND(y.bitwiseOR(high) + room - x)).bitwiseAND(high) == high
    return keep


def _blocks(parts: Column) -> Column:
    """Six keys: the coordinates of two blocks of four groups."""
    four = [F.slice(parts, 4 * k + 1, 4) for k in range(4)]
    return F.array(*[F.struct(F.lit(i).alias("pair"), F.xxhash64(F.lit(i), four[a], four[b]).alias("key")) for i, (a, b) in enumerate(combinations(range(4), 2))])


def _free(parts: Column, pair: Column) -> Column:
    """The coordinates of the eight groups outside of the two blocks of a key."""
    free = F.lit(None)
    for i, (a, b) in enumerate(combinations(range(4), 2)):
        free = F.when(pair == i, F.concat(*[F.slice(parts, 4 * k + 1, 4) for k in range(4) if k not in (a, b)])).otherwise(free)
    return free


def _finer(free: Column, key: Column) -> Column:
    """28 keys: the key and the coordinates of six of the eight groups outside of its two blocks."""
    return F.array(*[F.xxhash64(key, F.lit(n), *[free[g] for g in range(8) if g not in left]) for n, left in enumerate(combinations(range(8), 2))])


def links(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v): all pairs of fingerprints within RADIUS bits of each other."""
    table = scratch.save(classes.select("fp", *[p.alias(n) for p, n in zip(pivot_row(F.col("fp")), PIVOTS)]), "pivots")
    named = scratch.save(table.withColumn("parts", F.array(*[_group(g) for g in range(GROUPS)])), "parts")  # written, as three plans read it
    scratch.drop("pivots")
    rows = named.select("*", F.explode(_blocks(F.col("parts"))).alias("k")).select("fp", *PIVOTS, "parts", "k.pair", "k.key")
    sizes = scratch.save(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    met = scratch.save(join_heavy(rows, sizes, ["key"], "n", 6 * classes.count()), "bucket-rows")
    crowded = scratch.save(met.where(F.col("n") > BUCKET).select("key", "fp", *PIVOTS, _free(F.col("parts"), F.col("pair")).alias("free")), "crowded")
    split = crowded.withColumn("key", F.explode(_finer(F.col("free"), F.col("key"))))
    bucket = scratch.save(met.where(F.col("n") <= BUCKET).select("key", "fp", *PIVOTS).unionByName(split.select("key", "fp", *PIVOTS)), "buckets")
    for name in ("parts", "bucket-rows", "crowded"):
        scratch.drop(name)
    pairs = bucket.alias("a").join(bucket.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & _near("a", "b"))
    verified = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS)
    return verified.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable), n_copies (rows of that fingerprint), tie, is_first.

    ``tie`` is a hash of the text. ``is_first`` marks the row that can stand for its component, the least by (doc_id, tie); rows
    repeated with one doc_id and text are all marked.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(fingerprints(docs, width), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    classes = scratch.save(rows.groupBy("fp").agg(first, F.count("*").alias("n_copies")), "classes")
    labels = components(links(classes, scratch), scratch)
    joined = scratch.save(classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "n_copies", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    least = scratch.save(joined.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("n_classes")), "least-ids")
    answers = scratch.save(join_heavy(joined, least, ["label"], "n_classes", joined.count()).select("fp", "least", "n_copies"), "answers")
    found = join_heavy(rows, answers, ["fp"], "n_copies", rows.count())
    is_first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tie") == F.col("least.tie"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"), "n_copies", "tie", is_first.alias("is_first"))
