"""Operator 3: audio fingerprints of a media column.

A recording (binary, 16-bit little-endian mono samples) becomes frames of twelve pitch-class energies. An integral image
over (time x pitch class) gives the sum of any rectangle in four look-ups; sixteen filters compare two or three such
rectangles each, and each comparison is quantised to two bits, so that every time step gives one packed 32-bit integer.

Recordings are aligned through these integers. Two integers that agree in two of their four bytes or more, held tones
included, vote for an offset between two recordings; the histogram of offsets names the best one, and the share of
differing bits over the whole overlap at that offset decides. Recordings of equal fingerprints are one class from the
start: classes are compared, copies are only counted. Queries and classes meet block by block, so that votes are counted
where they arise and only links leave a task.

Defined results: null, empty and too short recordings have no integers; they are one class, whose rows link to nothing, not
even to each other; an odd last byte is ignored; very long recordings are fingerprinted whole; ties between offsets go to
the one with the least absolute value, then the lower; repeated rows are copies of one class; rows without an id are
fingerprinted but are never queries; an empty table gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_heavy, steps

RATE, FRAME, HOP = 4000, 1024, 256
LOW_HZ, HIGH_HZ = 110.0, 1760.0
#: Time steps of the longest filter.
SPAN = 12
#: A quantiser's borders, in the logarithm of the ratio of two energies.
BORDERS = (-0.25, 0.0, 0.25)
MIN_VOTES, MAX_ERROR = 2, 0.2
#: Least overlap in steps: what two votes of consecutive integers span.
MIN_OVERLAP = 3
#: The two bytes of a key; at a fifth of wrong bits one integer in eight still agrees in two bytes.
KEYS = list(combinations(range(4), 2))
#: Recordings of a block, query steps indexed at once and votes counted at once.
BLOCK, INDEXED, AT_ONCE = 2048, 1 << 18, 1 << 21


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, time steps), by rule: kinds in turn over spread-out places and sizes."""
    return [(k % 4, 5 * k % 9, 2 + k % 3 + (k % 4 == 2), SPAN - 4 * (k % 3)) for k in range(16)]


def chroma_frames(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 energies, each frame scaled to length one."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.arange(power.shape[1]) * RATE / FRAME
    use = np.flatnonzero((hz >= LOW_HZ) & (hz <= HIGH_HZ))
    pitch = np.rint(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    energy = power[:, use] @ np.eye(12)[pitch]
    return energy / np.maximum(np.sqrt((energy**2).sum(axis=1, keepdims=True)), 1e-9)


def packed_integers(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each time step that has SPAN frames."""
    n = len(frames) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for k, (kind, p, high, wide) in enumerate(filters()):
        p1, half, third = min(12, p + high), wide // 2, wide // 3
        if kind == 0:  # earlier against later
            a, b = area(0, half, p, p1), area(half, wide, p, p1)
        elif kind == 1:  # lower against higher pitch classes
            m = (p + p1) // 2
            a, b = area(0, wide, p, m), area(0, wide, m, p1)
        elif kind == 2:  # crosswise
            m = (p + p1) // 2
            a, b = area(0, half, p, m) + area(half, wide, m, p1), area(0, half, m, p1) + area(half, wide, p, m)
        else:  # the middle against both ends
            a, b = 2 * area(third, wide - third, p, p1), area(0, third, p, p1) + area(wide - third, wide, p, p1)
        level = np.searchsorted(BORDERS, np.log((a + 0.05) / (b + 0.05)), "right")
        out |= (level ^ (level >> 1)).astype(np.uint32) << np.uint32(2 * k)  # neighbouring levels differ in one bit
    return out


def fingerprint(recording: bytes | None) -> np.ndarray:
    raw = recording or b""
    return packed_integers(chroma_frames(np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64)))


def fingerprints(media: DataFrame, key: str = "media_id", audio: str = "audio") -> DataFrame:
    """key and chroma (the packed integers, as signed ints)."""

    def run(batches):
        for batch in batches:
            for a, z in steps(batch.num_rows, 64):
                part = batch.slice(a, z - a)
                rows = [fingerprint(x).view(np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(pa.int32()))], names=[key, "chroma"])

    return media.select(key, audio).mapInArrow(run, f"`{key}` {media.schema[key].dataType.simpleString()}, chroma array<int>")


def _key(values: np.ndarray, k: int) -> np.ndarray:
    a, b = KEYS[k]
    byte = lambda i: values >> np.uint32(8 * i) & np.uint32(255)
    return (byte(a) << np.uint32(8) | byte(b)).astype(np.int64)


class Index:
    """Queries by the keys of their integers."""

    def __init__(self, prints: list[np.ndarray]):
        self.size = np.array([len(p) for p in prints], np.int64)
        self.start = self.size.cumsum() - self.size
        self.values = np.concatenate(prints)
        self.owner = np.repeat(np.arange(len(prints)), self.size)
        self.order, self.first = [], []
        for k in range(len(KEYS)):
            key = _key(self.values, k)
            self.order.append(np.argsort(key, kind="stable"))
            self.first.append(np.searchsorted(key[self.order[k]], np.arange(65537)))

    def histogram(self, other: np.ndarray) -> np.ndarray:
        """Votes by query and offset: query i's offset o is at start[i] + (i + 1) * len(other) + o."""
        n = len(other)
        votes = np.zeros(len(self.values) + n * len(self.size) + 1, np.int64)
        for k, (a, b) in enumerate(KEYS):
            key = _key(other, k)
            first, many = self.first[k][key], self.first[k][key + 1] - self.first[k][key]
            ends = many.cumsum()
            for lo in range(0, int(ends[-1]), AT_ONCE):
                place = np.arange(lo, min(lo + AT_ONCE, int(ends[-1])))
                j = np.searchsorted(ends, place, "right")
                at = self.order[k][first[j] + place - (ends[j] - many[j])]
                differ, once = self.values[at] ^ other[j], np.ones(len(at), bool)
                for c in range(b):  # an earlier key has counted these
                    if c != a:
                        once &= (differ >> np.uint32(8 * c) & np.uint32(255)) != 0
                at, j = at[once], j[once]
                votes += np.bincount(at + n * (self.owner[at] + 1) - j, minlength=len(votes))
        return votes

    def links(self, other: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, offset, votes, overlap, error) of the queries that align with another recording."""
        n, votes = len(other), self.histogram(other)
        at = np.flatnonzero(votes >= MIN_VOTES)
        base = self.start + n * np.arange(1, len(self.size) + 1)
        q = np.searchsorted(base - n, at, "right") - 1
        offset = at - base[q]
        first = np.maximum(offset, 0)
        overlap = np.minimum(self.size[q] - first, n - (first - offset))
        order = np.lexsort((offset, abs(offset), -votes[at], q))
        order = order[overlap[order] >= MIN_OVERLAP]
        best = order[np.flatnonzero(np.diff(q[order], prepend=-1))]
        q, offset, first, overlap, many = q[best], offset[best], first[best], overlap[best], votes[at[best]]
        if not len(q):
            return q, offset, many, overlap, np.zeros(0)
        begin = overlap.cumsum() - overlap
        step = np.arange(int(overlap.sum())) - np.repeat(begin, overlap)
        one, two = self.values[np.repeat(self.start[q] + first, overlap) + step], other[np.repeat(first - offset, overlap) + step]
        error = np.add.reduceat(np.bitwise_count(one ^ two).astype(np.int64), begin) / (32.0 * overlap)
        near = error <= MAX_ERROR
        return q[near], offset[near], many[near], overlap[near], error[near]


LINK = "q long, m long, offset int, votes long, overlap int, error double"


def block_links(asked: pa.Table, classes: pa.Table) -> pa.Table:
    """Links between a block of queries and a block of classes."""
    read = lambda t, kind: [(k, np.array(c, np.int32).view(np.uint32)) for k, c in zip(t[kind].to_pylist(), t[f"{kind}_chroma"].to_pylist())] if t.num_rows else []
    queries, others, found = sorted(read(asked, "q"), key=lambda r: r[0]), read(classes, "m"), []
    ends = np.cumsum([len(c) for _, c in queries], dtype=np.int64)
    for part in np.split(np.arange(len(queries)), np.flatnonzero(np.diff(ends // INDEXED)) + 1) if queries else []:
        index, kinds = Index([queries[i][1] for i in part]), np.array([queries[i][0] for i in part], np.int64)
        for kind, chroma in others:
            q, *rest = index.links(chroma)
            keep = kinds[q] != kind
            found.append([kinds[q][keep], np.full(int(keep.sum()), kind, np.int64), *(x[keep] for x in rest)])
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()))], names=["q", "m", "offset", "votes", "overlap", "error"])


def align(prints: DataFrame, is_query: Column, key: str = "media_id") -> DataFrame:
    """Each query's class against every class it aligns with.

    query_id, match_id (least id of the matched class), n_copies (rows of that class other than the query), offset, votes,
    overlap, error. A query's own class is listed if it has other rows.
    """
    scratch = Scratch(prints.sparkSession, "chroma")
    kind = F.xxhash64("chroma")
    rows = scratch.save(prints.select(F.col(key).alias("id"), is_query.alias("asked"), kind.alias("kind"), "chroma"), "prints")
    classes = scratch.save(rows.groupBy("kind").agg(F.min("id").alias("match_id"), F.count("*").alias("rows"), F.max("asked").alias("asked"), F.first("chroma").alias("chroma")), "classes")
    voting = classes.where(F.size("chroma") >= MIN_OVERLAP).select("kind", "chroma", "asked")
    blocks = lambda rows: max(1, -(-rows.count() // BLOCK))
    q_blocks, m_blocks = blocks(voting.where("asked")), blocks(voting)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod("kind", F.lit(n)).cast("int")
    asked = voting.where("asked").select(block(q_blocks).alias("qb"), every(m_blocks).alias("mb"), F.col("kind").alias("q"), F.col("chroma").alias("q_chroma"))
    other = voting.select(every(q_blocks).alias("qb"), block(m_blocks).alias("mb"), F.col("kind").alias("m"), F.col("chroma").alias("m_chroma"))
    met = asked.groupBy("qb", "mb").cogroup(other.groupBy("qb", "mb"))
    found = met.applyInArrow(block_links, LINK)
    pairs = found.join(classes.select(F.col("kind").alias("m"), "match_id", "rows"), "m").select("q", "match_id", F.col("rows").alias("n_copies"), "offset", "votes", "overlap", "error")
    own = classes.where("asked and rows > 1 and size(chroma) > 0").select(F.col("kind").alias("q"), "match_id", (F.col("rows") - 1).alias("n_copies"), F.lit(0).alias("offset"), F.size("chroma").cast("long").alias("votes"), F.size("chroma").alias("overlap"), F.lit(0.0).alias("error"))
    queries = rows.where("asked").select(F.col("id").alias("query_id"), F.col("kind").alias("q")).distinct()
    return queries.join(pairs.unionByName(own), "q").drop("q")


def linked(prints: DataFrame, is_query: Column, key: str = "media_id") -> DataFrame:
    """One row for each recording: its class (least id of equal fingerprints), its time steps, and for queries the links.

    n_links counts the recordings that a query aligns with, the other rows of its own class included; the best link is the one of
    the least error, then of the most votes, then of the least id.
    """
    scratch = Scratch(prints.sparkSession, "chroma-prints")
    prints = scratch.save(prints.withColumn("kind", F.xxhash64("chroma")), "all")
    found = align(prints, is_query, key)
    best = F.min(F.struct("error", (-F.col("votes")).alias("v"), "match_id", "offset"))
    links = found.groupBy("query_id").agg(F.sum("n_copies").alias("n_links"), best.alias("best"))
    classes = scratch.save(prints.groupBy("kind").agg(F.min(key).alias("class_id"), F.count("*").alias("class_rows")), "classes")
    rows = join_heavy(prints, classes, ["kind"], "class_rows", prints.count()).join(links, F.col(key) == F.col("query_id"), "left")
    return rows.select(key, "class_id", "class_rows", F.size("chroma").alias("n_steps"), is_query.alias("is_query"), F.when(is_query, F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.col("best.match_id").alias("best_match_id"), F.col("best.offset").alias("best_offset"), F.col("best.error").alias("best_error"))


def recordings(vectors: DataFrame) -> DataFrame:
    """media_id and audio derived from embeddings: each number is a tone of HOP samples, its height the number's rank among 24 semitones."""

    def run(batches):
        t = np.arange(HOP) / RATE
        tones = np.round(12000 * np.sin(2 * np.pi * 220.0 * 2 ** (np.arange(24)[:, None] / 12) * t)).astype("<i2")
        for batch in batches:
            for a, z in steps(batch.num_rows, 64):
                part = batch.slice(a, z - a)
                audio = []
                for v in part.column(1).to_pylist():
                    x = np.nan_to_num(np.array([np.nan if e is None else e for e in v or []], np.float64))
                    pitch = np.clip(np.floor(12 + 8 * x / max(1e-9, x.std())) if len(x) else x, 0, 23).astype(int)
                    audio.append(tones[pitch].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], names=["media_id", "audio"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, f"media_id {vectors.schema['vec_id'].dataType.simpleString()}, audio binary")
