"""Operator 7: repeated passages by level-wise doubling of windows.

A passage of ``width`` words that starts in a document with a smaller doc_id is removed, word by word. Windows are compared at
a quarter of the width first; those repeated there are extended to twice that length, and again, until the width is
reached or no candidate is left (13, 25 and 50 words). A level sees only what the one before left.

Level 1, a quarter: of each stretch of neighbouring full windows (a run) the one short window with the least hash stands
for them all, about one in twenty; equal full windows have equal short ones. Runs whose short window is found in one
document only are dropped. Runs that are equal word for word are one kind from here on: their windows are settled (all
but the least document's are repeats), and only the kind's first document goes on, against other kinds of its short window.

Level 2, a half: the surviving runs are read again and every window of half the width in them is hashed. Those found in
one document only (under one short window) are dropped.

Level 3, the width: a full window is its two halves, so it goes on only if both are left, and its name is the pair of
their names. Pairs found in several documents are repeats, in all documents of their kind.

Hashes are 64 bits, and a full window is matched under three of them (its short window's and its halves'). Counts and
minima are aggregations; no group of rows is ever gathered except a single document's own spans. A passage may be in a
third of all documents, so joins by window or run broadcast the few heaviest of them; a run has at most
width - width / 4 + 1 full windows, so what is broadcast stays below 2,000 times that many rows.

Spans belong to a row by its doc_id and a hash of its text, so rows that share a doc_id are judged each by its own text.

Defined results: null and empty texts have no words; texts of fewer words than ``width`` are never touched, however long
texts are whole; rows without doc_id never count as the smaller document and are never touched; rows of one doc_id are one
document as a source, and repeated rows get the same result; an empty table gives an empty table; extra columns pass
through inside ``row``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_steps, join_heavy, text_or_empty, texts_of, whole_row

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_LIMIT = 150_000


class WordHashes(dict):
    """word -> 64-bit hash, for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > _WORD_LIMIT:
            self.clear()
        h = xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD_2
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def stretch_hashes(hashes: np.ndarray, start: np.ndarray, size, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """mix(sum of hash[start + j] * base**j) for each start."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:n])])
        return mix((sums[start + size] - sums[start]) * back[start])


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


_BASES = {k: (np.uint64(b), np.uint64(_inverse(b))) for k, b in {"short": 0x5851F42D4C957F2D, "run": 0xD1342543DE82EF95, "half": 0xAF251AF3B0F025B5}.items()}


def levels(width: int) -> tuple[int, int]:
    """The window lengths below ``width``: a quarter and a half of it, rounded up, so that two of one make the next."""
    half = -(-width // 2)
    return -(-half // 2), half


def runs(hashes: np.ndarray, width: int, short: int) -> tuple[np.ndarray, ...]:
    """(hash of the short window, first full window, number of full windows) for each run of a document."""
    n_full = len(hashes) - width + 1
    if n_full <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    keys = stretch_hashes(hashes, np.arange(len(hashes) - short + 1), short, *_BASES["short"])
    span = width - short + 1  # short windows within a full one
    least = np.lib.stride_tricks.sliding_window_view(keys, span).argmin(axis=1) + np.arange(n_full)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([first, [n_full]]))
    return keys[least[first]], first, count


def _hash_words(text: str, known: WordHashes) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, tie (a hash of the text) and text of the rows that have an id."""
    return docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("tie"), "text")


def run_table(docs: DataFrame, width: int, short: int) -> DataFrame:
    """doc_id, tie, key (short window), run (its stretch of full windows), start and n, for all documents."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        known = WordHashes()
        for batch in batches:
            for a, z in byte_steps(batch.column(2), 1 << 20):
                owner, parts = [], []
                for i, text in enumerate(batch.column(2).slice(a, z - a).to_pylist(), a):
                    hashes = _hash_words(text, known)
                    key, first, count = runs(hashes, width, short)
                    if len(key):
                        owner.append(np.full(len(key), i))
                        parts.append((key, stretch_hashes(hashes, first, count + (width - 1), *_BASES["run"]), first, count))
                if parts:
                    key, run, first, count = (np.concatenate(x) for x in zip(*parts))
                    at = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc_id", "tie", "key", "run", "start", "n"])

    return keyed_texts(docs).mapInArrow(scan, f"doc_id {id_type}, tie long, key long, run long, start int, n int")


def half_windows(docs: DataFrame, wanted: DataFrame, width: int, half: int) -> DataFrame:
    """doc_id, key, run and n of the wanted runs, with the hashes of the half windows that their full windows begin or end with."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    step = width - half  # from a full window's first half to its second

    def scan(batches):
        known = WordHashes()
        for batch in batches:
            pairs = ((i, *pair) for a, z in byte_steps(batch.column(1), 1 << 20) for i, pair in enumerate(zip(batch.column(1).slice(a, z - a).to_pylist(), batch.column(2).slice(a, z - a).to_pylist()), a))
            for i, text, spans in pairs:
                hashes = _hash_words(text, known)
                first, count = np.array([s["start"] for s in spans], np.int64), np.array([s["n"] + step for s in spans], np.int64)
                ends = np.cumsum(count)
                at = np.repeat(first - ends + count, count) + np.arange(int(ends[-1]))
                found = stretch_hashes(hashes, at, half, *_BASES["half"]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(found))
                ids = batch.column(0).take(pa.array([i] * len(spans), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([s[c] for s in spans], t) for c, t in (("key", pa.int64()), ("run", pa.int64()), ("n", pa.int32()))), lists], names=["doc_id", "key", "run", "n", "halves"])

    by_doc = wanted.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("key", "run", "start", "n")).alias("spans"))  # of one document
    rows = keyed_texts(docs).join(by_doc, ["doc_id", "tie"]).dropDuplicates(["doc_id", "tie"]).select("doc_id", "text", "spans")
    return rows.mapInArrow(scan, f"doc_id {id_type}, key long, run long, n int, halves array<long>")


def repeated_spans(docs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """doc_id, tie, start (first word) and n (words) of the stretches to remove; they may overlap."""
    short, half = levels(width)
    step = width - half
    table = scratch.save(run_table(docs, width, short), "runs")
    # level 1: short windows of more than one document
    counted = table.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows"))
    shared = scratch.save(counted.where("lo < hi").select("key", "rows"), "shared")
    alive = scratch.save(join_heavy(table, shared, ["key"], "rows", table.count()).drop("rows"), "alive")
    scratch.drop("runs")
    scratch.drop("shared")
    n_alive = alive.count()
    # equal runs are one kind
    place = F.struct("doc_id", "tie", "start")
    kinds = scratch.save(alive.groupBy("key", "run").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.count("*").alias("rows")), "kinds")
    met = join_heavy(alive.drop("n"), kinds, ["key", "run"], "rows", n_alive)
    equal = met.where(F.col("doc_id") > F.col("first.doc_id")).select("doc_id", "tie", "start", (F.col("n") + width - 1).alias("n"))
    # level 2: half windows of the kinds' first documents, where several kinds share a short window
    per_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("first.doc_id").alias("lo"), F.max("first.doc_id").alias("hi"))
    mixed = scratch.save(per_key.where("kinds > 1 and lo < hi").select("key", "kinds"), "mixed")
    wanted = join_heavy(kinds, mixed, ["key"], "kinds", kinds.count()).select("first.doc_id", "first.tie", "key", "run", "first.start", "n")
    halves = scratch.save(half_windows(docs, wanted, width, half), "halves")
    each = halves.select("doc_id", "key", "run", "n", F.posexplode("halves").alias("at", "half"))
    n_each = halves.agg(F.sum(F.size("halves"))).first()[0] or 0
    several = lambda df, *by: df.groupBy(*by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi").drop("hi")
    twice = scratch.save(several(each, "key", "half").drop("lo"), "twice")
    left = scratch.save(join_heavy(each, twice, ["key", "half"], "rows", n_each).select("doc_id", "key", "run", "n", "at", "half"), "left")
    # level 3: full windows of which both halves are left
    second = left.select("doc_id", "key", "run", (F.col("at") - step).alias("at"), F.col("half").alias("half_2"))
    full = scratch.save(left.where("at < n").join(second, ["doc_id", "key", "run", "at"]).drop("n"), "full")
    again = scratch.save(several(full, "key", "half", "half_2"), "again")
    late = join_heavy(full, again, ["key", "half", "half_2"], "rows", full.count()).where(F.col("doc_id") > F.col("lo")).select("key", "run", "at", "lo")
    late = scratch.save(late.join(kinds.select("key", "run", "rows"), ["key", "run"]), "late")
    # what is late in a kind's first document is late in all documents of that kind
    of_kind = join_heavy(alive.select("doc_id", "tie", "key", "run", "start"), late, ["key", "run"], "rows", n_alive)
    differ = of_kind.where(F.col("doc_id") > F.col("lo")).select("doc_id", "tie", (F.col("start") + F.col("at")).alias("start"), F.lit(width).alias("n"))
    found = scratch.save(equal.unionByName(differ), "spans")
    for name in ("alive", "kinds", "mixed", "halves", "twice", "left", "full", "again", "late"):
        scratch.drop(name)
    return found


def mark(docs: DataFrame, width: int = 50) -> DataFrame:
    """row (the document as it came), n_words, n_removed, kept (the words that stay, joined by one space)."""
    scratch = Scratch(docs.sparkSession, "substrings")
    spans = repeated_spans(docs.select("doc_id", "text"), width, scratch)
    by_doc = spans.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("spans"))  # of one document
    rows = docs.select(F.col("doc_id"), F.xxhash64(text_or_empty()).alias("tie"), whole_row(docs))
    joined = rows.join(by_doc, ["doc_id", "tie"], "left").select("row", "spans")

    def cut(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, z in byte_steps(texts, 1 << 20):
                total, removed, kept = [], [], []
                for text, spans in zip(texts.slice(a, z - a).to_pylist(), batch.column(1).slice(a, z - a).to_pylist()):
                    words = text.encode().split()
                    stay = np.ones(len(words), bool)
                    for s in spans or ():
                        stay[s["start"] : s["start"] + s["n"]] = False
                    total.append(len(words))
                    removed.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay).tolist()]).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")


def digest(marked: DataFrame) -> DataFrame:
    return marked.select("row.doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
