"""Repeated byte strings by a sparse suffix array over range partitions.

Each byte covered by a string of ``width`` bytes that also starts elsewhere goes. Equal texts are one from the first step on:
two texts that are equal, and long enough, are repeated whole.

Suffixes. Of the short strings of ``SHORT`` bytes inside each full window the one of least hash (the first of these) is the
window's anchor, so equal windows have their anchors at the same place: the suffixes that start at anchors, about one in 130
bytes, are enough. Around an anchor its windows reach ``width - SHORT`` bytes back and ``width`` on; that stretch is its
context. Anchors whose short string occurs once are dropped; contexts that occur several times are settled (all of the
context is repeated), and one of them goes on, if its short string has other contexts.

Sort. ``repartitionByRange`` samples splitters and deals the suffixes out by their leading bytes, so that a splitter cuts no group
of equal short strings. A bucket sorts its suffixes by multikey quicksort, eight bytes at a time among those still tied, and in each group of equal short strings what stands before
them likewise, read backwards. Longest matches with the neighbours in both orders prove most windows repeated, and bound
what a window may reach at most; a window within the bounds that no neighbour proves is compared with all others of its group.
Groups too large for a bucket never go to one: they are compared across tasks. Lengths at which their parts still occur twice
bound the windows again, and these are counted by hash, as an aggregation.

Contexts are equal by two 64-bit hashes, texts by md5; inside a bucket bytes are compared.

Defined results: a null or empty text has no bytes and no spans; texts shorter than ``width`` stay as they are; rows of equal
text, with equal doc_id, other or none, count as often as they occur and get the same result; very long texts are scanned
in pieces and whole; an empty table gives an empty table; other columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_heavy, text_or_empty, whole_row
from .substring_dedup import mix

WIDTH, SHORT = 400, 64
#: Bytes scanned at once, suffixes that a bucket compares at once, and the most of one group; larger groups (of 48 MB and more) are compared across buckets.
PIECE, AT_ONCE, GROUP = 1 << 18, 4096, 1 << 16
_LOCAL = np.uint64((1 << 24) - 1)
_BASES = {k: (np.uint64(b), np.uint64(pow(b, -1, 2**64))) for k, b in {"short": 0x5851F42D4C957F2D, "context": 0xD1342543DE82EF95}.items()}
#: A 64-bit number for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sums:
    """Hashes of any stretch of an array of bytes, by running sums."""

    def __init__(self, data: np.ndarray, name: str):
        base, inverse = _BASES[name]
        n = len(data)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))
            self.back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, inverse, np.uint64)]))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * powers[:n])])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[high] - self.sums[low]) * self.back[low])


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    least, step = values, 1
    while 2 * step <= size:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    n = len(values) - size + 1
    return np.minimum(least[:n], least[size - step : size - step + n])


def _pieces(texts: list[bytes], width: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, first byte, end, first window, end) of stretches that hold all windows of the texts, and each window's context."""
    for i, text in enumerate(texts):
        last = len(text) - width + 1
        for first in range(0, last, size):
            end = min(last, first + size)
            yield i, max(0, first - width), min(len(text), end + 2 * width), first, end


def anchors(texts: list[bytes], width: int = WIDTH, short: int = SHORT, size: int = PIECE) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring anchors of one context: text, first and last place, bytes before and after in the context, two hashes, how many."""
    found, held, volume = [], [], 0
    done = np.full(len(texts), -1)
    for piece in _pieces(texts, width, size):
        held.append(piece)
        volume += piece[2] - piece[1]
        if volume >= size:
            found.append(_anchors_of(texts, held, done, width, short))
            held, volume = [], 0
    if held:
        found.append(_anchors_of(texts, held, done, width, short))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    return tuple(np.concatenate(column) for column in zip(*found))


def _anchors_of(texts: list[bytes], pieces: list[tuple[int, int, int, int, int]], done: np.ndarray, width: int, short: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(texts[i][low:high] for i, low, high, _, _ in pieces), np.uint8)
    owner, low, high, first, end = (np.array(column) for column in zip(*pieces))
    offset = np.cumsum(high - low) - (high - low)  # of a piece in the data
    brief = Sums(data, "short")
    at = np.arange(len(data) - short + 1)
    key = brief.of(at, at + short)
    least = _sliding_least((key & ~_LOCAL) | at.astype(np.uint64), width - short + 1)
    windows = np.repeat(offset + first - low - (np.cumsum(end - first) - (end - first)), end - first) + np.arange(int((end - first).sum()))
    chosen = (least[windows] & _LOCAL).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), end - first)
    text, place = owner[piece], chosen - offset[piece] + low[piece]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) & (place > done[text])  # not those of the piece before
    chosen, text, place = chosen[new], text[new], place[new]
    np.maximum.at(done, text, place)
    sizes = np.array([len(texts[i]) for i in range(len(texts))])
    before, after = np.minimum(place, width - short), np.minimum(sizes[text] - place, width)
    with np.errstate(over="ignore"):
        context = mix(Sums(data, "context").of(chosen - before, chosen + after) + (before * 4096 + after).astype(np.uint64))
    starts = np.concatenate([[True], (context[1:] != context[:-1]) | (key[chosen[1:]] != key[chosen[:-1]]) | (text[1:] != text[:-1])]) if len(text) else np.zeros(0, bool)
    runs = np.flatnonzero(starts)
    ends = np.append(runs[1:], len(text)) - 1 if len(runs) else runs
    return text[runs], place[runs], place[ends], before[runs], after[runs], key[chosen[runs]].view(np.int64), context[runs].view(np.int64), ends - runs + 1


def multikey_order(rows: np.ndarray, classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of rows of bytes within classes, a word of eight bytes after the other among the rows still tied; at last by size."""
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8")
    order = np.argsort(classes, kind="stable")
    rank = classes[order]
    for k in range(words.shape[1] + 1):
        same = rank[1:] == rank[:-1]
        tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(tied):
            break
        value = words[order[tied], k].astype(np.uint64) if k < words.shape[1] else sizes[order[tied]].astype(np.uint64)
        by = np.lexsort((value, rank[tied]))
        order[tied], value = order[tied][by], value[by]
        starts = np.concatenate([[True], (rank[tied][1:] != rank[tied][:-1]) | (value[1:] != value[:-1])])
        firsts = tied[np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))]
        rank = np.arange(len(order))  # a class is named by the place of its first row
        rank[tied] = firsts
    return order


def _common(rows: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common beginning of rows i and j."""
    differ = rows[i] != rows[j]
    found = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(found, np.minimum(sizes[i], sizes[j]))


def repeated_windows(classes: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, width: int) -> np.ndarray:
    """For each context and number of bytes before the anchor: whether that window occurs in another context of its class.

    ``before`` holds the bytes before the anchors, read backwards, and ``after`` those from the anchors on.
    """
    n, reach = before.shape
    proven = np.zeros((n, reach + 2), np.int8)  # at most four neighbours
    most = {}
    for name, rows, sizes in (("after", after, n_after), ("before", before, n_before)):
        order = multikey_order(rows, classes, sizes)
        i, j = order[:-1], order[1:]
        same = classes[i] == classes[j]
        i, j = i[same], j[same]
        left, right = _common(before, n_before, i, j), _common(after, n_after, i, j)
        best = most[name] = np.zeros(n, np.int64)
        for rows_of in (i, j):
            np.maximum.at(best, rows_of, right if name == "after" else left)
            good = left + right >= width
            np.add.at(proven, (rows_of[good], np.maximum(width - right[good], 0)), 1)
            np.add.at(proven, (rows_of[good], left[good] + 1), -1)
    proven = proven.cumsum(axis=1, dtype=np.int8)[:, : reach + 1] > 0
    at = np.arange(reach + 1)
    possible = (at >= (width - most["after"])[:, None]) & (at <= most["before"][:, None])
    open_ = possible & ~proven
    for k in np.flatnonzero(open_.any(axis=0)):
        rows = np.flatnonzero(possible[:, k] & np.isin(classes, classes[open_[:, k]]))
        window = np.ascontiguousarray(np.concatenate([classes[rows].astype(np.int64)[:, None].view(np.uint8), before[rows, :k], after[rows, : width - k]], axis=1))
        _, which, times = np.unique(window.view([("", np.void, window.shape[1])]).ravel(), return_inverse=True, return_counts=True)
        proven[rows, k] |= times[which] > 1
    return proven


FOUND = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("spans", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])))])


def _matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), np.array([len(v) for v in values])


def _compared(rows: list[dict], width: int, short: int) -> pa.RecordBatch:
    before, n_before = _matrix([r["before"][::-1] for r in rows], width - short)
    after, n_after = _matrix([r["after"] for r in rows], width)
    _, classes = np.unique([r["key"] for r in rows], return_inverse=True)
    again = np.pad(repeated_windows(classes, before, n_before, after, n_after, width), ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(again, axis=1)
    (row, first), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
    offsets = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32))
    # windows of first to end - 1 bytes before the anchor cover what lies from 1 - end to width - first
    spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (1 - end, width - first)], names=["low", "high"])
    found = pa.RecordBatch.from_arrays([pa.array([r["key"] for r in rows]), pa.array([r["context"] for r in rows]), pa.ListArray.from_arrays(offsets, spans)], schema=FOUND)
    return found.filter(pa.array(again.any(axis=1)))


def compare_bucket(batches: Iterator[pa.RecordBatch], width: int, short: int) -> Iterator[pa.RecordBatch]:
    """Stretches repeated around the anchors of a bucket, which comes sorted by short string; whole groups are compared at once."""
    held, group = [], []
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            for row in batch.slice(k, 1024).to_pylist():
                if group and row["key"] != group[-1]["key"]:
                    held += group
                    group = []
                    if len(held) >= AT_ONCE:
                        yield _compared(held, width, short)
                        held = []
                group.append(row)
    if held or group:
        yield _compared(held + group, width, short)


def _across(far: DataFrame, width: int, short: int, scratch: Scratch) -> DataFrame:
    """key, context, low and high of the windows repeated in groups that no single bucket holds."""
    steps = {"after": [*range(short, width, 24), width], "before": [*range(24, width - short, 24), width - short]}
    part = {"after": lambda n: F.substring("after", 1, n), "before": lambda n: F.substring("before", -n, n)}
    lengths = [F.when(F.octet_length(side) >= n, F.struct(F.lit(side).alias("side"), F.lit(n).alias("n"), F.xxhash64(part[side](n)).alias("hash"))) for side, all_n in steps.items() for n in all_n]
    each = scratch.save(far.select("key", "context", F.explode(F.filter(F.array(*lengths), lambda x: x.isNotNull())).alias("p")).select("key", "context", "p.*"), "lengths")
    twice = scratch.save(each.groupBy("key", "side", "n", "hash").agg(F.count("*").alias("times")).where("times > 1"), "lengths-twice")
    shared = join_heavy(each, twice, ["key", "side", "n", "hash"], "times", each.count())
    most = lambda side: F.max(F.when(F.col("side") == side, F.col("n")))
    bounds = shared.groupBy("key", "context").agg(most("after").alias("to"), F.coalesce(most("before"), F.lit(0)).alias("back"))
    # what is shared ends before the next of the lengths
    beyond = lambda c, all_n: F.coalesce(*[F.when(F.col(c) < n, n - 1) for n in all_n], F.lit(all_n[-1]))
    fewest = F.greatest(F.lit(width) - F.least(beyond("to", steps["after"]), F.octet_length("after")), F.lit(0))
    largest = F.least(beyond("back", steps["before"]), F.octet_length("before"))
    reach = far.join(bounds.where("to is not null"), ["key", "context"]).withColumn("fewest", fewest).withColumn("largest", largest).where("fewest <= largest")
    window = F.xxhash64(F.expr("substring(before, -at, at)"), F.expr(f"substring(after, 1, {width} - at)"))
    windows = reach.withColumn("at", F.explode(F.sequence("fewest", "largest"))).select("key", "context", "at", window.alias("hash"))
    windows = scratch.save(windows, "windows")
    again = scratch.save(windows.groupBy("key", "at", "hash").agg(F.count("*").alias("times")).where("times > 1"), "windows-again")
    found = join_heavy(windows, again, ["key", "at", "hash"], "times", windows.count())
    return found.groupBy("key", "context").agg(F.collect_list(F.struct((-F.col("at")).alias("low"), (F.lit(width) - F.col("at")).alias("high"))).alias("spans"))  # one for each window of a context


def distinct_texts(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """id (md5), copies and data (bytes) of each text, and the name of that table: in buckets by id, so that later joins leave the texts where they are."""
    spark = docs.sparkSession
    rows = docs.select(text_or_empty().cast("binary").alias("data")).select(F.unhex(F.md5("data")).alias("id"), "data")
    name = f"texts_{uuid.uuid4().hex}"
    found = rows.groupBy("id").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    found.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").option("path", scratch.path("texts")).saveAsTable(name)
    return spark.table(name), name


def repeated_spans(texts: DataFrame, width: int, short: int, scratch: Scratch, limit: int = GROUP) -> DataFrame:
    """id, low and high (bytes) of the stretches to remove from the texts that occur once; they may overlap. Other long texts go whole."""

    def scan(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                text, *columns = anchors(part.column("data").to_pylist(), width, short)
                at = pa.array(text)
                rest = [pa.array(c.astype(np.int64)) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("copies").take(at), *rest], names=["id", "copies", "first", "last", "before", "after", "key", "context", "times"])

    schema = "id binary, copies long, first long, last long, before long, after long, key long, context long, times long"
    table = scratch.save(texts.where(F.octet_length("data") >= width).select("id", "copies", "data").mapInArrow(scan, schema), "anchors")
    place = F.struct("id", "first", "before", "after")
    kinds = table.groupBy("key", "context").agg(F.min(place).alias("place"), F.sum(F.col("copies") * F.col("times")).alias("times"), F.count("*").alias("rows"))
    kinds = scratch.save(kinds, "kinds")
    mixed = scratch.save(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select("key", "kinds"), "mixed")
    wanted = scratch.save(join_heavy(kinds.select("key", "context", "place"), mixed, ["key"], "kinds", kinds.count()), "wanted")
    lists = wanted.groupBy("place.id").agg(F.collect_list(F.struct("key", "context", (F.col("kinds") > limit).alias("far"), "place.first", "place.before", "place.after")).alias("cuts"))  # of one text

    def contexts(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, cuts = batch.column("data")[k].as_py(), batch.column("cuts")[k].as_py()
                for m in range(0, len(cuts), 4096):
                    some = cuts[m : m + 4096]
                    columns = [[c["key"] for c in some], [c["context"] for c in some], [c["far"] for c in some], [data[c["first"] - c["before"] : c["first"]] for c in some], [data[c["first"] : c["first"] + c["after"]] for c in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], names=["key", "context", "far", "before", "after"])

    suffixes = texts.select("id", "data").join(lists, "id").mapInArrow(contexts, "key long, context long, far boolean, before binary, after binary")
    dealt = suffixes.where("not far").drop("far").withColumn("lead", F.substring("after", 1, short)).repartitionByRange("lead").sortWithinPartitions("lead", "key").drop("lead")
    near = dealt.mapInArrow(lambda batches: compare_bucket(batches, width, short), "key long, context long, spans array<struct<low:int,high:int>>")
    if not mixed.where(F.col("kinds") > limit).isEmpty():
        near = near.unionByName(_across(scratch.save(suffixes.where("far").drop("far"), "far"), width, short, scratch))
    # a context that occurs several times is repeated whole, whatever else was found about it
    settled = kinds.where("times > 1").select("key", "context", "rows", F.lit(None).cast("array<struct<low:int,high:int>>").alias("spans"))
    single = near.join(kinds.where("times = 1").select("key", "context", "rows"), ["key", "context"]).select("key", "context", "rows", "spans")
    results = scratch.save(settled.unionByName(single), "results")
    for name in ("kinds", "mixed", "wanted", "far", "lengths", "lengths-twice", "windows", "windows-again"):
        scratch.drop(name)
    found = join_heavy(table.where("copies = 1"), results, ["key", "context"], "rows", table.count())
    whole = F.array(F.struct((-F.col("before")).alias("low"), (F.col("last") - F.col("first") + F.col("after")).alias("high")))
    spans = found.select("id", "first", F.explode(F.coalesce(F.col("spans").cast("array<struct<low:bigint,high:bigint>>"), whole)).alias("s"))
    return spans.select("id", (F.col("first") + F.col("s.low")).alias("low"), (F.col("first") + F.col("s.high")).alias("high"))


def _stay(data: bytes, whole: bool, spans: list[dict] | None) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of these, and the bytes that stay."""
    if whole:
        return len(data), 1, b""
    if not spans:
        return 0, 0, data
    gone = np.zeros(len(data) + 2, np.int8)
    for s in spans:
        gone[s["low"] + 1 : s["high"] + 1] = 1
    return int(gone.sum()), int((np.diff(gone) == 1).sum()), np.frombuffer(data, np.uint8)[gone[1:-1] == 0].tobytes()


def cleaned(docs: DataFrame, scratch: Scratch, width: int = WIDTH, short: int = SHORT, digest: bool = False, limit: int = GROUP) -> DataFrame:
    """id, copies, n_bytes, n_removed, n_spans and kept (or, as ``digest``, its sha256) of each distinct text."""
    texts, name = distinct_texts(docs, scratch)
    by_text = repeated_spans(texts, width, short, scratch, limit).distinct().groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans"))  # of one text

    def cut(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                out = []
                for data, copies, spans in zip(*(part.column(c).to_pylist() for c in ("data", "copies", "spans"))):
                    removed, runs, kept = _stay(data, copies > 1 and len(data) >= width, spans)
                    out.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest() if digest else kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("copies"), *columns], names=["id", "copies", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = f"id binary, copies long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}"
    found = scratch.save(texts.join(by_text, "id", "left").select("id", "copies", "data", "spans").mapInArrow(cut, schema), "cleaned")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    for name in ("texts", "anchors", "results"):
        scratch.drop(name)
    return found


def mark(docs: DataFrame, width: int = WIDTH, short: int = SHORT, columns: list[str] | None = None, digest: bool = False, limit: int = GROUP) -> DataFrame:
    """row (the document's columns, or those named), n_bytes, n_removed, n_spans and kept (the bytes that stay, or, as ``digest``, their sha256)."""
    scratch = Scratch(docs.sparkSession, "suffixes")
    found = cleaned(docs, scratch, width, short, digest, limit)
    rows = docs.select(whole_row(docs if columns is None else docs.select(*columns)), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("id"))
    return join_heavy(rows, found, ["id"], "copies", docs.count()).select("row", "n_bytes", "n_removed", "n_spans", "kept")
