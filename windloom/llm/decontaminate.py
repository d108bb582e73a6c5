"""Operator 8: benchmark decontamination by suffix arrays of the training text.

Documents are taken in shards of bounded size. A shard's words become numbers (words that no test item of the block holds are
zero: no match can reach across them), and its suffix array lists its positions in the order of the suffixes that start
there. Every test suffix is found in every shard by two binary searches, which bound the positions that agree with it in
``width`` words or more; each such match is then followed to its end. What an item and a document share on one diagonal
becomes one match, reported where it starts: these are the longest verbatim matches with their locations. Covered words
and items of a document follow from its matches, and documents that are covered too much are removed.

A suffix of the shard can only match if a few of its words begin some test suffix, so the others are left out of the
array before it is sorted (``_GRAM`` words looked up in a bit table); this changes no result.

The benchmark comes in blocks of ``block_bytes`` of text at most. A block's text is all that the driver sees; each worker
builds the block's test suffixes for itself. Between two blocks the documents are written with what was found so far and
the block is released, so one block is held at a time, however large the benchmark is. Documents are never shuffled.

Defined results: null and empty texts and items have no words; an item without words is never found; items of fewer
words than ``width`` are one window; repeated item ids and items count once; a null item_id is written ``null``; repeated
documents, and documents of one or no doc_id, each get their own result; very long texts are one shard of their own; an
empty table on either side gives no hits. All document columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_steps, text_or_empty, texts_of, whole_row

#: The words are runs of digits, ASCII letters and everything beyond ASCII; the rest separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SHARD_BYTES = 2 << 20
BLOCK_BYTES = 8 << 20
#: Agreements of test suffixes with positions looked at together, about.
AT_ONCE = 1 << 20
_GRAM = 4
_TOP = 0x7FFFFFFF


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _sortable(windows: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings of the same order."""
    return np.ascontiguousarray(windows.astype(">i4")).view(f"S{4 * windows.shape[1]}").ravel()


class TestSuffixes:
    """All suffixes of a block of benchmark items that are long enough to match."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        self.vocabulary: dict[bytes, int] = {}
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)] for _, t in items]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.cumsum(sizes + 1) - sizes - 1  # items stand one after the other, a number that matches nothing between them
        self.numbers = np.full(int((sizes + 1).sum()) + width, -1, np.int32)
        for a, t in zip(self.first.tolist(), texts):
            self.numbers[a : a + len(t)] = t
        self.need = np.minimum(sizes, width)  # words that make a match
        starts = np.where(sizes > 0, sizes - self.need + 1, 0)
        self.item = np.repeat(np.arange(len(items)), starts)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(starts) - starts, starts) + self.first[self.item]
        self.owner = np.array([number[i] for i, _ in items], np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(self.numbers, width)[self.at] if len(self.at) else np.zeros((0, width), np.int32)
        short = np.arange(width) >= self.need[self.item][:, None]
        self.low, self.high = _sortable(np.where(short, 0, windows)), _sortable(np.where(short, _TOP, windows))
        self.gram = int(min(self.need[sizes > 0].min(), _GRAM)) if len(self.at) else 0
        self.grams = np.zeros(1 << 20, bool)
        if self.gram:
            self.grams[self._code([windows[:, j] for j in range(self.gram)])] = True

    def _code(self, columns) -> np.ndarray:
        code = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            code = (code ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return (code & np.uint64((1 << 20) - 1)).astype(np.int64)

    def suffix_array(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a shard that may match, in suffix order, and the first words of these suffixes."""
        n = len(numbers)
        padded = np.concatenate([numbers, np.zeros(self.width, np.int32)])
        at = np.flatnonzero((numbers > 0) & self.grams[self._code([padded[j : j + n] for j in range(self.gram)])])
        heads = _sortable(np.lib.stride_tricks.sliding_window_view(padded, self.width)[at])
        order = np.argsort(heads, kind="stable")
        return at[order], heads[order]

    def matches(self, numbers: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, word of the item, position in the shard, words) of each longest match."""
        none = (np.zeros(0, np.int64),) * 4
        if not self.gram or not len(numbers):
            return none
        suffixes, heads = self.suffix_array(numbers)
        if not len(suffixes):
            return none
        left, right = np.searchsorted(heads, self.low, "left"), np.searchsorted(heads, self.high, "right")
        many = right - left
        parts = []
        for part in np.split(np.flatnonzero(many), np.flatnonzero(np.diff(np.cumsum(many[many > 0]) // AT_ONCE)) + 1):
            suffix = np.repeat(part, many[part])
            here = suffixes[np.arange(len(suffix)) - np.repeat(np.cumsum(many[part]) - many[part], many[part]) + left[suffix]]
            there, item = self.at[suffix], self.item[suffix]
            before = np.where(here > 0, numbers[here - 1], 0)  # a match that could start one word earlier is part of that one
            begins = (there == self.first[item]) | (before == 0) | (before != self.numbers[there - 1])
            parts.append((item[begins], there[begins], here[begins]))
        item, there, here = (np.concatenate(x) for x in zip(*parts))
        size = self.need[item].copy()
        going = np.arange(len(here))
        while len(going):
            a, b = here[going] + size[going], there[going] + size[going]
            same = numbers[np.minimum(a, len(numbers) - 1)] == self.numbers[b]
            going = going[same & (a < len(numbers))]
            size[going] += 1
        return item, there - self.first[item], here, size


#: The test suffixes of the block in hand, one for each worker process.
_current: dict[str, TestSuffixes] = {}


def _tests(block, width: int) -> TestSuffixes:
    if block.id not in _current:
        _current.clear()
        _current[block.id] = TestSuffixes(block.items.value, width)
    return _current[block.id]


class Block:
    """A broadcast part of the benchmark."""

    def __init__(self, spark, items: list[tuple[str, str]]):
        self.items = spark.sparkContext.broadcast(items)
        self.id = f"{spark.sparkContext.applicationId}-{self.items._jbroadcast.id()}"


def blocks(benchmark: DataFrame, block_bytes: int):
    """The parts of the benchmark, one after the other; each holds about block_bytes of text at most."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), text_or_empty().alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        yield Block(benchmark.sparkSession, [tuple(r) for r in part]), k == n - 1


def _shards(texts: pa.Array, tests: TestSuffixes):
    """(first row, words of each row, start of each row, matches) for each shard of an Arrow array of texts."""
    get = tests.vocabulary.get
    for a, z in byte_steps(texts, SHARD_BYTES):
        words = [words_of(t) for t in texts.slice(a, z - a).to_pylist()]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes - 1  # a zero between documents
        numbers = np.zeros(int((sizes + 1).sum()), np.int32)
        for s, w in zip(starts.tolist(), words):
            numbers[s : s + len(w)] = [get(x, 0) for x in w]
        yield a, sizes, starts, tests.matches(numbers)


def _covered(spans: list[list[int]]) -> list[int]:
    """Ascending, disjoint (start, end) pairs, flat."""
    out: list[int] = []
    for a, z in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def mark(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (the document as it came), n_words, spans (covered words as flat start, end pairs) and items (distinct ids)."""
    rows = docs.select(whole_row(docs), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("spans"), F.array().cast("array<string>").alias("items"))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    for k, (block, last) in enumerate(blocks(benchmark, block_bytes)):

        def run(batches, block=block):
            tests = _tests(block, width)
            for batch in batches:
                for a, sizes, starts, (item, _, here, size) in _shards(texts_of(batch.column(0)), tests):
                    part = batch.slice(a, len(sizes))
                    spans, items = part.column(2).to_pylist(), part.column(3).to_pylist()
                    found: dict[int, list[tuple[int, int, int]]] = {}
                    doc = np.searchsorted(starts, here, "right") - 1
                    for d, i, p, n in zip(doc.tolist(), tests.owner[item].tolist(), (here - starts[doc]).tolist(), size.tolist()):
                        found.setdefault(d, []).append((p, p + n, i))
                    for d, new in found.items():
                        spans[d] = _covered([*zip(spans[d][::2], spans[d][1::2]), *((p, z) for p, z, _ in new)])
                        items[d] = sorted({*items[d], *(tests.ids[i] for _, _, i in new)})
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row", "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, rows.schema)
        if not last:
            rows = scratch.save(rows, f"block-{k}")
            if k:
                scratch.drop(f"block-{k - 1}")
            block.items.destroy()
    return rows


def contamination(marked: DataFrame, share: int = 20) -> DataFrame:
    """Add n_hit, n_items, items_sha256 and contaminated: at least one word in ``share`` is hit."""
    sums = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("sign")), lambda s, x: F.struct((s["n"] + s["sign"] * x).alias("n"), (-s["sign"]).alias("sign")))["n"]
    out = marked.withColumn("n_hit", sums).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("items_sha256", F.sha2(F.array_join(F.array_sort("items"), ","), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The documents that aren't contaminated, as they came."""
    return contamination(mark(docs, benchmark, width), share).where(~F.col("contaminated")).select("row.*")


def longest_matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each longest verbatim match: doc_id, item_id, doc_word, item_word (from 0) and n_words."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    scratch = Scratch(spark, "matches")
    out = None
    for k, (block, last) in enumerate(blocks(benchmark, block_bytes)):

        def run(batches, block=block):
            tests = _tests(block, width)
            for batch in batches:
                for a, _, starts, (item, there, here, size) in _shards(batch.column(1), tests):
                    doc = np.searchsorted(starts, here, "right") - 1
                    names = pa.array(tests.ids, pa.string()).take(pa.array(tests.owner[item]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(a + doc)), names, pa.array(here - starts[doc]), pa.array(there), pa.array(size)], names=["doc_id", "item_id", "doc_word", "item_word", "n_words"])

        found = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id string, doc_word long, item_word long, n_words long")
        if not last:
            found = scratch.save(found, f"block-{k}")
            block.items.destroy()
        out = found if out is None else out.unionByName(found)
    return out
