"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors of a block are joined by their least spanning tree. A row's score with the root is worked out; its score with any other
anchor differs from that with the anchor's parent by the edge's length times the row's norm at most (Cauchy and Schwarz), so
the parent's score, or its own bounds, bound the child's. Only rows whose bounds meet the window an anchor still looks for
are scored, and their scores bound the next anchors in turn.

Rows stay where they are: each task passes its rows by once for a block of anchors, keeps the best few of each anchor, and
those meet by a window over (anchor, rank). A block holds about ``BLOCK`` anchors, which is all that is ever gathered or sent
to the tasks; work is anchors times rows, as every anchor is compared with all rows.

Defined results: rows without label or vector, or with a null or non-finite component, take no part; a null vec_id is no anchor
and comes last among ties; shorter vectors count as filled up with zeros; of several rows of an anchor's vec_id the one of the
least label and vector is the anchor, and none of the others is among its positives or negatives; other repeated rows count as
often as they occur; scores are exact up to 2^53; an empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Anchors of a block, and cells (anchors times rows) worked on at once in a task.
BLOCK, CELLS = 8192, 1 << 21
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LOWEST, HIGHEST = 50, 95
#: Share of a level's pairs from which all its pairs are scored at once, which is faster than picking.
DENSE = 0.25
#: Bounds are widened by this share, far more than rounding can amount to.
WIDER = 1 + 1e-9
NO_ID = np.iinfo(np.int64).max


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector of whole numbers, of the rows that take part."""
    infinite = float("inf")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), vector.alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("vector", lambda x: F.floor(x * 256).cast("double")).alias("vector"))


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (of the root: -1) and length of the edge to it, of each vector in the least spanning tree from vector 0."""
    n = len(vectors)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    parent, length, open_ = np.full(n, -1), np.full(n, np.inf), np.ones(n, bool)
    at, length[0] = 0, 0
    for _ in range(n - 1):
        open_[at] = False
        away = np.maximum(squares + squares[at] - 2 * (vectors @ vectors[at]), 0)
        nearer = open_ & (away < length)
        parent[nearer], length[nearer] = at, away[nearer]
        at = int(np.where(open_, length, np.inf).argmin())
    return parent, np.sqrt(length)


class Tree:
    """Anchors by levels of their spanning tree."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.parent, length = spanning_tree(vectors) if len(vectors) else (np.zeros(0, int), np.zeros(0))
        self.length = length * WIDER
        depth = np.full(len(vectors), -1)
        self.levels, found = [], np.flatnonzero(self.parent < 0)
        while len(found):
            depth[found] = len(self.levels)
            self.levels.append(found)
            found = np.flatnonzero((depth < 0) & (depth[np.maximum(self.parent, 0)] == len(self.levels) - 1))
        self.scored = 0

    def scores(self, rows: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all wanted pairs whose score can lie from low to high of the anchor."""
        norms = np.sqrt(np.einsum("ij,ij->i", rows, rows)) * WIDER
        centre, slack = np.empty((len(self.vectors), len(rows))), np.empty((len(self.vectors), len(rows)))
        pairs = []
        for level, anchors in enumerate(self.levels):
            if level == 0:
                need = np.ones((len(anchors), len(rows)), bool)
            else:
                up = self.parent[anchors]
                middle, room = centre[up], slack[up] + self.length[anchors, None] * norms
                need = wanted[anchors] & (middle + room >= low[anchors, None]) & (middle - room <= high[anchors, None])
                centre[anchors], slack[anchors] = middle, room
            if need.mean() > DENSE:
                centre[anchors], slack[anchors] = self.vectors[anchors] @ rows.T, 0
                self.scored += need.size
                a, r = np.nonzero(need & wanted[anchors])
                a = anchors[a]
            else:
                a, r = np.nonzero(need)
                a = anchors[a]
                for k in range(0, len(a), 1 << 16):
                    i, j = a[k : k + (1 << 16)], r[k : k + (1 << 16)]
                    centre[i, j] = np.einsum("ij,ij->i", self.vectors[i], rows[j])
                slack[a, r] = 0
                self.scored += len(a)
            pairs.append((a, r, centre[a, r]))
        return tuple(np.concatenate(part) for part in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


class Best:
    """The best few (score, id) of each slot so far."""

    def __init__(self, slots: int, size: int):
        self.size, self.least = size, np.full(slots, -np.inf)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least[slot]
        slot, score, ids = (np.concatenate([old, new[good]]) for old, new in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.size
        last = place == self.size - 1
        self.least[slot[last]] = score[last]
        self.slot, self.score, self.id = slot[keep], score[keep], ids[keep]

    def batch(self) -> pa.RecordBatch:
        ids = pa.array(self.id, mask=self.id == NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(self.slot), ids, pa.array(self.score.astype(np.int64))], names=["slot", "vec_id", "score"])


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of equal length, filled up with zeros; what lies beyond ``width`` meets zeros only."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    width = int(sizes.max(initial=0)) if width is None else width
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    filled = np.zeros((len(sizes), width))
    row, column = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = column < width
    filled[row[inside], column[inside]] = values[inside]
    return filled


def _rows(batches: Iterator[pa.RecordBatch], width: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and vectors, ``size`` rows at most at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            part = batch.slice(k, size)
            ids = part.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield ids, part.column("label").to_numpy(zero_copy_only=False), _matrix(part.column("vector"), width)


def positives_of(batches: Iterator[pa.RecordBatch], tree: Tree, ids: np.ndarray, labels: np.ndarray) -> Best:
    """The best rows of the same label of each anchor, among these rows."""
    best = Best(len(ids), POSITIVES)
    high = np.full(len(ids), np.inf)
    for row_ids, row_labels, vectors in _rows(batches, tree.vectors.shape[1], max(1, CELLS // max(1, len(ids)))):
        wanted = (labels[:, None] == row_labels) & (ids[:, None] != row_ids)
        a, r, score = tree.scores(vectors, wanted, best.least, high)
        best.add(a, score, row_ids[r])
    return best


def negatives_of(batches: Iterator[pa.RecordBatch], tree: Tree, ids: np.ndarray, labels: np.ndarray, positive: np.ndarray) -> Best:
    """The best rows of other labels inside the window of each anchor's positive (anchors by POSITIVES scores, none: NaN), among these rows."""
    best = Best(positive.size, NEGATIVES)
    lowest, highest = np.ceil(LOWEST * positive / 100), np.floor(HIGHEST * positive / 100)
    high = np.where(np.isnan(highest), -np.inf, highest).max(axis=1, initial=-np.inf)
    for row_ids, row_labels, vectors in _rows(batches, tree.vectors.shape[1], max(1, CELLS // max(1, len(ids)))):
        wanted = (labels[:, None] != row_labels) & (ids[:, None] != row_ids)
        open_ = np.maximum(np.where(np.isnan(lowest), np.inf, lowest), best.least.reshape(positive.shape))
        a, r, score = tree.scores(vectors, wanted, open_.min(axis=1, initial=np.inf), high)
        for k in range(positive.shape[1]):
            inside = (100 * score >= LOWEST * positive[a, k]) & (100 * score <= HIGHEST * positive[a, k])
            best.add(a[inside] * positive.shape[1] + k, score[inside], row_ids[r[inside]])
    return best


def _merged(found: DataFrame, size: int) -> DataFrame:
    """The best rows of each slot over all tasks, ranked from 1."""
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


FOUND = "slot long, vec_id long, score long"


def _mine_block(rows: DataFrame, block: pa.Table) -> DataFrame:
    """All results of one block of anchors (vec_id, label, vector)."""
    spark = rows.sparkSession
    ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
    tree = Tree(_matrix(block.column("vector")))
    shared = spark.sparkContext.broadcast((tree, ids, labels))

    def best_positives(batches):
        yield positives_of(batches, *shared.value).batch()

    positives = _merged(rows.mapInArrow(best_positives, FOUND), POSITIVES).toArrow()  # a few for each anchor of the block
    slot, place = positives.column("slot").to_numpy(), positives.column("rank").to_numpy() - 1
    scores = np.full((len(ids), POSITIVES), np.nan)
    scores[slot, place] = positives.column("score").to_numpy()
    windows = spark.sparkContext.broadcast(scores)

    def best_negatives(batches):
        yield negatives_of(batches, *shared.value, windows.value).batch()

    named = pa.table({"slot": slot * POSITIVES + place, "anchor_id": ids[slot], "positive_id": positives.column("vec_id"), "positive_score": positives.column("score")})
    found = _merged(rows.mapInArrow(best_negatives, FOUND), NEGATIVES)
    return found.join(F.broadcast(spark.createDataFrame(named)), "slot").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, is_anchor: Column, block_size: int = BLOCK) -> DataFrame:
    """The hardest negatives of each anchor and each of its positives. ``rows`` as ``prepared`` gives them."""
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("least"))
    count = rows.where(is_anchor).select("vec_id").distinct().count()
    blocks = -(-count // block_size)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows.sparkSession.createDataFrame([], schema).write.parquet(scratch.path("found"))
    if blocks:
        dealt = anchors.select("vec_id", "least.label", "least.vector", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))
        dealt.write.partitionBy("block").parquet(scratch.path("anchors"))
        saved = rows.sparkSession.read.parquet(scratch.path("anchors"))
        for block in range(blocks):
            part = saved.where(F.col("block") == block).select("vec_id", "label", "vector").toArrow()
            if len(part):
                _mine_block(rows, part).write.mode("append").parquet(scratch.path("found"))
    return rows.sparkSession.read.schema(schema).parquet(scratch.path("found"))
