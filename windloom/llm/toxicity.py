"""Operator 6: toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j): the pairs let two terms count together, which
additive weights miss. A word's terms are the word and its beginnings of PREFIXES letters, so that a stem counts with any
ending. Every term is hashed into one of 2**HASH_BITS slots, and every slot has a weight and factors. A term's value is
the logarithm of its count, times how surely its document frequency differs between the classes (``reliance``, between 0
and 1), so that common and rare words alike stay in the model but don't drown the others.

The model is fitted on at most ``max_rows`` labelled rows (see ``labelled``), half of them at most of either label, as one
may be rare; they are gathered as sparse rows. Every document is then scored where it lies, without a shuffle.

Defined results: a null, empty or wordless text is scored from the model's constant alone; very long texts count whole;
repeated rows score alike; contradicting labels of one doc_id don't count; without labelled rows of both classes every
score is the share of label 1 among them (0 without any label); an empty table gives an empty one; a null doc_id is held out; all
document columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_steps, texts_of, whole_row
from .decontaminate import WORD_BYTES
from .labelled import held_out, training_rows

HASH_BITS = 18
FACTORS = 6
PREFIXES = (4, 5, 6, 7)
#: Labelled rows that the model sees at most; their sparse rows are what the driver holds.
MAX_ROWS = 2_500
#: Words kept in a worker's memory, each of 64 bytes at most, and text scored at once.
MEMORY, STEP_BYTES = 120_000, 1 << 19


def slots_of(word: bytes) -> list[int]:
    """The slots of a word's terms, -1 where it is too short for a beginning."""
    letters = word.decode()
    terms = [word, *(b"^" + letters[:n].encode() if len(letters) >= n else None for n in PREFIXES)]
    return [zlib.crc32(t) & ((1 << HASH_BITS) - 1) if t is not None else -1 for t in terms]


class Terms:
    """Texts -> sparse counts of slots; remembers a bounded number of words."""

    def __init__(self):
        self.rows: dict[bytes, list[int]] = {}

    def _slots(self, words: list[bytes]) -> np.ndarray:
        if len(self.rows) > MEMORY:
            self.rows.clear()
        out = []
        for w in words:
            found = self.rows.get(w)
            if found is None:
                found = slots_of(w) if w else [-1] * (1 + len(PREFIXES))
                if len(w) <= 64:
                    self.rows[w] = found
            out.append(found)
        return np.array(out, np.int64).reshape(len(words), 1 + len(PREFIXES))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each text and the end, slot, count); a text's slots ascend."""
        n = len(texts)
        raw = [t.translate(WORD_BYTES) for t in texts.cast(pa.binary()).to_pylist()]
        lists = pc.ascii_split_whitespace(pa.array(raw, pa.binary()).cast(pa.string()))
        words = lists.flatten().dictionary_encode()
        slots = self._slots([w.encode() for w in words.dictionary.to_pylist()])[words.indices.to_numpy()]
        text = np.repeat(np.arange(n, dtype=np.int64), pc.list_value_length(lists).to_numpy())
        keys = (text[:, None] << HASH_BITS | slots)[slots >= 0]
        keys, count = np.unique(keys, return_counts=True)
        return np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << HASH_BITS), keys & ((1 << HASH_BITS) - 1), count


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the stretches first[k] : first[k + 1], which may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


class FactorizationMachine:
    """Weights and factors of all slots; rows come as (first, slot, count)."""

    def __init__(self, w0: float, reliance: np.ndarray | None = None, w: np.ndarray | None = None, v: np.ndarray | None = None):
        self.w0, self.reliance, self.w, self.v = w0, reliance, w, v

    def _forward(self, first, slot, x) -> tuple[np.ndarray, np.ndarray]:
        xv = x[:, None] * self.v[slot]
        s = _sums(xv, first)
        return self.w0 + _sums(x * self.w[slot], first) + 0.5 * (s * s - _sums(xv * xv, first)).sum(axis=1), s

    def score(self, first, slot, count) -> np.ndarray:
        if self.w is None:
            return np.full(len(first) - 1, 1 / (1 + np.exp(-self.w0)))
        margin, _ = self._forward(first, slot, self.values(slot, count))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def values(self, slot: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log1p(count, dtype=np.float32) * self.reliance[slot]

    @classmethod
    def fit(cls, first, slot, count, y, epochs: int = 6, batch: int = 128, rate: float = 0.15, decay: float = 1e-5, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, d = len(y), 1 << HASH_BITS
        share = float(y.mean()) if n else 0.0
        if not 0 < share < 1:
            return cls(float(np.log((share + 1e-9) / (1 - share + 1e-9))))
        m = cls(float(np.log(share / (1 - share))), reliance(slot, np.repeat(y > 0, np.diff(first)), n, int(y.sum())), np.zeros(d, np.float32), rng.normal(0, 0.02, (d, FACTORS)).astype(np.float32))
        x = m.values(slot, count)
        g0, gw, gv = 1e-6, np.full(d, 1e-6, np.float32), np.full((d, FACTORS), 1e-6, np.float32)
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                rows = order[a : a + batch]
                sizes = first[rows + 1] - first[rows]
                begin = np.concatenate([[0], np.cumsum(sizes)])
                at = np.arange(begin[-1]) + np.repeat(first[rows] - begin[:-1], sizes)
                s_, x_ = slot[at], x[at]
                margin, s = m._forward(begin, s_, x_)
                e = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
                ex, owner = np.repeat(e, sizes) * x_, np.repeat(np.arange(len(rows)), sizes)
                used, place = np.unique(s_, return_inverse=True)
                dw = np.bincount(place, ex, len(used)) + decay * m.w[used]
                dv = np.stack([np.bincount(place, ex * (s[owner, f] - x_ * m.v[s_, f]), len(used)) for f in range(FACTORS)], axis=1) + decay * m.v[used]
                d0 = float(e.sum())
                g0 += d0 * d0
                gw[used] += dw * dw
                gv[used] += dv * dv
                m.w0 -= rate * d0 / g0**0.5
                m.w[used] -= rate * dw / np.sqrt(gw[used])
                m.v[used] -= rate * dv / np.sqrt(gv[used])
        return m


def reliance(slot: np.ndarray, label: np.ndarray, n: int, ones: int) -> np.ndarray:
    """How surely each slot's document frequency differs between the classes: z * z / (z * z + 30) of the usual z value."""
    d = 1 << HASH_BITS
    df, df1 = np.bincount(slot, minlength=d), np.bincount(slot[label], minlength=d)
    p = df / n
    z = (df1 / ones - (df - df1) / (n - ones)) / np.sqrt(p * (1 - p) * (1 / ones + 1 / (n - ones)) + 1e-12)
    return (z * z / (z * z + 30)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> FactorizationMachine:
    """The model of at most max_rows labelled rows, both labels alike."""

    def sparse(batches):
        terms = Terms()
        for batch in batches:
            for a, z in byte_steps(batch.column(0), STEP_BYTES):
                first, slot, count = terms.counts(batch.column(0).slice(a, z - a))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(c, pa.int32())) for c in (slot, count)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, z - a), batch.column(2).slice(a, z - a), *lists], names=["label", "key", "slots", "counts"])

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()  # the same rows give the same model
        slots, counts = rows["slots"].combine_chunks(), rows["counts"].combine_chunks()
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(slots).to_numpy(zero_copy_only=False))]).astype(np.int64)
        model = FactorizationMachine.fit(first, slots.flatten().to_numpy(), counts.flatten().to_numpy(), rows["label"].to_numpy().astype(np.float64))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = training_rows(docs, labels, "toxic", max_rows, balanced=True).select("text", "label", F.xxhash64("text").alias("key"))
    saved = scratch.save(texts.mapInArrow(sparse, "label int, key long, slots array<int>, counts array<int>"), "rows")
    found = saved.groupBy().applyInArrow(learn, "model binary").collect()  # max_rows at most, in one task, so that the driver holds the model only
    scratch.drop("rows")
    return pickle.loads(found[0]["model"]) if found else FactorizationMachine.fit(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """row (the document as it came) and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))  # 2**HASH_BITS x (FACTORS + 2) numbers

    def run(batches):
        terms = Terms()
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, z in byte_steps(texts, STEP_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(model.value.score(*terms.counts(texts.slice(a, z - a))))], names=["row", "score"])

    rows = docs.select(whole_row(docs))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score_toxicity(docs.select("doc_id", "text"), labels).select("row.doc_id", "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (rows["score"] >= 0.5).cast("int").alias("predicted"))
