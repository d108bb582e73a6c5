"""Operator 10: quality by a regularised quadratic discriminant over document statistics.

Each class has its own mean and covariance of transformed statistics; a covariance is shrunk towards the pooled one and
then towards its own diagonal. A score is the logistic of the difference between the class log densities (half the
squared Mahalanobis distance and log determinant) plus the log odds of the classes, from Cholesky factors computed once.

Moments come from at most ``max_rows`` labelled rows (see ``labelled``): each task adds up its rows' sums and outer
products, and only those sums are gathered. Every document is scored where it lies.

Defined results: a null or empty text has the statistics of a text without words and is scored like any other; very long
texts count whole; repeated rows score alike; contradicting labels of one doc_id don't count; without two rows of each
class every score is the share of label 1 (0 without labels); an empty table gives an empty one; a null doc_id is held
out; all document columns pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_steps, texts_of, whole_row
from .labelled import MAX_LABELLED, held_out, training_rows

SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*@^~=+<>{}[]\\_/"
_STOPS = b".,;:"
STATISTICS = 12


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text; rates enter as square roots, counts and lengths as logarithms."""
    raw = text.encode()
    words = raw.split()
    n, size = len(words), len(raw)
    lines = [x for x in raw.split(b"\n") if x.strip()]

    def rate(chars: bytes, by: int) -> float:
        return ((size - len(raw.translate(None, chars))) / max(1, by)) ** 0.5

    distinct = len(set(words))
    return [
        np.log1p(n),
        np.log1p(size / max(1, n)),
        rate(_UPPER, size),
        rate(_DIGITS, size),
        rate(b"!?", n),
        rate(_SYMBOLS, n),
        rate(b"|", n),
        rate(_STOPS, n),
        rate(b"\n", n),
        (1 - len(set(lines)) / max(1, len(lines))) ** 0.5,
        np.log1p(distinct) / max(1.0, np.log1p(n)),
        rate(b"\"'()-", n),
    ]


def features(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), STATISTICS)


class QuadraticDiscriminant:
    """Class moments -> scores. ``moments``: for each class (rows, sum of x, sum of x x')."""

    def __init__(self, moments):
        (n0, _, _), (n1, _, _) = moments
        self.share = n1 / (n0 + n1) if n0 + n1 else 0.0
        self.parts = None
        if min(n0, n1) < 2:
            return
        means = [s / n for n, s, _ in moments]
        scatters = [ss - n * np.outer(m, m) for (n, _, ss), m in zip(moments, means)]
        pooled = sum(scatters) / (n0 + n1 - 2)
        self.parts = []
        for (n, _, _), mean, scatter in zip(moments, means, scatters):
            own = (1 - SHRINK_POOLED) * scatter / (n - 1) + SHRINK_POOLED * pooled
            own = (1 - SHRINK_DIAGONAL) * own + SHRINK_DIAGONAL * np.diag(np.diag(own)) + RIDGE * np.eye(STATISTICS)
            factor = np.linalg.cholesky(own)
            self.parts.append((mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / (n0 + n1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.share)
        density = [prior - 0.5 * (log_det + (((x - mean) @ inverse.T) ** 2).sum(axis=1)) for mean, inverse, log_det, prior in self.parts]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> QuadraticDiscriminant:
    def sums(batches):
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            x = features(batch.column(0).to_pylist())
            rows = [(k, float((y == k).sum()), x[y == k].sum(axis=0).tolist(), (x[y == k].T @ x[y == k]).ravel().tolist()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names=["label", "n", "s", "ss"])

    parts = training_rows(docs, labels, "quality", max_rows).mapInArrow(sums, "label int, n double, s array<double>, ss array<double>")
    one = lambda name, size: F.array(*[F.sum(F.col(name)[i]) for i in range(size)]).alias(name)
    total = {r["label"]: r for r in parts.groupBy("label").agg(F.sum("n").alias("n"), one("s", STATISTICS), one("ss", STATISTICS**2)).collect()}
    none = (0.0, np.zeros(STATISTICS), np.zeros((STATISTICS, STATISTICS)))
    return QuadraticDiscriminant([(total[k]["n"], np.array(total[k]["s"]), np.array(total[k]["ss"]).reshape(STATISTICS, STATISTICS)) if k in total else none for k in (0, 1)])


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """row (the document as it came) and score."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))  # two means and factors

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, z in byte_steps(texts, 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(model.value.score(features(texts.slice(a, z - a).to_pylist())))], names=["row", "score"])

    rows = docs.select(whole_row(docs))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score_quality(docs.select("doc_id", "text"), labels).select("row.doc_id", "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
