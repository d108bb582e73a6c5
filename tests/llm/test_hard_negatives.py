"""Hard negatives against all scores, and their defined results for odd input."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from windloom.llm import hard_negatives as hard

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def by_brute_force(rows, every):
    """All scores of all anchors, from rows (vec_id, vector, label)."""
    valid = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        numbers = [math.floor(256 * float(np.float32(x))) for x in vector]
        valid.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, numbers))
    anchors = {}
    for vec_id, label, numbers in valid:
        if vec_id is not None and vec_id % every == 0:
            anchors[vec_id] = min(anchors.get(vec_id, (label, numbers)), (label, numbers))
    found = []
    for anchor, (label, numbers) in anchors.items():
        scored = [(-sum(a * b for a, b in zip(numbers, v)), i is None, i or 0, i, at == label) for i, at, v in valid if i != anchor]
        for minus, *_, positive, _ in sorted(s for s in scored if s[4])[:5]:
            window = sorted(s for s in scored if not s[4] and 50 * -minus <= 100 * -s[0] <= 95 * -minus)[:3]
            found += [(anchor, positive, k, s[3], -minus, -s[0]) for k, s in enumerate(window, 1)]
    return sorted(found, key=str)


def mine(spark, rows, every=10, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hard.hard_negatives(hard.prepared(table), F.col("vec_id") % every == 0, **options).collect()), key=str)


def vector(rnd, size=8):
    return [rnd.uniform(-1, 1) for _ in range(size)]


def test_all_scores(spark):
    rnd = random.Random(1)
    rows = [(k, vector(rnd), rnd.randrange(3)) for k in range(300)]
    want = by_brute_force(rows, 10)
    assert len(want) > 100
    assert mine(spark, rows) == want
    assert mine(spark, rows, block_size=4) == want


def test_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(k, vector(rnd, rnd.choice([8, 8, 8, 5, 0])), rnd.choice([0, 1, 1, None])) for k in range(120)]
    rows += [(200, None, 1), (201, [float("nan")] * 8, 1), (202, [float("inf")] + [0.0] * 7, 0), (203, [None] * 8, 0), (None, rows[3][1], 1), (None, vector(rnd), 0)]
    rows += [rows[20], rows[20], (30, vector(rnd), 0), rows[41], rows[41]]
    assert mine(spark, rows) == by_brute_force(rows, 10)


def test_one_vector_in_a_third_of_the_rows(spark):
    rnd = random.Random(3)
    hot = vector(rnd)
    rows = [(k, hot if k % 3 else vector(rnd), k % 4) for k in range(400)]
    assert mine(spark, rows) == by_brute_force(rows, 10)


def test_empty_tables(spark):
    rnd = random.Random(4)
    assert mine(spark, []) == []
    assert mine(spark, [(k, vector(rnd), 1) for k in range(1, 9)]) == []
    assert mine(spark, [(10, [], 1), (11, [], 1), (12, [], 2)]) == by_brute_force([(10, [], 1), (11, [], 1), (12, [], 2)], 10)


def test_bounds_leave_most_pairs_of_gathered_anchors_unscored():
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-200, 200, (12, 32)).astype(float)
    anchors = (centres[rnd.integers(0, 12, 240)] + rnd.integers(-1, 2, (240, 32))).astype(float)
    rows = (centres[rnd.integers(0, 12, 500)] + rnd.integers(-40, 41, (500, 32))).astype(float)
    tree, exact = hard.Tree(anchors), anchors @ rows.T
    low = np.sort(exact, axis=1)[:, -5]
    a, r, score = tree.scores(rows, np.ones(exact.shape, bool), low, np.full(240, np.inf))
    assert (score == exact[a, r]).all()
    assert set(zip(*np.nonzero(exact >= low[:, None]))) <= set(zip(a, r))
    assert tree.scored < exact.size / 3


def test_the_tree_is_least():
    rnd = np.random.default_rng(6)
    points = rnd.integers(-9, 9, (40, 3)).astype(float)
    _, length = hard.spanning_tree(points)
    edges = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(40) for j in range(i))
    group, total = list(range(40)), 0
    for size, i, j in edges:
        if group[i] != group[j]:
            total, group = total + size, [group[i] if g == group[j] else g for g in group]
    assert abs(total - length.sum()) < 1e-9
