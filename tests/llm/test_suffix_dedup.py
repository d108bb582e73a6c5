"""Repeated byte strings against all windows, and their defined results for odd input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from windloom.llm import queries
from windloom.llm import suffix_dedup as suffix


def by_brute_force(texts, width):
    """(bytes, removed, spans, kept) of each text."""
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    found = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if times[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        found.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return found


def made_texts(seed):
    """Passages in other surroundings, cut passages, copies, short periods, empty, null and long texts."""
    rnd = random.Random(seed)
    letters = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [letters(rnd.randrange(15, 60)) for _ in range(12)]
    texts = []
    for _ in range(120):
        text = "".join(rnd.choice([letters(rnd.randrange(1, 30)), rnd.choice(passages), rnd.choice(passages)]) for _ in range(rnd.randrange(1, 8)))
        if rnd.random() < 0.3:
            passage = rnd.choice(passages)
            text += passage[rnd.randrange(len(passage)) :] + rnd.choice(passages)[: rnd.randrange(30)]
        texts.append(text)
    return texts + [texts[3]] * 4 + [None, "", "a", "a" * 500, "ab" * 300, "a" * 70, texts[5] + "x", " " + texts[6], letters(4000), "\0" * 30, "\0" * 31 + "b"]


def removed(spark, texts, width, short, ids=None, **options):
    table = spark.createDataFrame([(i, t, "x", 7, k) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))], "doc_id long, text string, id string, n_bytes int, place int")
    rows = suffix.mark(table, width, short, **options).collect()
    found = {r["row"]["place"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}
    assert len(rows) == len(found)
    assert all(r["row"]["id"] == "x" and r["row"]["n_bytes"] == 7 for r in rows)
    return [found[k] for k in range(len(texts))]


@pytest.mark.parametrize(("seed", "width", "short", "limit"), [(1, 20, 6, 8192), (2, 20, 6, 4), (3, 33, 8, 8192)])
def test_all_windows(spark, seed, width, short, limit):
    texts = made_texts(seed)
    want = by_brute_force(texts, width)
    assert sum(w[1] for w in want) > 5000
    assert removed(spark, texts, width, short, limit=limit) == want


def test_copies_with_one_id_or_none(spark):
    texts = ["passage " * 9 + "own"] * 200 + ["other " * 10, None, "passage " * 4]
    assert removed(spark, texts, 24, 6, ids=[None if k % 3 else 5 for k in range(len(texts))]) == by_brute_force(texts, 24)


def test_empty_table(spark):
    assert removed(spark, [], 20, 6) == []


def test_digest(spark):
    texts = made_texts(4)[:60]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix.mark(table, 20, 6, columns=["doc_id"], digest=True).collect()
    assert {r["row"]["doc_id"]: r["kept"] for r in rows} == {k: hashlib.sha256(w[3]).hexdigest() for k, w in enumerate(by_brute_force(texts, 20))}


def test_query_judges_passages_by_their_bytes(spark, tmp_path):
    """Over 50 words shared by two documents go from both at 400 bytes and stay in both at 399; n_bytes is the input's length either way."""
    rnd = random.Random(8)
    words = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(80))
    texts = [words(), words()]
    for n in (399, 400):
        passage = words()[:n]
        assert len(passage.split()) > 50
        texts += [f"{words()}{blank}{passage}{blank}{words()}" for blank in " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op13_suffix_array_dedup(spark, str(tmp_path)).collect())
    assert [(r.n_removed, r.n_spans) for r in rows] == [(0, 0)] * 4 + [(400, 1)] * 2
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == [(k, *w[:3], hashlib.sha256(w[3]).hexdigest()) for k, w in enumerate(by_brute_force(texts, 400))]
    assert [r.n_bytes for r in rows] == [len(t) for t in texts]


def test_anchors_do_not_depend_on_the_pieces():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abc") for _ in range(n)).encode() for n in (5000, 30, 700, 0, 20_000)] + [b"ab" * 3000]
    every = lambda size: {row[:2] for row in zip(*(c.tolist() for c in suffix.anchors(texts, 40, 8, size)))}
    pieces, whole = every(900), every(1 << 20)
    ends = lambda rows: {r for r in rows if r[0] < 5}
    assert ends(pieces) == ends(whole)
    for text in range(5):
        places = sorted(p for t, p in ends(whole) if t == text)
        windows = range(len(texts[text]) - 39)
        assert all(any(i <= p <= i + 32 for p in places) for i in windows)


def test_multikey_order():
    rnd = np.random.default_rng(6)
    rows, classes = rnd.integers(0, 2, (400, 19)).astype(np.uint8), rnd.integers(0, 3, 400)
    rows[100:200] = rows[0:100]
    sizes = rnd.integers(0, 20, 400)
    order = suffix.multikey_order(rows, classes, sizes)
    keys = [(int(classes[k]), rows[k].tobytes(), int(sizes[k])) for k in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(400))


def test_windows_that_no_neighbour_proves():
    """The partner on the left differs from the one with the longest match on the right."""
    rnd = random.Random(7)
    for _ in range(30):
        parts = [bytes(rnd.choice(b"ab") for _ in range(6)) for _ in range(4)]
        contexts = [(rnd.choice(parts)[: rnd.randrange(7)], rnd.choice(parts) + rnd.choice(parts)) for _ in range(25)]
        contexts = sorted(set(contexts))
        before, n_before = suffix._matrix([b for b, _ in contexts], 6)
        after, n_after = suffix._matrix([a for _, a in contexts], 12)
        got = suffix.repeated_windows(np.zeros(len(contexts), int), before, n_before, after, n_after, 10)
        for k, (b, a) in enumerate(contexts):
            for at in range(7):
                full = at <= len(b) and 10 - at <= len(a)
                want = full and any((b[:at], a[: 10 - at]) == (c[:at], d[: 10 - at]) and len(c) >= at for c, d in contexts[:k] + contexts[k + 1 :])
                assert got[k, at] == want

