"""The corpus operators against brute-force versions, and their defined results for odd input."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from windloom.llm import chroma, decontaminate, encoding, html_extract, license_scan, orc_output, packing, quality, queries, simhash, substring_dedup, toxicity
from windloom.llm.common import Scratch
from windloom.llm.components import components

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
_LOWER = {c: c + 32 for c in range(65, 91)}


def documents(spark, texts, ids=None):
    """Rows of documents, with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", len(t) if t is not None else None, -1, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS + ", n_words int, score string")


def space_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOWER))


def made_texts(seed=1):
    """Copies, near copies, shared passages, repeated lines, empty, null and long texts."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(90)]
    texts = []
    for k in range(40):
        own = [rnd.choice(words) for _ in range(rnd.randrange(5, 160))]
        if k % 4 == 0:
            own[3:3] = passage[k % 7 : 60 + k % 20]
        texts.append(" ".join(own))
    texts += [texts[0], texts[0], texts[5] + " w1", "", None, "a", "  ", "same " * 300, "same " * 200, " ".join(passage), " ".join(rnd.choice(words) for _ in range(5000))]
    return texts


# encoding, 1 and 9

ODD_TEXTS = ["", " ", "\n", "a  b", "Straße über Köln", "don't  stop 's", "x|y | z", "\tt\ra", "<|endoftext|> it", "naïve é", "日本語 text", "A,b.C!!", "trailing ", "\nlead\n\nx", "İstanbul ΣΑΣ", "a b", "1234 56a"]


LETTERS = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
SPECIAL = ["a <|endoftext|> b", "x<|endoftext|>", "<|startoftext|>a.", "<|ENDOFTEXT|>", "abİ, y", "\u0130. \u0130", "क़, क़"]


def ids_of(path, texts, limit=encoding.CACHE_WORDS, enc=None):
    ids, ends = (enc or encoding.WordEncoder(path, limit)).encode(pa.array([t or "" for t in texts], pa.string()))
    return [x.tolist() for x in np.split(ids, ends[:-1])] if texts else []


_TOKENIZERS = {path: Tokenizer.from_file(path) for path in (BYTE, WORD)}


def whole_ids(path, texts):
    """The library itself, as its file comes."""
    return [e.ids for e in _TOKENIZERS[path].encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_encode_as_the_whole_text(path):
    enc = encoding.WordEncoder(path, limit=50)
    marked = [f"x ab{c}{m} y {c}{m}z" for c in LETTERS for m in ".,;:!?$%&*#'\u0301"]
    for texts in (ODD_TEXTS, made_texts(), ODD_TEXTS[::-1], SPECIAL, marked):
        assert ids_of(path, texts, enc=enc) == whole_ids(path, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é,.|'\n\t ß1%\u0301İ<>endoftx", max_size=30), max_size=5))
def test_any_text_encodes_as_a_whole(texts):
    for path in (BYTE, WORD):
        assert ids_of(path, texts, enc=encoding.encoder(path)) == whole_ids(path, texts)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    texts = made_texts()
    rows = packing.pack_documents(documents(spark, texts), BYTE, 256, keep_ids=True).collect()
    want = {i: np.array(ids + [0], "<u4") for i, ids in enumerate(whole_ids(BYTE, texts))}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32 and list(ids) == r.token_ids
        assert r.length == 256 or r.piece == 0
    total = sum(map(len, want.values()))
    assert sum(r.length for r in rows) == total
    assert check_packing(rows, 256) <= -(-total // 256) + 1
    assert sum(len(r.token_ids) for r in packing.sequences(packing.pack_documents(documents(spark, texts), BYTE, 256, keep_ids=True)).collect()) == total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_two_fit_is_a_packing(lengths):
    sequence, offset = packing.best_two_fit(np.array(lengths, np.int64), 50)
    n = check_packing([{"sequence_id": s, "offset": o, "length": x} for s, o, x in zip(sequence, offset, lengths)], 50)
    assert n <= 1.5 * -(-sum(lengths) // 50) + 1


def test_two_documents_replace_the_smallest():
    # greedy: 60 + 30 leaves 10; 30 gives way to 25 + 15
    sequence, _ = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert len(set(sequence[[0, 2, 3]])) == 1 and sequence[1] != sequence[0]


def test_packing_odd_rows(spark):
    assert packing.pack_documents(documents(spark, []), BYTE).collect() == []
    rows = packing.pack_documents(documents(spark, ["a", "a", None], [7, 7, None]), BYTE).collect()
    assert sorted(r.length for r in rows) == [1, 2, 2] and check_packing(rows, 2048) == 1


def test_packing_spreads_repeated_rows(spark):
    pieces = packing.token_pieces(documents(spark, ["one and the same"] * 600, [7] * 600).repartition(3), BYTE)
    rows = packing.pack(pieces, 2048, group_rows=50).collect()
    sizes = Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 600 and len(sizes) == 12 and max(sizes.values()) < 100
    check_packing(rows, 2048)


def test_orc_round_trip(spark):
    texts = made_texts()
    path = Scratch(spark, "orc-test").path("ids")
    orc_output.write_orc(documents(spark, texts), path, WORD, range_bytes=4000)
    rows = sorted(orc_output.ids_crc32(orc_output.read_orc(spark, path)).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, found in zip(rows, whole_ids(WORD, texts), strict=True):
        ids = np.array(found + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = Scratch(spark, "orc-test").path("odd")
    orc_output.write_orc(documents(spark, ["b", "a", None], [5, 5, None]), path, WORD, range_bytes=1)
    assert sorted((r.start, r.doc_id) for r in orc_output.read_orc(spark, path).collect()) == [(0, None), (1, 5), (3, 5)]


def test_orc_index_and_bloom_filter_skip_rows(spark):
    """A doc_id that is absent within a stripe's range costs no row; one that is there costs its row group."""
    path = Scratch(spark, "orc-test").path("index")
    docs = spark.range(0, 12_000, 2).selectExpr("id as doc_id", "concat('text ', id) as text", "1 as range_id", "'x' as token_ids")
    orc_output.write_orc(docs, path, WORD, row_stride=1000)

    def rows_read(doc_id):
        found = spark.read.orc(path).where(f"doc_id = {doc_id}")
        n = len(found.collect())
        return n, found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert rows_read(5001) == (0, 0) and rows_read(-7) == (0, 0)
    n, read = rows_read(5000)
    assert n == 1 and 1 <= read <= 1000
    one = next(f for f in spark.read.orc(path).inputFiles() if f.endswith(".orc")).removeprefix("file:").removeprefix("//")
    assert orc.ORCFile(one).row_index_stride == 1000 and orc.ORCFile(one).compression == "ZSTD"


def test_orc_odd_rows(spark):
    path = Scratch(spark, "orc-test").path("none")
    orc_output.write_orc(documents(spark, []), path, WORD)
    assert orc_output.ids_crc32(orc_output.read_orc(spark, path)).collect() == []
    path = Scratch(spark, "orc-test").path("same")
    orc_output.write_orc(documents(spark, ["same"] * 300 + ["y " * 30_000, ""], [5] * 301 + [None]).repartition(3), path, WORD, range_bytes=100)
    rows = sorted(orc_output.read_orc(spark, path).collect(), key=lambda r: r.start)
    assert rows[0].doc_id is None and len(rows) == 302 and all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    assert len({r.range_id for r in rows}) > 1 and max(r.n_tokens for r in rows) == 30_001


# 2


def slow_fingerprint(text):
    words = space_words((text or "").translate(_LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, near):
    least = list(range(len(values)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def test_near_duplicates(spark):
    texts = made_texts()
    rows = sorted(simhash.near_duplicates(documents(spark, texts)).collect(), key=lambda r: r.doc_id)
    prints = [slow_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in rows] == [f"{x:016x}" for x in prints]
    assert [r.component_id for r in rows] == slow_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)


@pytest.mark.parametrize("bucket", [2, 48])
def test_links_join_what_is_near(spark, monkeypatch, bucket):
    """Also with buckets so small that most classes go the other way."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    values = sorted({c ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randrange(4))) for c in centres for _ in range(25)})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    scratch = Scratch(spark, "links-test")
    got = {r.node: r.label for r in components(simhash.links(classes, scratch), scratch).collect()}
    want = slow_components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for v, g in zip(signed, want):
        groups.setdefault(g, set()).add(got.get(v, v))
    assert all(len(x) == 1 for x in groups.values()) and len({min(x) for x in groups.values()}) == len(groups)


def test_near_duplicates_odd_rows(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    rows = simhash.near_duplicates(documents(spark, ["a b c", "a b c", "zz", None], [None, 4, None, 9])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("9", "9"), ("None", "4"), ("None", "None")]


# 3


def tone_track(rnd, n=80):
    t = np.arange(chroma.HOP) / chroma.RATE
    return np.concatenate([12000 * np.sin(2 * np.pi * 220 * 2 ** (rnd.randrange(24) / 12) * t) for _ in range(n)])


def test_recordings_align_at_their_offset(spark):
    rnd = random.Random(5)
    tracks = [tone_track(rnd) for _ in range(6)]
    noise = np.random.default_rng(1).normal(0, 150, len(tracks[0]))
    shifted = np.concatenate([tone_track(rnd, 7), tracks[0]])
    audio = [*tracks, tracks[0] + noise, shifted, tracks[1]]
    rows = [(i, x.astype("<i2").tobytes()) for i, x in enumerate(audio)] + [(100, None), (101, b""), (102, b"abc")]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "media_id long, audio binary"))
    found = {(r.query_id, r.match_id): r for r in chroma.align(prints, chroma.F.col("media_id") < 2).collect()}
    # a little noise changes no integer: 6 is of the class of 0
    assert {m for q, m in found if q == 0} == {0, 7} and found[0, 7].offset == -7 and found[0, 0].n_copies == 1
    assert {m for q, m in found if q == 1} == {1} and found[1, 1].n_copies == 1
    linked = {r.media_id: r for r in chroma.linked(prints, chroma.F.col("media_id") < 2).collect()}
    assert len(linked) == 12 and linked[0].n_links == 2 and linked[100].n_steps == 0 and linked[5].n_links is None


def slow_links(prints, queries):
    """The least error over all offsets that overlap by half of the shorter one or more, where it is accepted."""
    found = {}
    for q, m in itertools.product(queries, prints):
        a, b = prints[q], prints[m]
        if q != m and len(a) and len(b):
            for o in range(1 - len(b), len(a)):
                first = max(o, 0)
                n = min(len(a) - first, len(b) - first + o)
                if n >= max(chroma.MIN_OVERLAP, min(len(a), len(b)) // 2):
                    error = int(np.bitwise_count(a[first : first + n] ^ b[first - o : first - o + n]).sum()) / (32 * n)
                    if error <= min(chroma.MAX_ERROR, found.get((q, m), (1, 0))[0]):
                        found[q, m] = error, o
    return found


def test_links_of_noisy_shifted_and_steady_recordings(spark):
    rng, rnd = np.random.default_rng(3), random.Random(3)
    prints = {i: chroma.fingerprint(tone_track(rnd).astype("<i2").tobytes()) for i in range(20)}
    for i in range(20):
        for k, (share, shift) in enumerate([(0.05, 0), (0.1, 9), (0.15, 0), (0.15, 20), (0.19, 5)]):
            flips = np.packbits(rng.random((len(prints[i]), 32)) < share, axis=1).view(np.uint32).ravel()
            prints[100 + 5 * i + k] = (prints[i] ^ flips)[shift:]
    steady = prints[0][:1]
    prints |= {20: np.full(50, steady[0]), 300: np.full(30, steady[0]), 301: np.full(70, steady[0]), 302: np.full(2, steady[0])}
    rows = [(i, p.view(np.int32).tolist()) for i, p in prints.items()]
    got = chroma.align(spark.createDataFrame(rows, "media_id long, chroma array<int>"), chroma.F.col("media_id") <= 20).collect()
    got, want = {(r.query_id, r.match_id): r for r in got}, slow_links(prints, range(21))
    assert len(want) >= 80 and sum(k in got for k in want) >= 0.9 * len(want)
    assert sum(k in got and got[k].offset == o for k, (_, o) in want.items() if k[0] < 20) >= 0.9 * sum(q < 20 for q, _ in want)
    assert (got[20, 300].offset, got[20, 300].error, got[20, 301].error) == (0, 0.0, 0.0) and (20, 302) not in got
    assert all(r.error <= chroma.MAX_ERROR and r.votes >= chroma.MIN_VOTES for r in got.values())


def slow_integers(frames):
    """The packed integers with every rectangle added up cell by cell."""
    out = []
    for t in range(len(frames) - chroma.SPAN + 1):
        area = lambda t0, t1, p0, p1: sum(frames[t + i][p] for i in range(t0, t1) for p in range(p0, p1))  # noqa: B023, E731
        value = 0
        for k, (kind, p, high, wide) in enumerate(chroma.filters()):
            p1, half, third = min(12, p + high), wide // 2, wide // 3
            m = (p + p1) // 2
            a, b = [
                (area(0, half, p, p1), area(half, wide, p, p1)),
                (area(0, wide, p, m), area(0, wide, m, p1)),
                (area(0, half, p, m) + area(half, wide, m, p1), area(0, half, m, p1) + area(half, wide, p, m)),
                (2 * area(third, wide - third, p, p1), area(0, third, p, p1) + area(wide - third, wide, p, p1)),
            ][kind]
            level = sum(np.log((a + 0.05) / (b + 0.05)) >= border for border in chroma.BORDERS)
            value |= (level ^ level >> 1) << 2 * k
        out.append(value)
    return out


def test_integral_image_sums_rectangles():
    frames = np.random.default_rng(2).random((40, 12))
    values = chroma.packed_integers(frames)
    assert values.tolist() == slow_integers(frames) and len(values) == 40 - chroma.SPAN + 1
    assert len(chroma.packed_integers(frames[: chroma.SPAN - 1])) == 0


def test_recordings_odd_rows(spark):
    assert chroma.linked(chroma.fingerprints(spark.createDataFrame([], "media_id long, audio binary, chroma string, kind int")), chroma.F.col("media_id") == 0).collect() == []
    tone = tone_track(random.Random(1), 40).astype("<i2").tobytes()
    rows = [(0, tone, "x", 1), (0, tone, "x", 2), (None, tone, None, 3), (7, None, "y", 4), (8, b"a", "z", 5), (7, tone + b"!", "y", 6)]
    got = chroma.linked(chroma.fingerprints(spark.createDataFrame(rows, "media_id long, audio binary, chroma string, kind int")), chroma.F.coalesce(chroma.F.col("media_id") == 0, chroma.F.lit(False))).collect()
    assert sorted((str(r.media_id), r.class_rows, r.n_links) for r in got) == [("0", 4, 3), ("0", 4, 3), ("7", 2, None), ("7", 4, None), ("8", 2, None), ("None", 4, None)]


# 4

LICENSES = ["CC-BY and cc by", "GNU General Public License, version 3.0 or later", "All rights reserved. all  RIGHTS reserved", None, "", "cc", "see the Apache License, Version 2.0; licensed under the Apache License, Version 2.0", "mit keit", "Released under the terms of the MIT license.", "éall rights reserved", "cc by cc by"]


def test_license_places_and_labels(spark):
    texts = LICENSES + made_texts()
    rows = {r.doc_id: r for r in license_scan.labels(license_scan.scan(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        words, at, labels = plain_words(text), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[6].labels == "apache-2.0" and rows[6].score == 0.95 and rows[8].labels == "mit" and rows[7].labels == ""


def examples(pattern):
    """Texts that take every alternative of a pattern (of a class, its first and last character)."""

    def texts(parts):
        out = [""]
        for op, arg in parts:
            if str(op) == "LITERAL":
                found = [chr(arg)]
            elif str(op) == "IN":
                ends = [c for o, a in arg for c in (a if str(o) == "RANGE" else (a,))]
                found = [chr(c) for c in (ends[0], ends[-1])]
            elif str(op) == "BRANCH":
                found = [t for branch in arg[1] for t in texts(branch)]
            elif str(op) == "SUBPATTERN":
                found = texts(arg[3])
            else:
                assert str(op) == "MAX_REPEAT"
                found = [t * n for n in {arg[0], arg[1]} for t in texts(arg[2])]
            out = [a + b for a in out for b in dict.fromkeys(found)]
        return out

    return list(dict.fromkeys(texts(re._parser.parse(pattern))))


def test_every_alternative_of_every_license_rule_is_found(spark):
    rules = license_scan.rules()
    assert all(keyword in text for _, keyword, name in license_scan.NAMES for text in examples(name))
    cases = [(label, text) for label, _, pattern, priority, _ in rules[: len(license_scan.NAMES)] for text in examples(pattern)]
    cases += [(label, text) for label, pattern in license_scan.SPDX for text in examples(f"spdx license identifier (?:{pattern})")]
    cases += [(label, text) for label, keyword, pattern in license_scan.CLAUSES for text in examples(pattern) if keyword in text or pytest.fail(text)]
    for form, priority, _ in license_scan.FORMS[1:]:
        cases += [(label, text) for label, _, name in license_scan.NAMES for text in examples(form.format(re.escape(examples(name)[-1])))]
    rows = {r.doc_id: r.labels for r in license_scan.labels(license_scan.scan(documents(spark, [t for _, t in cases]))).collect()}
    assert [(label, text) for i, (label, text) in enumerate(cases) if label not in rows[i].split(",")] == []


def slow_detections(text):
    """Every rule tried on every text, without gates or keywords; suppression pair by pair."""
    words = plain_words(text)
    padded, found = f" {' '.join(words)} ", []
    at = {0: 0}
    for m in re.finditer(" ", padded):
        at[m.end()] = len(at) - 1
    for label, _, pattern, priority, confidence in license_scan.rules():
        for m in re.finditer(f"(?<= )(?:{pattern})(?= )", padded):
            start = padded[: m.start()].count(" ") - 1
            found.append((label, priority, confidence, start, start + len(m[0].split(" "))))
    gone = lambda d: any(e[3] <= d[3] and e[4] >= d[4] and (e[1] > d[1] or e[1] == d[1] and e[4] - e[3] > d[4] - d[3]) for e in found)
    return sorted({d for d in found if not gone(d)})


def test_detections_are_those_of_all_rules(spark):
    rnd = random.Random(12)
    pieces = [t for _, _, p in (*license_scan.NAMES, *license_scan.CLAUSES) for t in examples(p)[:1]] + ["licensed under the", "copy of the", "subject to the terms of the", "spdx license identifier", "version 2", "or later", "plain words", "public", "All Rights Reserved.", "CC BY"]
    texts = [rnd.choice([" ", ", ", "\n"]).join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 7))) for _ in range(250)] + LICENSES
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    listed = {r.doc_id: r for r in license_scan.labels(license_scan.scan(docs)).collect()}
    for i, text in enumerate(texts):
        want = slow_detections(text)
        assert sorted(tuple(d[k] for k in ("label", "priority", "confidence", "start", "end")) for d in rows[i].detections) == want, text
        base = {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in f" {' '.join(plain_words(text))} "}
        assert set(listed[i].labels.split(",")) - {""} == base | {d[0] for d in want}


def test_spdx_lines(spark):
    ids = ["MIT", "ISC", "Zlib", "MPL-2.0", "EPL-2.0", "GPL-2.0-or-later", "Apache-2.0", "BSD-3-Clause", "CC-BY-4.0", "MIT-0"]
    rows = license_scan.scan(documents(spark, [f"// SPDX-License-Identifier: {i}" for i in ids])).orderBy("doc_id").collect()
    assert [[(d.label, d.priority, d.start) for d in r.detections] for r in rows] == [[("gpl-2.0" if "GPL" in i else i.lower(), 5, 0)] for i in ids]


def test_contained_detections_give_way(spark):
    rows = license_scan.scan(documents(spark, ["licensed under the Apache License, Version 2.0", "GNU General Public License version 2"])).orderBy("doc_id").collect()
    assert [(d.label, d.start, d.end) for d in rows[0].detections] == [("apache-2.0", 0, 8)]
    assert [d.label for d in rows[1].detections] == ["gpl-2.0"] and len(license_scan.rules()) > 200
    assert license_scan.scan(documents(spark, [])).collect() == []


# 5


def test_html_main_text():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies.</div><div id="sidebar"><p>About the author and many other things, which are long. Really.</p></div>
    <article><h1>A &amp; B</h1><p>First <b>bo</b>ld&nbsp;text,<br>line.<p>Short.</p><div class="advert">Buy now!</div><p>Last one.</p>
    <section class="comments"><p>I like this very much, thanks. It was good.</p></section></article><form><p>Mail us</p></form><footer>&copy; us</footer></body>"""
    assert html_extract.main_text(page) == "A & B First bold text, line. Short. Last one."
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p></p>") == ""
    long = "This is a sentence, and it is long enough to count as text. " * 4
    assert html_extract.main_text(f"<body><div><p>{long}</p><p>{long}</p></div><div class=menu><a href=x>one</a></div></body>") == " ".join([long.strip()] * 2)


LONG = "This is a sentence, and it is long enough to count as text. " * 4
PAGES = [
    ("<svg/><article><p>A b.</p></article>", "A b."),
    ("<article><svg><title>x</title><svg/><path d='M0 0'/></svg><p>A b.</p></article>", "A b."),
    ("<title-bar></title-bar><article><p>A b.</p></article>", "A b."),
    ("<article><p>A <button>Press <p>b.</p><p>C.</p></article>", "A b. C."),
    ('<article><p>A <a title="x > y" href="z">link</a> b.</p></article>', "A link b."),
    ("<article><p title=it's>A b.</p><p class='c'>C.</p></article>", "A b. C."),
    (f'<body class="fixed-header has-sidebar"><div><p>{LONG}</p></div></body>', LONG.strip()),
    (f'<body id="sidebar"><div class="has-comments"><p>{LONG}</p></div></body>', LONG.strip()),
    ('<article><p>A b.</p><article class="comment"><p>I like it.</p></article></article>', "A b."),
    ('<article data-class="ad" title="class=ad"><p>A b.</p></article>', "A b."),
    ("<article><!--><p>A</p><!-- x > y --><p>b.</p></article><!-- open <p>x</p>", "A b."),
    ("<article><p>1 < 2 and 3 <4</p></article>", "1 < 2 and 3 <4"),
    ("<article><p>A&nbsp;b &lt;i&gt; &amp;amp;</p></article>", "A b <i> &amp;"),
    ("<article><p>A</p><noscript><p>no</p></noscript><template><p>no</p></template><p>b.</article>", "A b."),
    ("<article><script>'</p>'</script><STYLE>x</STYLE ><p>A b.</p></article>", "A b."),
    ("<article><p>A b.</p><div style='display: none'>x</div><div hidden>y</div></article><p", "A b."),
    ("<article><ul><li>One<li>Two</ul><table><tr><td>1<td>2</table></article>", "One Two 1 2"),
    ("<a" * 50_000, ""),
    ("<article>" + "<p>x" * 3000 + "</article>", " ".join("x" * 3000)),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text_of_ordinary_and_broken_pages(page, text):
    assert html_extract.main_text(page) == text


def test_made_pages_give_their_articles(spark):
    """Pages put together from an article and all that is to go, in any order."""
    rnd = random.Random(9)
    sentence = lambda: " ".join(rnd.choice(["wind", "farm", "road", "says", "the", "old"]) for _ in range(rnd.randrange(3, 14))).capitalize() + rnd.choice(".!?")
    noise = ["<nav><a href=/a>Home</a> <a href=/b>News</a></nav>", "<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<form><p>{}</p><input></form>", "<div id='cookie-notice'>{}</div>", "<script>{}</script>", "<section class='comments'><p>{}</p></section>", "<!-- {} -->"]
    rows, want = [], {}
    for i in range(60):
        paragraphs = [" ".join(sentence() for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 7))]
        inner = [f"<h1>{sentence()}</h1>" if rnd.random() < 0.5 else "", *(f"<p>{p}</p>" for p in paragraphs)]
        want[i] = " ".join(re.sub("<[^>]*>", "", x) for x in inner if x)
        for _ in range(3):
            inner.insert(rnd.randrange(len(inner) + 1), rnd.choice(noise).format(sentence()))
        around = [rnd.choice(noise).format(sentence()) for _ in range(4)]
        rows.append((i, "u", "<html><body>" + "".join(around[:2]) + "<article>" + "".join(inner) + "</article>" + "".join(around[2:]) + "</body></html>"))
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def slow_cut(margins, edges):
    best = None
    for mask in range(1 << len(margins)):
        label = [bool(mask >> i & 1) for i in range(len(margins))]
        cost = sum(max(m, 0) if not x else max(-m, 0) for m, x in zip(margins, label)) + sum(w for (i, j), w in edges.items() if label[i] != label[j])
        best = min(best, cost) if best is not None else cost
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=1, max_size=8), st.data())
def test_cut_is_minimal(margins, data):
    n = len(margins)
    edges = {(i, j): data.draw(st.integers(0, 5)) for i in range(n) for j in range(i + 1, n) if data.draw(st.booleans())}
    label = html_extract.minimum_cut(margins, edges)
    cost = sum(max(m, 0) if not x else max(-m, 0) for m, x in zip(margins, label)) + sum(w for (i, j), w in edges.items() if label[i] != label[j])
    assert cost == slow_cut(margins, edges)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (1, None, "<p>x", 6), (None, "v", "<article>" + "<p>hello, world. " * 2000, 7)], "page_id long, url string, html string, n_chars int")
    rows = html_extract.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in rows)[0] == ("1", 0) and max(r.n_chars for r in rows) == len("hello, world. ") * 2000 - 1
    assert html_extract.extract(pages.limit(0)).collect() == []


# 6 and 10


def test_pairs_beat_additive_weights():
    """Label 1 needs both terms; neither alone."""
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 4)) < 0.5).astype(np.int64)
    y = (x[:, 0] * x[:, 1]).astype(np.float64)
    first, slot = np.concatenate([[0], np.cumsum(x.sum(axis=1))]), np.nonzero(x)[1]
    model = toxicity.FactorizationMachine.fit(first, slot, np.ones(len(slot)), y, epochs=40)
    assert ((model.score(first, slot, np.ones(len(slot))) >= 0.5) == (y > 0)).mean() > 0.99
    value = x * np.log(2) * model.reliance[:4]
    slow = [model.w0 + sum(r * model.w[:4]) + sum(r[i] * r[j] * (model.v[i] @ model.v[j]) for i in range(4) for j in range(i)) for r in value[:20]]
    assert np.allclose(1 / (1 + np.exp(-np.array(slow))), model.score(first[:21], slot[: first[20]], np.ones(first[20])), atol=1e-4)


def test_term_counts_are_those_of_each_text():
    texts = ["Ab abcde abcde!", "", "...", "éé abcdefgh " * 3, "abcd"]
    first, slot, count = toxicity.Terms().counts(pa.array(texts))
    for i, text in enumerate(texts):
        want = Counter(s for w in plain_words(text) for s in toxicity.slots_of(w.encode()) if s >= 0)
        assert dict(zip(slot[first[i] : first[i + 1]].tolist(), count[first[i] : first[i + 1]].tolist())) == want


def test_scores_are_the_model_on_each_text(spark):
    """The query's scores against the fitted model, worked out text by text."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model, density = toxicity.fit(docs, labels), quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scored(docs, labels).collect():
        counts = Counter(s for w in plain_words(texts[r.doc_id]) for s in toxicity.slots_of(w.encode()) if s >= 0)
        x = {s: np.log1p(n) * model.reliance[s] for s, n in counts.items()}
        s = sum((x[k] * model.v[k] for k in x), np.zeros(toxicity.FACTORS))
        margin = model.w0 + sum(x[k] * model.w[k] for k in x) + 0.5 * (s @ s - sum(x[k] ** 2 * (model.v[k] @ model.v[k]) for k in x))
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(margin, -30, 30)))) < 1e-4 and r.predicted == (r.score >= 0.5)
    # the discriminant by its textbook formula, from the labelled rows themselves
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {i: np.array(quality.statistics(t or "")) for i, t in texts.items()}
    by = [np.array([x[i] for i, k in known.items() if k == c]) for c in (0, 1)]
    scatter = [np.cov(b.T) * (len(b) - 1) for b in by]
    pooled = sum(scatter) / (sum(map(len, by)) - 2)
    parts = []
    for b, sc in zip(by, scatter):
        own = 0.9 * sc / (len(b) - 1) + 0.1 * pooled
        own = 0.9 * own + 0.1 * np.diag(np.diag(own)) + 1e-3 * np.eye(len(own))
        parts.append((b.mean(axis=0), np.linalg.inv(own), np.linalg.slogdet(own)[1], np.log(len(b) / len(known))))
    for r in quality.scored(docs, labels).collect():
        d = [p - 0.5 * (det + (x[r.doc_id] - m) @ inv @ (x[r.doc_id] - m)) for m, inv, det, p in parts]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(d[1] - d[0], -30, 30)))) < 1e-6 and r.predicted == (r.score >= 0.3)


def test_contradicting_labels_and_repeated_ids(spark):
    docs = documents(spark, [f"text {i}" for i in range(40)] + ["other"] * 5, [*range(40)] + [3] * 5)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(4, 1, 1), (6, 0, 0), (8, 7, None)], "doc_id long, quality int, toxic int")
    from windloom.llm.labelled import training_rows

    rows = training_rows(docs, labels, "toxic").collect()
    free = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 and i != 4]
    assert len(rows) == len(free) and training_rows(docs, labels, "toxic", 7).count() == 7
    assert sum(r.label for r in rows) == sum(i % 2 for i in free)


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.9), (quality, "quality", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = module.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, module):
    docs = documents(spark, ["a b", None, "", "a b", "x" * 200_000], [1, 2, None, 1, 5])
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = module.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and {r.held_out for r in rows if r.doc_id is None} == {True}
    assert module.scored(docs.limit(0), labels.limit(0)).collect() == []


# 7


def slow_repeats(texts, ids, width):
    first = {}
    words = [space_words(t) for t in texts]
    for i, w in sorted(zip(ids, words)):
        for a in range(len(w) - width + 1):
            first.setdefault(tuple(w[a : a + width]), i)
    out = {}
    for i, w in zip(ids, words):
        stay = [True] * len(w)
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < i:
                stay[a : a + width] = [False] * width
        kept = " ".join(x for x, s in zip(w, stay) if s)
        out[i] = (len(w), len(w) - sum(stay), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width", [50, 8])
def test_repeated_passages(spark, width):
    texts = made_texts()
    ids = list(range(len(texts)))
    random.Random(2).shuffle(ids)
    rows = substring_dedup.digest(substring_dedup.mark(documents(spark, texts, ids), width)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == slow_repeats(texts, ids, width)


def test_repeated_passages_odd_rows(spark):
    assert substring_dedup.mark(documents(spark, [])).collect() == []
    text = " ".join(map(str, range(60)))
    rows = substring_dedup.digest(substring_dedup.mark(documents(spark, [text, text, text, text], [None, 3, 3, 8]))).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in rows) == [("3", 0), ("3", 0), ("8", 60), ("None", 0)]


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    rnd = random.Random(8)
    p, q = (" ".join(f"{c}{rnd.randrange(10**6)}" for _ in range(70)) for c in "pq")
    rows = substring_dedup.digest(substring_dedup.mark(documents(spark, [p, p, q, p, q], [1, 5, 5, 5, 6]))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (5, 0), (5, 70), (5, 70), (6, 70)]


# 8


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_contamination(spark, block_bytes):
    texts = made_texts()
    items = [(1, " ".join(space_words(texts[0])[2:40])), (2, "w1 W2-w3"), (3, None), (10, texts[4] or ""), (10, texts[8]), (4, "w1"), (5, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for width, bench_items in ((13, items), (13, items[:1])):
        windows = {}
        for item, text in bench_items:
            w = plain_words(text)
            n = min(width, len(w))
            for a in range(len(w) - n + 1 if w else 0):
                windows.setdefault(tuple(w[a : a + n]), set()).add(str(item))
        got = {r["row"].doc_id: r for r in decontaminate.contamination(decontaminate.mark(documents(spark, texts), bench.limit(len(bench_items)) if len(bench_items) > 1 else bench.where("item_id = 1"), width, block_bytes)).collect()}
        for i, text in enumerate(texts):
            w, hit, found = plain_words(text), set(), set()
            for n in {len(k) for k in windows}:
                for a in range(len(w) - n + 1):
                    if tuple(w[a : a + n]) in windows:
                        hit.update(range(a, a + n))
                        found |= windows[tuple(w[a : a + n])]
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))


def test_longest_matches(spark):
    words = [f"x{k}" for k in range(40)]
    docs = documents(spark, ["a b " + " ".join(words[5:30]) + " c"])
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.longest_matches(spark, docs, bench).collect()] == [(0, "7", 2, 5, 25)]
    assert decontaminate.decontaminate(docs, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).columns == docs.columns


def slow_matches(texts, items, width):
    """Longest common stretches of words on each diagonal, by comparing all pairs of places."""
    out = set()
    for d, text in enumerate(texts):
        w = plain_words(text)
        for item, t in items:
            v = plain_words(t)
            need = min(width, len(v))
            for i, j in itertools.product(range(len(w)), range(len(v))):
                if w[i] == v[j] and not (i and j and w[i - 1] == v[j - 1]):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if need and n >= need:
                        out.add((d, str(item), i, j, n))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_longest_matches_are_all_of_them(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "AT_ONCE", 4)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(25)] + ["", None, "a " * 80]
    items = [(k, " ".join(rnd.choice("abc") for _ in range(rnd.choice([2, 7, 30])))) for k in range(6)] + [(8, "a a a"), (9, "a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.longest_matches(spark, documents(spark, texts), bench, 5, block_bytes).collect()
    assert sorted(tuple(r) for r in rows) == sorted(slow_matches(texts, items, 5))


def test_contamination_odd_rows(spark):
    bench = spark.createDataFrame([(1, "one two"), (None, "one two"), (1, "one two"), (2, "")], "item_id long, text string")
    rows = decontaminate.contamination(decontaminate.mark(documents(spark, ["one two three", "one two three", None, "x"], [None, 3, 3, 3]), bench)).collect()
    assert sorted((str(r["row"].doc_id), r.n_words, r.n_hit, r.n_items) for r in rows) == [("3", 0, 0, 0), ("3", 1, 0, 0), ("3", 3, 2, 2), ("None", 3, 2, 2)]
    assert decontaminate.mark(documents(spark, []), bench).collect() == []


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect()) == sorted(want.fetchall())


# the pipeline


def test_pipeline_stages_keep_their_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    scratch = Scratch(spark, "pipeline-test")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        seen.append((before, after))
    before, after = seen[1]
    prints = {i: slow_fingerprint(t) for i, t in before.items()}
    order = sorted(prints)
    roots = slow_components([prints[i] for i in order], lambda a, b: (a ^ b).bit_count() <= 2)
    assert set(after) == {order[r] for r in roots}
    before, after = seen[2]
    want = slow_repeats(list(before.values()), list(before), 50)
    for i, (n, removed, digest) in want.items():
        assert (i in after) == (removed == 0 or removed < n)
        if removed and i in after:
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
        elif not removed:
            assert after[i] == texts[i]
    assert len([i for i in seen[3][0] if i not in seen[3][1]]) > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(seen[3][1])


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    rnd = random.Random(6)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(80))
    other = text + " " + " ".join(f"v{rnd.randrange(10**6)}" for _ in range(200))
    rows = [(1, text), (1, text), (2, text), (None, text), (None, None), (None, None), (3, ""), (4, other), (4, "own words " * 40), (5, "y" * 100_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", 1, 0.5, True) for i, t in rows], DOCS + ", row string, tie int, score double, __cut boolean")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            before, kept = kept, stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns
        found = sorted((str(r.doc_id), r.text) for r in kept.collect())
        if table is docs:
            assert [i for i, _ in found] == ["1", "3", "4", "4", "5"] and dict(found)["1"] == text
            assert " ".join(space_words(other)[80:]) in [t for _, t in found]
        else:
            assert found == []
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        assert {str(r.doc_id) for r in packed} == {i for i, _ in found}


def test_pipeline_drops_what_its_models_reject(spark):
    """Toxicity and decontamination against the operators' own answers, packing against the library's ids."""
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    rejected = {r.doc_id for r in toxicity.scored(docs, labels).collect() if r.predicted}
    assert {r.doc_id for r in stages["toxicity"](spark, docs, SF).collect()} == {r.doc_id for r in docs.collect()} - rejected
    items = [plain_words(r.text) for r in bench.collect()]
    windows = {tuple(w[a : a + 13]) for w in items for a in range(max(1, len(w) - 12)) if w}
    clean = set()
    for r in docs.collect():
        w, hit = plain_words(r.text), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in stages["decontamination"](spark, docs, SF).collect()} == clean
    rows = stages["packing"](spark, docs, SF).collect()
    ids = dict(zip([r.doc_id for r in docs.collect()], whole_ids(BYTE, [r.text for r in docs.collect()])))
    for r in rows:
        part = np.array([*ids[r.doc_id], 0], "<u4")[r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    check_packing(rows, 2048)


LONG = "A long paragraph with many words, which says something. " * 6


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div role="main"><p>Short one.</p><p>Two.</p></div>', "Short one. Two."),
        ('<main id="search-page"><p>Hello there.</p></main>', "Hello there."),
        ("<body><nav><a href=x>Home</a></nav><ul><li>First thing</li><li>Second thing</li></ul></body>", "First thing Second thing"),
        ("<body><p>Short.</p><p>Also short</p></body>", "Short. Also short"),
    ],
)
def test_main_parts_by_role_and_pages_that_mark_none(page, text):
    assert html_extract.main_text(page) == text


def test_the_cut_decides_where_classes_do_not():
    """A line of links between two long paragraphs of one parent leans to boilerplate alone, and is content by its neighbours."""
    page = f"<body><div><p>{LONG}</p><p><a href=x>See the other part</a></p><p>{LONG}</p></div><div><a href=a>Home</a> <a href=b>News</a></div></body>"
    blocks = html_extract.blocks_of(page)
    margins = [html_extract.margin(b, False) for b in blocks]
    labels = html_extract.minimum_cut(margins, html_extract.edges_of(blocks))
    assert [v > 0 for v in margins] == [True, False, True, False]
    assert labels == [True, True, True, False]
    assert html_extract.main_text(page) == " ".join([LONG.strip(), "See the other part", LONG.strip()])


def test_toxicity_model_is_fitted_in_a_task(spark, monkeypatch):
    """The driver gets the model, not the labelled rows."""
    docs = spark.createDataFrame([(i, "vile words" if i % 2 else "kind words") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    monkeypatch.setattr(type(docs), "toArrow", lambda self: pytest.fail("rows on the driver"))
    assert toxicity.fit(docs, labels).w is not None
    assert toxicity.fit(docs, labels.where("false")).w is None


def test_finer_keys_are_small_code(spark):
    """The keys of crowded buckets compile: the driver isn't given a method that the JVM rejects."""
    rows = spark.range(9).selectExpr("id AS key", "cast(id % 6 AS int) AS pair", "transform(sequence(0, 15), i -> i + id) AS parts")
    keys = rows.withColumn("free", simhash._free(F.col("parts"), F.col("pair"))).select(simhash._finer(F.col("free"), F.col("key")).alias("keys"))
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(keys._jdf.queryExecution().executedPlan())
    assert len(code) < 300_000 and all(len(set(r["keys"])) == 28 for r in keys.collect())
