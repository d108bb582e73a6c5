"""Canonical JSON: the same text for the same content, another for any other; fingerprints of sets; ids of layers."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from windloom.operators import canonical

TREES = st.recursive(st.none() | st.booleans() | st.integers(-(10**30), 10**30) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(min_codepoint=32, max_codepoint=0xD7FF), max_size=4), x, max_size=4), max_leaves=12)


def turned(tree):
    """The same tree with all keys the other way round."""
    if isinstance(tree, dict):
        return {k: turned(v) for k, v in reversed(tree.items())}
    return [turned(v) for v in tree] if isinstance(tree, list) else tree


def texts(spark, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, text string").select("i", canonical.canonical(F.col("text")).alias("c"))
    return [r.c for r in rows.orderBy("i").collect()]


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES, min_size=30, max_size=60))
def test_equal_content_has_equal_texts_and_no_other(spark, trees):
    got = texts(spark, [json.dumps(t) for t in trees] + [json.dumps(turned(t), ensure_ascii=False, indent=1) for t in trees])
    want = [json.dumps(t, sort_keys=True) for t in trees]
    half = len(trees)
    assert got[:half] == got[half:]
    assert [json.loads(g) for g in got[:half]] == trees
    assert len(set(got)) == len(set(want))


def test_numbers_have_one_spelling_and_strings_stay(spark):
    assert texts(spark, ["[1.50, 2.0, 1e2, -0.0, 100]", '{"b.0": "1.0", "a": "x\\".0,"}', '"2.0"', "3.0"]) == ["[1.5,2,100,0,100]", '{"a":"x\\".0,","b.0":"1.0"}', '"2.0"', "3"]
    assert texts(spark, ["", "nope", '{"a": 1, "a": 2}', None, "[1", '{"a": NaN}']) == [None] * 6
    long = json.dumps({"b": 'é"\\' * 200_000, "a": 1})
    assert json.loads(texts(spark, [long])[0]) == json.loads(long)


def test_any_change_shows_in_the_fingerprint_of_its_set(spark):
    base = [(1, '{"a":1,"b":[1,2]}'), (1, '{"a":2}'), (2, '{"a": 2.0}'), (2, ' {"b":[1,2],"a":1}'), (3, '{"a":2}'), (3, '{"a":1,"b":[2,1]}'), (4, '{"a":2}'), (5, '{"a":2}'), (5, '{"a":2}'), (6, '{"a":null}'), (7, "{}"), (8, "{"), (9, "[")]
    got = {r.g: r.fingerprint for r in canonical.set_fingerprints(spark.createDataFrame(base, "g int, text string"), ["g"]).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 8


def test_layer_ids(spark):
    say = lambda p, **more: json.dumps({"type": "Feature", "properties": p, **more})
    rows = [say({"constraint_id": "a", "id": "b"}), say({"layer_id": 7}), say({"id": "b"}), say({"id": " b "}), say({"constraint_id": None, "id": "q"}), say({}), json.dumps({"properties": {}, "type": "Feature"}), say(None), say({"id": " "}), say({"id": ""}), "{", None]
    got = {r.feature: (r.layer_id, r.error) for r in canonical.layer_names(spark.createDataFrame(list(enumerate(rows)), "feature int, text string")).collect()}
    assert [got[i] for i in range(4)] == [("a", None), ("7", None), ("b", "DUPLICATE_ID"), ("b", "DUPLICATE_ID")]
    assert got[4][0].startswith("constraint-") and len(got[4][0]) == 27 and got[4][1] is None
    assert got[5] == got[6] and got[5][1] == "DUPLICATE_ID" and got[7][0] not in (got[5][0], None)
    assert got[8] == got[9] == ("", "EMPTY_ID") and got[10] == got[11] == (None, "MALFORMED")


def test_hot_blank_ids_and_empty_tables(spark):
    blank = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, '{"properties":{"id":" "}}').otherwise(F.format_string('{"properties":{"id":"%d"}}', "id"))).toDF("feature", "text")
    assert canonical.layer_names(blank).groupBy("error").count().count() == 2
    assert canonical.layer_names(blank.limit(0)).count() == 0 and canonical.set_fingerprints(blank.limit(0), ["feature"]).count() == 0
