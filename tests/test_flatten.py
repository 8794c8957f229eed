"""Flatten against a plain recursive walk, on chosen and random JSON."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from recordprofile.operators.flatten import flatten_leaves, leaf_prints


def walk(v, path="", indexed=""):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from walk(x, f"{path}.{k}" if path else k, f"{indexed}.{k}" if indexed else k)
    elif isinstance(v, list) and v:
        for i, x in enumerate(v):
            yield from walk(x, f"{path}[]", f"{indexed}[{i}]")
    else:
        kind = (
            "object-empty" if isinstance(v, dict) else "array-empty" if isinstance(v, list) else "null" if v is None
            else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number"
        )
        text = None if kind in ("object-empty", "array-empty", "null") else str(v).lower() if isinstance(v, bool) else str(v)
        yield path, indexed, text, kind


def leaves(spark, docs, **options):
    rows = [(str(i), d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = flatten_leaves(spark.createDataFrame(rows, "version_key string, payload string"), **options).collect()
    return sorted((r["version_key"], r["path"], r["path_indexed"], r["value"] or "", r["value_type"]) for r in out)


def expected(docs):
    return sorted((str(i), p, x, t or "", k) for i, d in enumerate(docs) for p, x, t, k in walk(d))


SAMPLE = {
    "title": "x", "dates": [{"kind": "a", "value": "1"}, {"kind": "b"}], "tags": ["u", "v"], "none": [], "bare": {}, "nil": None, "yes": True, "no": False,
    "n": 3, "deep": {"a": {"b": [[1, 2], [], [None, {}]]}}, "a.b": "dotted", "q\"'": "é\n",
}


def test_chosen(spark):
    docs = [SAMPLE, {}, {"a": [[[]]]}, [], [1, {"a": 2}], "text", 5, None]
    docs = [d if not isinstance(d, str) else {"s": d} for d in docs]
    assert leaves(spark, docs) == expected(docs)


keys = st.text(st.characters(min_codepoint=32, max_codepoint=0x17F), min_size=1, max_size=4)
scalars = st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(st.characters(min_codepoint=9, max_codepoint=0x2FF, exclude_categories=["Cs"]), max_size=6)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(keys, x, max_size=3), max_leaves=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(keys, values, max_size=4), min_size=1, max_size=40))
def test_random(spark, docs):
    assert leaves(spark, docs) == expected(docs)


def test_table_function_has_the_same_leaves(spark):
    from recordprofile.functions.leaves import register_json_leaves

    register_json_leaves(spark)
    texts = [
        json.dumps(SAMPLE), "{}", "[]", "[1, {\"a\": [[]]}]", "5", '"x"', "null", '{"a": 1, "a": 2}', '{"n": [1.0, -0, 0.0, 10, 1e3, 1E-7, 2.5e10, 123456789.125, -1.50, 0.00001, 12345678901234567890123456789012345678901, 1e7, 100.0]}',
        '{"d": ' * 150 + "[]" + "}" * 150,
    ]
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("z", None)], "version_key string, payload string")
    shown = lambda df: sorted((r["version_key"], r["path"], r["path_indexed"], r["value"] or "", r["value_type"]) for r in df.collect())
    by_sql = lambda df, more="": spark.sql(f"SELECT d.version_key, l.* FROM {{df}} d, LATERAL json_leaves(d.payload{more}) l", df=df)
    assert shown(by_sql(frame)) == shown(flatten_leaves(frame))
    bad = spark.createDataFrame([("a", '{"x": 1}'), ("b", "{" * 60), ("c", "[1]"), ("d", "{not json"), ("e", "3")], "version_key string, payload string")
    assert shown(by_sql(bad, ", true")) == shown(flatten_leaves(bad, lenient=True)) == [("a", "x", "x", "1", "number")]
    with pytest.raises(Exception, match="JSONDecodeError"):
        by_sql(bad).collect()


def test_excluded_fields(spark):
    docs = [{"keep": 1, "drop": {"a": [1]}}, {"drop": 1}, {"x": {"drop": 2}}, {"drop.a": 3, "drop": 4}]
    want = [{"keep": 1}, {}, {"x": {"drop": 2}}, {"drop.a": 3}]
    assert leaves(spark, docs, excluded_fields=("drop",)) == expected(want)


def test_depth_duplicates_and_bad_json(spark):
    deep = {"a": 1}
    for _ in range(6):
        deep = {"d": [deep]}
    assert leaves(spark, [deep]) == expected([deep])
    with pytest.raises(Exception, match="nested deeper"):
        leaves(spark, [deep], max_depth=5)
    assert leaves(spark, ['{"a": 1, "a": 2}']) == [("0", "a", "a", "2", "number")]
    with pytest.raises(Exception, match="MALFORMED"):
        leaves(spark, [{"a": 1}, "{not json"])
    assert leaves(spark, [{"a": 1}, "{not json", "[1]", "3", "null"], lenient=True) == [("0", "a", "a", "1", "number")]


def test_any_depth(spark):
    deep = {"a": '}]"\\', "b": []}
    for k in range(12):
        deep = {"d{[": [deep, k]}
    docs = [deep, {"x": 1}, "3"]
    assert leaves(spark, docs) == expected([deep, {"x": 1}, 3])
    # Empty containers, scalars and nulls just where a block ends.
    edges = [{"a": {"b": {"c": {"d": x}}}} for x in ({}, [], 1, None, [1], [None], {"e": {}}, {"e": [[]]})]
    assert leaves(spark, edges) == expected(edges)


def test_very_deep_payloads(spark):
    levels = 500
    text = '{"a":[' * (levels // 2) + '1.0,"x",{}' + "]}" * (levels // 2)
    path = "a[]" + ".a[]" * (levels // 2 - 1)
    found = leaves(spark, ['{"x": 1}', text])
    assert sorted((r[1], r[3], r[4]) for r in found) == sorted([("x", "1", "number"), (path, "1", "number"), (path, "x", "string"), (path, "", "object-empty")])


def test_malformed_and_too_deep_texts_are_left_out(spark):
    bad = ["{" * n for n in (60, 150, 400)] + ["[" * 5000, '{"a":' * 5000 + "1" + "}" * 5000, '{"a": [[[[[[', "", "}", "\x00"]
    assert leaves(spark, [{"a": 1}, *bad], lenient=True) == [("0", "a", "a", "1", "number")]


def test_prints_tell_sets_of_leaves_apart(spark):
    docs = [{"a": 1, "b": [2, {}]}, {"b": [2, {}], "a": 1}, {"a": 1, "b": [{}, 2]}, {"a": "1", "b": [2, {}]}, {"a": None}, {}, []]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(0, None), (7, '{"a": 1.0, "b": [2, {}]}')]
    for depth in (None, 4):
        found = {r["k"]: tuple(r["leaf_print"]) for r in leaf_prints(spark.createDataFrame(rows, "k int, payload string"), keys=("k",), max_depth=depth).collect()}
        assert found[0] == found[1] == found[7] and len(set(found.values())) == 6 and len(found) == 8
