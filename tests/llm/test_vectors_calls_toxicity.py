"""Vector join, tool calls and toxicity against brute force, a plain ordering and held-out rows."""

import json
import math
import random
import zlib
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pytest

from recordprofile.llm import tool_calls, toxicity, vector_join

SCHEMA = "vec_id long, embedding array<float>, label int"


def clusters(n=500, dim=24, seed=0, hot=120):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[rng.integers(0, n, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.25], size=(n, 1))
    group = base[0] + rng.normal(size=(hot, dim)) * 0.12
    x = np.concatenate([base, near, group, base[5:25], base[5:6].repeat(30, axis=0) * 2]).astype("f4")
    return x[rng.permutation(len(x))]


def brute_links(x, threshold=0.9):
    u = x.astype("f8")
    u /= np.linalg.norm(u, axis=1)[:, None]
    return [set(np.flatnonzero(row >= threshold)) - {k} for k, row in enumerate(u @ u.T)]


@pytest.mark.parametrize("block", [1024, 32])
def test_vector_join(spark, block):
    x = clusters()
    docs = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA).repartition(4)
    found = {r["vec_id"]: r for r in vector_join.linked_vectors(docs, per_list=40, probes=12, block=block).collect()}
    want = brute_links(x)
    got = sum(found[k]["n_links"] for k in found)
    assert got >= 0.97 * sum(map(len, want))
    assert all(found[k]["n_links"] <= len(want[k]) for k in found)
    # With every list visited the quantised search is exact.
    full = {r["vec_id"]: r for r in vector_join.linked_vectors(docs, per_list=40, probes=1000, block=block).collect()}
    assert {k: r["n_links"] for k, r in full.items()} == {k: len(w) for k, w in enumerate(want)}
    label = list(range(len(x)))
    changed = True
    while changed:
        changed = False
        for k, w in enumerate(want):
            low = min([label[k], *(label[j] for j in w)])
            if low < label[k]:
                label[k], changed = low, True
    assert {k: r["component_id"] for k, r in full.items()} == dict(enumerate(label))
    assert all(r["kept"] == (k == r["component_id"]) for k, r in full.items())


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 1), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0),
        (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (10, [1.0, 0.0], None), (11, [1e-30, 0.0], None), (12, [-3e38, 1.0], None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_join.linked_vectors(docs).collect()}
    assert {k for k, v in found.items() if v[0]} == {1, 2, 10, 11}
    # Every length has its own index.
    longer = spark.createDataFrame([(21, [1.0, 0.0, 0.1], 0), (22, [1.0, 0.0, 0.1], 0), (23, [1.0], 0), (24, [5.0], 0), (24, [-5.0], 0)], SCHEMA)
    both = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_join.linked_vectors(docs.unionByName(longer)).collect()}
    assert {(9, 2, 9, True), (21, 2, 9, False), (22, 2, 9, False), (23, 1, 23, True), (24, 1, 23, False), (24, 0, 24, True), (1, 3, 1, True)} <= both
    assert found[11] == (3, 1) and found[None] == (0, None) and len(found) == len(rows)
    assert vector_join.linked_vectors(docs.limit(0)).count() == 0
    assert vector_join.linked_vectors(docs.where("vec_id = 5")).count() == 1


@pytest.mark.parametrize("most_lists", [4096, 16])
def test_recall_where_lists_far_exceed_probes(spark, most_lists):
    """Many small groups from the given embeddings: each vector with two noisy ones, in one level of lists and in two."""
    rng = np.random.default_rng(2)
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("embedding").toPandas()["embedding"]
    base = np.stack(list(given)).astype("f8")
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.normal(size=(2, *base.shape))
    noise *= rng.uniform(0.1, 0.47, size=(2, len(base), 1)) / np.linalg.norm(noise, axis=2, keepdims=True)
    x = np.concatenate([base, *(base[None] + noise)]).astype("f4")
    docs = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA).repartition(4)
    found = {r["vec_id"]: r["n_links"] for r in vector_join.linked_vectors(docs, per_list=32, most_lists=most_lists).collect()}
    want = brute_links(x)
    assert all(found[k] <= len(w) for k, w in enumerate(want))
    recall = sum(found.values()) / sum(map(len, want))
    print(len(x), "vectors,", sum(map(len, want)) // 2, "pairs, recall", recall)
    assert sum(map(len, want)) > len(base) and recall >= 0.97


CALLS = "conv long, turn long, call string, name string, arguments string, after array<string>"
TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"properties": {"a": True, "b": False}}, [{"a": [1]}, {}], [{"b": 1}]),
        ({"additionalProperties": {"type": "string"}}, [{"x": "y"}], [{"x": 1}]),
        ({"patternProperties": {"^n_": {"type": "integer"}}, "additionalProperties": False}, [{"n_a": 1}], [{"n_a": "1"}, {"m": 1}]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3, 1.5]),
        ({"anyOf": [{"type": "string"}, {"const": 7}]}, ["x", 7, 7.0], [8, None]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}], "not": {"const": 1.5}}, [1, 2], [0, 3, 1.5]),
        ({"exclusiveMinimum": 0, "exclusiveMaximum": 1, "multipleOf": 0.1}, [0.1, 0.9, 0.3], [0, 1, 0.25]),
        ({"minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"$ref": "#/$defs/n"}, "$defs": {"n": {"type": "integer"}}}, [[1], [1, 2]], [[], [1, 2, 3], [1, 1.0], ["1"]]),
        ({"minProperties": 1, "maxProperties": 1}, [{"a": 1}], [{}, {"a": 1, "b": 2}]),
        ({"type": "object", "properties": {"next": {"$ref": "#"}}, "required": ["v"]}, [{"v": 1, "next": {"v": 2}}], [{"v": 1, "next": {}}]),
        (True, [1, None], []), (False, [], [1, None]),
    ],
)
def test_all_keywords_of_a_schema_count(schema, good, bad):
    tool_calls.check_schema(schema)
    assert [v for v in good if tool_calls.problems(v, schema)] == [] == [v for v in bad if not tool_calls.problems(v, schema)]


@pytest.mark.parametrize(
    "schema",
    [
        {"pattern": "("}, {"properties": {"a": {"if": {}}}}, {"$ref": "#/$defs/none"}, {"$ref": "http://elsewhere"}, {"$ref": "#"}, {"type": "text"}, {"items": 3},
        {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"allOf": [{"$ref": "#/$defs/a"}]}}, "$ref": "#/$defs/a"}, {"patternProperties": {"[": True}}, {"oneOf": [{"contains": {}}]},
    ],
)
def test_schemas_that_cannot_be_applied_are_refused(schema):
    with pytest.raises(ValueError):
        tool_calls.check_schema(schema)


def test_schema_check():
    assert tool_calls.problems({"a": 1, "b": ["x"]}, TOOLS["add"]) == []
    assert tool_calls.problems({"a": True}, TOOLS["add"]) == ["$.a: not integer"]
    assert tool_calls.problems({"b": [1], "c": 2}, TOOLS["add"]) == ["$.a: missing", "$.b[0]: not string", "$.c: not expected"]
    assert tool_calls.problems({"a": -1}, TOOLS["add"]) == ["$.a: out of bounds"]
    assert tool_calls.problems([], TOOLS["add"]) == ["$: not object"]
    assert tool_calls.canonical({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'
    assert tool_calls.canonical([1.0, -0.0, 1.5, True]) == "[1,0,1.5,true]"
    assert tool_calls.problems(True, {"enum": [1]}) and tool_calls.problems(1.0, {"enum": [1]}) == []


def test_link_calls(spark):
    rows = [
        (1, 0, "p", "add", '{"a": 1}', None), (1, 1, "q", "add", '{"a": 2}', ["r", "p"]), (1, 2, "r", "add", '{"a": -3}', ["p", "gone", "r"]),
        (1, 3, "s", "other", '{"a": 4}', []), (1, 4, "t", "add", "{oops", ["q"]), (1, 9, "p", "add", '{"a": 9}', None),
        (2, 0, "p", "add", '{"a": 1}', ["q"]), (2, 1, "q", "add", None, ["p"]), (2, 2, "z", "add", '{"b":["é"], "a":5}', []),
        (None, 0, "p", "add", "{}", None), (3, None, "n", None, "NaN", None),
    ]
    results = [(1, 5, "p", "one"), (1, 6, "p", "later"), (1, 5, "q", None), (2, 9, "z", ""), (7, 0, "x", "nobody asked")]
    found = tool_calls.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame(results, "conv long, turn long, call string, content string"), TOOLS)
    got = {(r["conv"], r["call"]): r for r in found.collect()}
    assert len(got) == 9
    place = {k: r["position"] for k, r in got.items()}
    assert place[1, "p"] == 0 and place[1, "s"] == 1 and place[1, "r"] == 2 and place[1, "q"] == 3 and place[1, "t"] == 4
    assert sorted(place[2, c] for c in "pqz") == [0, 1, 2] and place[2, "z"] == 0
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        (1, "p"): "ok", (1, "q"): "ok", (1, "r"): "invalid", (1, "s"): "unknown", (1, "t"): "invalid",
        (2, "p"): "cycle", (2, "q"): "cycle", (2, "z"): "ok", (3, "n"): "unknown",
    }
    assert got[1, "p"]["json"] == '{"after":[],"arguments":{"a":1},"id":"p","name":"add","result":"one"}'
    assert got[2, "z"]["json"] == '{"after":[],"arguments":{"a":5,"b":["é"]},"id":"z","name":"add","result":""}'
    for r in got.values():
        assert tool_calls.canonical(json.loads(r["json"])) == r["json"]


def plainly(calls, results):
    """What ``link_calls`` says, call by call in plain Python."""
    def least(rows):
        found = {}
        for conv, turn, call, *rest in rows:
            key = ((turn is not None, turn), [(x is not None, x) for x in rest])
            if conv is not None and call is not None and ((conv, call) not in found or key < found[conv, call][0]):
                found[conv, call] = key, turn, rest
        return {k: (turn, rest) for k, (_, turn, rest) in found.items()}

    named, answers, out = least(calls), least(results), {}
    for conv in {c for c, _ in named}:
        level, waits = {}, {call: {a for a in (r[2] or []) if a != call and (conv, a) in named} for (c, call), (_, r) in named.items() if c == conv}
        while free := [c for c, w in waits.items() if c not in level and all(level.get(a, len(level) + 9) <= max(level.values(), default=-1) for a in w)]:
            n = max(level.values(), default=-1) + 1
            level |= dict.fromkeys(free, n)
        order = sorted(waits, key=lambda c: (level.get(c, math.inf), named[conv, c][0] is not None, named[conv, c][0] or 0, c))
        for place, call in enumerate(order):
            turn, (name, arguments, _) = named[conv, call]
            try:
                value = json.loads(arguments or "{}")
                wrong = tool_calls.problems(value, TOOLS[name]) if name in TOOLS else []
                json.dumps(value, ensure_ascii=False, allow_nan=False).encode()
            except ValueError:
                value, wrong = arguments, ["$: not JSON"]
            status = "cycle" if call not in level else "unknown" if name not in TOOLS else "invalid" if wrong else "ok" if (conv, call) in answers else "unanswered"
            shown = {"after": named[conv, call][1][2] or [], "arguments": value, "id": call, "name": name, "result": answers.get((conv, call), (0, [None]))[1][0]}
            out[conv, call] = (turn, level.get(call), place, status, wrong, json.dumps(shown, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    return out


@pytest.mark.parametrize("most_in_task", [100_000, 40])
def test_link_calls_against_plain_python(spark, most_in_task):
    r = random.Random(7)
    calls, results = [], []
    for conv in range(6):
        ids = [f"c{k}" for k in range(r.choice([1, 5, 30]))]
        for k, call in enumerate(ids):
            after = r.choice([None, [], r.choices([*ids[:k], "gone"], k=2), r.choices(ids, k=1) if r.random() < 0.3 else ids[max(0, k - 1) : k]])
            arguments = r.choice(['{"a": 1}', '{"a": 2, "b": ["x"]}', '{"a": -1}', '{"a": true}', "", None, "{oops", '{"a":1,"b":["\\ud800"]}', '{"c": 1, "a": 3}', "x" * 50_000])
            calls += [(conv, r.choice([k, k // 2, None]), call, r.choice(["add", "add", "other", None]), arguments, after)] * r.choice([1, 1, 2])
            if r.random() < 0.7:
                results += [(conv, k, call, r.choice(["", "é", None, "text"])), (conv, k + 1, call, "later")]
    calls += [(9, k, f"c{k}", "add", '{"a": 1}', [f"c{k - 1}"]) for k in range(300 if most_in_task > 1000 else 3)]
    frames = spark.createDataFrame(calls, CALLS).repartition(3), spark.createDataFrame(results, "conv long, turn long, call string, content string")
    found = tool_calls.link_calls(*frames, TOOLS, most_in_task=most_in_task).collect()
    got = {(x["conv"], x["call"]): (x["turn"], x["level"], x["position"], x["status"], x["problems"], x["json"]) for x in found}
    assert len(found) == len(got) and got == plainly(calls, results)


def test_every_user_turn_is_a_call(spark):
    turns = [(1, 0, "assistant", "hello"), (1, 1, "user", "a b c"), (1, 2, "user", "two"), (1, 3, "tool", "x"), (1, 4, "assistant", "first"), (1, 5, "assistant", "second"), (1, 6, "user", None), (1, 6, "user", None)]
    calls, results = tool_calls.calls_from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    found = {r["call"]: (r["turn"], json.loads(r["json"])["result"]) for r in tool_calls.link_calls(calls, results, tool_calls.TURN_SCHEMAS).collect()}
    assert found == {"1:0": (1, None), "1:1": (2, "first"), "1:2": (6, None)}


def test_calls_from_turns(spark):
    r = random.Random(4)
    turns = []
    for conv in range(30):
        start = conv % 2
        if start:
            turns.append((conv, 0, "system", "be nice"))
        for k in range(r.randint(1, 6)):
            turns.append((conv, start + k, "user" if k % 2 == 0 else "assistant", r.choice(["", "two words", "some more words than that", "x\ty\nz " * 30])))
    turns += [(99, None, None, None), (None, 0, "user", "x")]
    calls, results = tool_calls.calls_from_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    found = tool_calls.link_calls(calls, results, tool_calls.TURN_SCHEMAS).collect()
    users = Counter(t[0] for t in turns if t[2] == "user" and t[0] is not None)
    assert Counter(x["conv"] for x in found) == users
    by_conv = defaultdict(dict)
    for x in found:
        by_conv[x["conv"]][x["call"]] = x
        value = json.loads(x["json"])
        assert value["arguments"]["words"] == len(__import__("re").split(r"\s+", value["arguments"]["text"]))
    for conv, group in by_conv.items():
        assert sorted(x["position"] for x in group.values()) == list(range(len(group)))
        for x in group.values():
            assert all(group[a]["position"] < x["position"] for a in json.loads(x["json"])["after"])
    calls, results = tool_calls.calls_from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert tool_calls.link_calls(calls, results, tool_calls.TURN_SCHEMAS).count() == 0


def toxic_table(spark, n=3000, seed=0):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    bad = ["vile", "rotten", "badmouthing", "badmouthed", "badmouths"]
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.12
        text = r.choices(words, k=r.choice([5, 40, 200]))
        if toxic:
            for _ in range(r.randint(1, 4)):
                text[r.randrange(len(text))] = r.choice(bad)
            toxic = any(b in text for b in bad)
        docs.append((i, " ".join(text)))
        if r.random() < 0.4:
            labels.append((i, 1, int(toxic)))
        docs[-1] += (toxic,)
    frame = spark.createDataFrame([d[:2] for d in docs] + [(n, None), (n + 1, ""), (None, "no id")], "doc_id long, text string")
    return frame, spark.createDataFrame([*labels, (5 * n, 1, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int"), {d[0]: d[2] for d in docs}


def test_toxicity(spark):
    docs, labels, truth = toxic_table(spark)
    found = toxicity.score_toxicity(docs, labels).collect()
    assert len(found) == docs.count()
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) toxic")
    again = toxicity.score_toxicity(docs.repartition(5), flipped).collect()
    assert {(r["doc_id"], r["score"]) for r in again} == {(r["doc_id"], r["score"]) for r in found}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in found)


def test_toxicity_without_examples(spark):
    docs, labels, _ = toxic_table(spark, 50)
    for d, y in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.where("toxic = 0"))):
        found = toxicity.score_toxicity(d, y).collect()
        assert len(found) == d.count() and not any(r["predicted"] for r in found)


def test_risk_does_not_fall_below_zero():
    rng = np.random.default_rng(0)
    rows = lambda n, p: [np.flatnonzero(rng.random(20) < p) for _ in range(n)]
    mark = lambda xs: [np.union1d(x, [19]) for x in xs]
    w, b = toxicity.train_nnpu(mark(rows(200, 0.3)), [x[x < 19] for x in rows(900, 0.3)] + mark(rows(100, 0.3)), 20, 0.1)
    assert w.argmax() == 19 and b + w[19] > 0 > b and np.abs(w[:19]).max() < w[19]


def stem_table(spark, n, seed=0):
    """Toxic documents repeat a stem in ever new words, one rare stem among them; clean ones hold such words once at most."""
    r = random.Random(seed)
    made = lambda k: "".join(r.choices("bcdfgklmnprst", k=k))
    docs, labels = [], []
    for i in range(n):
        toxic = r.random() < 0.12
        text = [made(5) for _ in range(30)]
        stem = "vraxo" if r.random() < 0.1 else "qualmi"
        text += [stem + made(3) for _ in range(r.randint(4, 8) if toxic else int(r.random() < 0.1))]
        docs.append((i, " ".join(text), stem, toxic))
        if r.random() < 0.4:
            labels.append((i, 1, int(toxic)))
    frame = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    return frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d[0]: d[2:] for d in docs}


@pytest.mark.parametrize("n", [4000, 16000])
def test_toxic_stems_count_at_any_size(spark, n):
    docs, labels, truth = stem_table(spark, n)
    held = [(r["predicted"], *truth[r["doc_id"]]) for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"]]
    for stem in ("qualmi", "vraxo"):
        hits = [p for p, s, toxic in held if toxic and s == stem]
        assert sum(hits) / len(hits) > 0.8, stem
    flagged = [p for p, _, toxic in held if not toxic]
    assert sum(flagged) / len(flagged) < 0.02


def test_toxicity_where_nearly_every_document_has_a_label(spark):
    docs, _, truth = toxic_table(spark)
    lone = next(i for i in truth if zlib.crc32(str(i).encode()) % 5)
    labels = spark.createDataFrame([(i, 1, int(y)) for i, y in truth.items() if i != lone], "doc_id long, quality int, toxic int")
    held = [r for r in toxicity.score_toxicity(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_all_text_flagged_is_never_the_least_risk():
    rng = np.random.default_rng(1)
    marked = [np.array([k]) if k < 3 else np.zeros(0, np.int64) for k in rng.integers(0, 5, 45)]
    plain = [np.array([k]) if k < 3 else np.zeros(0, np.int64) for k in rng.integers(0, 60, 480)]
    for l2 in toxicity.DECAYS:
        w, b = toxicity.train_nnpu(marked, plain, 3, 0.13, l2=l2)
        assert b < 0 < b + w.min()


def test_features_counted_together_are_those_of_each_text():
    r = random.Random(5)
    texts = [None, "", "ab ab AB abc", "été Été_x9 " * 5] + [" ".join("".join(r.choices("abcdé", k=r.randint(1, 10))) for _ in range(r.choice([0, 3, 60]))) for _ in range(300)]
    positive = np.array([r.random() < 0.3 for _ in texts])
    names, p, u = toxicity.feature_counts(texts, positive)
    for side, counts in ((True, p), (False, u)):
        want = Counter(f for t, q in zip(texts, positive, strict=True) if q == side for f in toxicity.text_features(t))
        assert {f: k for f, k in zip(names, counts.tolist(), strict=True) if k} == dict(want)
    assert toxicity.feature_counts([None, " "], np.array([True, False]))[0] == []
    some = set(r.sample(names, len(names) // 9)) | {"nowhere", "abc* 2"}
    known = toxicity.KnownFeatures(some)
    for t in [*texts, "x" * 100_000 + " abc"] * 2:
        assert known.of(t) == toxicity.text_features(t) & some


def plain_nnpu(positive, unlabelled, names, prior, l2, rounds=400, rate=0.1):
    """Non-negative PU training as the formula has it: dense rows, the step's direction by the sign of the clean risk, Adam."""
    dense = lambda rows: np.array([[f in x for f in names] + [True] for x in rows], float)
    xp, xu = dense(positive), dense(unlabelled)
    w = np.zeros(len(names) + 1)
    w[-1] = math.log(prior / (1 - prior))
    m, v, decay = np.zeros_like(w), np.zeros_like(w), np.append(np.full(len(names), l2), 0)
    for t in range(1, rounds + 1):
        sp, su = 1 / (1 + np.exp(-xp @ w)), 1 / (1 + np.exp(-xu @ w))
        clean = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        toward_clean = xu.T @ su / len(xu) - prior * xp.T @ sp / len(xp)
        grad = (prior * xp.T @ (sp - 1) / len(xp) + toward_clean if clean >= 0 else -toward_clean) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return dict(zip(names, w, strict=False)), w[-1]


def test_toxicity_against_plain_python(spark):
    """Repeated rows, a second text of an id and labels of both kinds among the rows."""
    docs, labels, truth = toxic_table(spark, 900, 4)
    more = [(8, "vile rotten vile"), (8, "vile rotten vile"), (9, ""), (11, "badmouths rotten")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(3)
    both = next(r["doc_id"] for r in labels.where("toxic = 1 and doc_id < 900").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5)
    labels = labels.unionByName(spark.createDataFrame([(both, 1, 0), (both, 1, 1)], labels.schema))
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 0
    texts = {}
    for r in docs.collect():
        if learns(r["doc_id"]):
            texts.setdefault(r["doc_id"], []).append(r["text"])
    texts = {i: min((t for t in ts if t is not None), default=None) for i, ts in texts.items()}
    known = [(r["doc_id"], r["toxic"]) for r in labels.collect() if learns(r["doc_id"]) and r["toxic"] is not None]
    prior = sum(y for _, y in known) / len(known)
    toxic_ids = sorted({i for i, y in known if y} & texts.keys())
    positive, unlabelled = [toxicity.text_features(texts[i]) for i in toxic_ids], [toxicity.text_features(t) for t in texts.values()]
    p, u = Counter(f for x in positive for f in x), Counter(f for x in unlabelled for f in x)
    tested = [f for f in p.keys() | u.keys() if p[f] + u[f] >= 5]

    def z(f):
        rate = (p[f] + u[f]) / (len(positive) + len(unlabelled))
        cells = [(p[f], len(positive) * rate), (len(positive) - p[f], len(positive) * (1 - rate)), (u[f], len(unlabelled) * rate), (len(unlabelled) - u[f], len(unlabelled) * (1 - rate))]
        return math.sqrt(max(0.0, 2 * sum(k * math.log(k / e) for k, e in cells if k)))

    bar = NormalDist().inv_cdf(1 - 0.05 / 2 / len(tested))
    names = sorted(f for f in tested if z(f) >= bar)
    weights, bias = plain_nnpu(positive, unlabelled, names, prior, 3e-4)
    assert "vile" in names and bias < 0 < weights["vile"]
    for r in toxicity.score_toxicity(docs, labels, decays=(3e-4,)).collect():
        g = bias + sum(weights.get(f, 0.0) for f in toxicity.text_features(r["text"]))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, g)))), abs=1e-4)
