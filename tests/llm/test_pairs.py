"""Jaccard join and line dedup against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from recordprofile.llm import common, jaccard_join, line_dedup, packing, toxicity


def near_copies(seed=0, bases=12, each=12, length=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for k in range(bases):
        base = r.choices(words, k=length)
        for _ in range(each):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                text[r.randrange(len(text))] = r.choice(words)
            out.append((" " if r.random() < 0.5 else "\n").join(text))
    r.shuffle(out)
    return out


def gram_set(text, n=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, threshold=0.8):
    grams = [gram_set(t) for _, t in rows]
    links, parent = Counter(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(grams[i] & grams[j])
        if common and common / len(grams[i] | grams[j]) >= threshold:
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        smallest[root(i)] = min(smallest.get(root(i), d), d)
    return {d: (links[i], smallest[root(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [256, 16])
def test_jaccard_join(make_docs, block):
    texts = [*near_copies(), *near_copies(1, bases=1, each=60), None, "", "one two", "One, two!", " \n ", "x" * 50_000]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    docs = make_docs([(i, t, None, None, None) for i, t in rows]).repartition(5)
    found = jaccard_join.similar_documents(docs, block=block)
    got = {r["doc_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    assert got == brute(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found.collect())
    kept = {r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()}
    assert kept == {d for d, (_, c) in got.items() if d == c}


def test_jaccard_join_of_awkward_rows(make_docs, awkward):
    from pyspark.sql import functions as F

    found = jaccard_join.similar_documents(awkward.withColumns({"REP": F.lit(1), "class": F.lit(2)}))
    rows = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == awkward.count()
    assert rows[2]["component_id"] == 1 and rows[1]["n_links"] == 1
    assert rows[8]["component_id"] == 7 and rows[None]["component_id"] is None and rows[3]["n_links"] == 0
    assert jaccard_join.similar_documents(make_docs([])).count() == 0


def test_jaccard_join_of_repeated_ids_and_earlier_texts(make_docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = lambda t: t.replace("30", "x")
    docs = make_docs([(5, a, None, None, None), (5, b, None, None, None), (7, near(a), None, None, None), (9, near(b), None, None, None), (9, near(b), None, None, None), (11, "left over", None, None, None), (13, "other rest", None, None, None)])
    found = sorted((r["doc_id"], r["n_links"], r["component_id"]) for r in jaccard_join.similar_documents(docs).collect())
    assert found == [(5, 1, 5), (5, 2, 5), (7, 1, 5), (9, 2, 5), (9, 2, 5), (11, 0, 11), (13, 0, 13)]
    assert [r["doc_id"] for r in jaccard_join.one_of_each(docs).orderBy("doc_id").collect()] == [5, 5, 11, 13]
    # Texts before a cut link what is left of them; of ids that are gone they link nothing.
    earlier = make_docs([(11, "left over " + a, None, None, None), (13, "other rest " + a, None, None, None), (99, a, None, None, None), (5, a, None, None, None)])
    assert [r["doc_id"] for r in jaccard_join.one_of_each(docs, earlier=earlier).orderBy("doc_id").collect()] == [5, 5]
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_pruning_keeps_what_it_should():
    least = jaccard_join.least_agreeing(0.8, 1e-6)
    assert list(least) == list(range(16, 129, 16)) and all(m < n * 0.8 for n, m in least.items())
    base = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    near = base.copy()
    near[:100] += np.uint64(1)
    values = np.stack([jaccard_join.minhash(x) for x in (base, near, base + np.uint64(7))])
    assert list(zip(*jaccard_join.surviving_pairs(values, values, least, same=True), strict=True)) == [(0, 1)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_lines(rows):
    lines = []
    for d, t in sorted(rows, key=lambda r: r[0]):
        lines += [((d, k), x.strip(" \t\r\f\v")) for k, x in enumerate((t or "").split("\n"))]
    out = {}
    for i, (place, line) in enumerate(lines):
        out[place] = place
        for other, x in lines[:i] if line else []:
            fuzzy = min(len(x), len(line)) > 0 and abs(len(x) - len(line)) <= 1
            if x == line or (fuzzy and distance(x, line) <= 1):
                out[place] = other
                break
    return out


def edited_lines(seed):
    r = random.Random(seed)
    bases = ["".join(r.choices("abcd é", k=r.choice([1, 2, 5, 9, 10, 14, 30]))).strip() for _ in range(12)] + ["aaaaaaaaaaaa", "abababababab"]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(r.randint(0, 5)):
            s = list(r.choice(bases))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(s) + 1)
                s[k : k + r.choice([0, 1])] = r.choices("abé", k=r.choice([0, 1]))
            lines.append(r.choice(["", " ", "\t"]) + "".join(s))
        docs.append((d * 2, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup(make_docs, seed):
    rows = [*edited_lines(seed), (1001, None), (1003, ""), (1005, "\n\n"), (1007, "long " * 20_000 + "r"), (1009, "long " * 20_000 + "s")]
    found = line_dedup.dedup_lines(make_docs([(d, t, None, None, None) for d, t in rows]).repartition(3)).collect()
    got = {(r["doc_id"], r["line_no"]): (r["keep_id"], r["keep_no"]) for r in found}
    want = brute_lines([r for r in rows if r[0] not in (1007, 1009)])
    want |= {(1007, 0): (1007, 0), (1009, 0): (1007, 0)}
    assert got == want
    assert all(r["kept"] == (got[r["doc_id"], r["line_no"]] == (r["doc_id"], r["line_no"])) for r in found)


def test_documents_without_repeated_lines(make_docs, awkward):
    rows = [(1, "A line of some length.\nshared line here\n\nthe end of one"), (2, "shared line here"), (3, "own line here\n shared line here!"), (4, "")]
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows])
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 3: ("own line here", 13), 4: ("", 0)}
    assert line_dedup.without_repeated_lines(make_docs([])).count() == 0
    found = line_dedup.dedup_lines(awkward)
    assert found.where("doc_id is null and kept").count() == 1
    # Line 8 differs from line 7 by case in two places: it stays. Both rows of document 7 stay.
    assert found.where("doc_id in (7, 8) and kept").count() == 3


def test_rows_that_share_an_id_lose_their_own_lines_only(make_docs):
    rows = [(1, "shared line number one"), (7, "shared line number one\nkeep me"), (7, "a wholly unique line\nother words here"), (7, "a wholly unique line\nother words here"), (9, "keep me!\n\nab\nb")]
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows])
    out = sorted((r["doc_id"], r["text"]) for r in line_dedup.without_repeated_lines(docs).collect())
    assert out == [(1, rows[0][1]), (7, rows[2][1]), (7, rows[2][1]), (7, "keep me"), (9, "\nab")]


def test_a_hot_line_and_blank_lines(make_docs):
    rows = [(i, f"the same line everywhere\n\nown line of this document {i * 7919}\n \nx") for i in range(3000)]
    docs = make_docs([(d, t, "en", "s", len(t)) for d, t in rows]).repartition(4)
    found = line_dedup.dedup_lines(docs).groupBy("line_no", "kept").count().collect()
    counts = {(r["line_no"], r["kept"]): r["count"] for r in found}
    assert counts[0, True] == 1 and counts[4, True] == 1 and counts[1, True] == counts[3, True] == 3000 and (1, False) not in counts


def test_pieces_hold_few_bytes():
    texts = ["a" * 100, None, "", "é" * 5000, "b" * 300, None] * 50
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    pieces = list(common.in_pieces(iter([batch, batch.slice(0, 0)]), 1, most_bytes=2000))
    assert pa.Table.from_batches(pieces).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()[:-1]) <= 2000 for p in pieces)


@pytest.mark.parametrize("same", [True, False])
def test_pairs_compared_in_parts_survive_alike(monkeypatch, same):
    rng = np.random.default_rng(3)
    left = np.where(rng.random((40, 128)) < 0.9, 7, rng.integers(0, 9, (40, 128))).astype(np.uint32)
    right = left if same else left[::-1].copy()
    least = jaccard_join.least_agreeing(0.8, 1e-6)
    whole = jaccard_join.surviving_pairs(left, right, least, same=same)
    monkeypatch.setattr(jaccard_join, "PAIRS", 7)
    parts = jaccard_join.surviving_pairs(left, right, least, same=same)
    assert len(whole[0]) and all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True))


def test_words_share_their_bases():
    known = toxicity.KnownFeatures(toxicity.KnownFeatures().of("stupid words stupidly said"))
    first, second = known._bases("stupid"), known._bases("stupidly")
    shared = set(first) & set(second)
    assert shared and {id(b) for b in first if b in shared} == {id(b) for b in second if b in shared}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_without_lines_are_made_once(make_docs):
    docs = make_docs([(1, "shared line here", "en", "s", 16), (2, "shared line here\nown words", "en", "s", 26)])
    assert plan_of(line_dedup.without_repeated_lines(docs)).count("ArrowEvalPython [") == 1


@pytest.mark.parametrize("repeated", [False, True])
def test_ngrams_are_sorted_for_repeated_rows_only(make_docs, monkeypatch, repeated):
    rows = [(i, t, None, None, None) for i, t in enumerate(near_copies(2, bases=3, each=6))]
    docs = make_docs(rows + rows[:4] * repeated)
    plans = []
    monkeypatch.setattr(jaccard_join, "durable", lambda df: (plans.append((df.columns, plan_of(df))), common.durable(df))[1])
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_documents(docs).collect()}
    assert found == {d: c for d, (_, c) in brute([r[:2] for r in rows]).items()}
    wide = [plan for columns, plan in plans if "grams" in columns]
    assert len(wide) == 1 + repeated and "key=[rep" not in wide[0]


def test_rows_of_the_driver_start_no_python_workers(make_docs, monkeypatch):
    from pyspark import RDD

    docs = make_docs([f"some words {'and some others ' * (i % 7)}{i}" for i in range(60)])
    labels = docs.sparkSession.createDataFrame([(i, int(i % 7 == 3)) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(RDD, "_to_java_object_rdd", lambda self: pytest.fail("rows pass through Python workers"))
    assert packing.pack_documents(docs).count() == 60
    assert toxicity.score_toxicity(docs, labels).count() == 60
