"""Spelling variants against plain Python over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from recordprofile.llm.spelling import Acceptor, near_words, spelling_forms, spelling_variants


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            found[word] += len(word) >= 6
    return {w: n for w, n in found.items() if n >= 5}


def plain_forms(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def shown(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_composition_accepts_just_the_pairs():
    rng = random.Random(2)
    for letters, count in (("ab", 40), ("abc", 60), ("aé", 30)):
        for _ in range(30):
            words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))) for _ in range(count)})
            got = [frozenset(p) for p in Acceptor(words).one_edit()]
            assert len(got) == len(set(got))
            assert set(got) == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}


def test_acceptor_is_minimal():
    # tap, taps, top, tops: four states after the first letter merge to those of one word.
    assert len(Acceptor(["tap", "taps", "top", "tops"]).final) == 5
    assert list(Acceptor([]).one_edit()) == []


@pytest.mark.parametrize("most", [3, 4096])
def test_partitions_lose_no_pair(spark, most):
    rng = random.Random(most)
    # A third of the words share a long first half, and some share all but one letter.
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 10))) for _ in range(150)}
    words |= {"common" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(80)} | {f"lett{c}r" for c in "abcdefgh"}
    table = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(words))] + [(None, 9), ("", 9)], "word string, n long")
    got = [(r["word"], r["near"]) for r in near_words(table, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_long_words(spark):
    long = "ab" * 3000
    words = [long, long + "a", long[:5999], "x" + long[1:], "a" * 5000, "a" * 5001, long[:1500] + "z" + long[1500:]]
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(words.index(r["word"]), words.index(r["near"])) for r in near_words(table).collect()}
    assert got == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and one_edit(a, b)}


def test_forms_follow_to_the_root(spark):
    words = {"letter": 1000, "lettre": 7, "leter": 30, "letterr": 200, "letterrr": 40, "letterrrr": 8, "latter": 200, "ketter": 900, "ketters": 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert shown(spelling_forms(table)) == plain_forms(words)
    assert ("letterrrr", "letterrr", "letter", 8, 1, 40) in plain_forms(words)


def test_whole_documents(spark, make_docs, awkward):
    rng = random.Random(7)
    stems = ["Étranger", "receive", "Recieve", "separate", "colour", "naïveté", "straßen", "occurred"]
    texts = [" ".join(rng.choice(stems) if rng.random() < 0.9 else rng.choice(stems)[:-1] for _ in range(200)) for _ in range(40)]
    docs = make_docs([(k, t, "en", "a", 1) for k, t in enumerate(texts)] + [(None, " ".join(["Receives7receives"] * 4), None, None, None), (3, texts[3], "en", "a", 1), (9, None, "en", "a", 0), (10, "", "", "", 0)])
    docs = docs.unionByName(awkward)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    words = plain_words(rows)
    assert shown(spelling_variants(docs.selectExpr("*", "1 as word", "2 as n"))) == plain_forms(words) and len(words) > 12
    assert spelling_variants(docs.limit(0)).count() == 0
