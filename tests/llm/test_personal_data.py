"""Personal data: the base against plain regular expressions, the lattice against all ways, the model on held-out writing."""

import hashlib
import itertools
import random
import re
import time

import pytest

from recordprofile.llm import queries
from recordprofile.llm.personal_data import KINDS, Model, base_spans, candidates, islands, luhn, personal_data, span_text, train

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                True if kind == 0 else all(int(x) <= 255 for x in m[0].split(".")) if kind == 1
                else 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15
            )
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_is_what_the_patterns_find():
    rng = random.Random(4)
    for _ in range(20_000):
        letters = rng.choice(["ab.@-", "12.0", "1234567890 -", "+1 (2)-.3", "a@.1+ 2-(", "é@a.b"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain(text), text
    assert luhn("4111111111111111") and not luhn("4111111111111112")


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "a@", "+1 ", " ", "(", "a.", "+1" + " " * 50])
def test_long_texts_take_linear_time(piece):
    began = time.perf_counter()
    for text in (piece * (600_000 // len(piece)), "+" + piece * (300_000 // len(piece))):
        base_spans(text)
        islands(text)
    assert time.perf_counter() - began < 20


def test_best_way_is_the_best_of_all_ways():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice("0123456789 .-(+") for _ in range(26))
        made = [(s, f) for a, b in islands(text) for s, f in candidates(text, a, b)]
        names = {f"{KINDS[s[0]]}: {f}" for s, fs in made for f in fs}
        model = Model({f: rng.uniform(-1, 1) for f in sorted(names)})
        for a, b in islands(text):
            taken = [(a + 3, a + 6)] if rng.random() < 0.3 else []
            worth = {}
            for s, f in candidates(text, a, b):
                if not any(x < s[2] and s[1] < y for x, y in taken):
                    worth[s] = max(model.score(s[0], f), worth.get(s, -9))
            positive = sorted(s for s, x in worth.items() if x > 0)[:14]
            if len(positive) < len([s for s, x in worth.items() if x > 0]):
                continue
            ways = (w for n in range(len(positive) + 1) for w in itertools.combinations(positive, n))
            apart = (w for w in ways if all(p[2] <= q[1] or q[2] <= p[1] for p, q in itertools.combinations(w, 2)))
            best = max(sum(worth[s] for s in w) for w in apart)
            assert sum(worth[s] for s in model.best(text, a, b, taken)) == pytest.approx(best)


def test_training_follows_the_likelihood():
    span, other = (3, 0, 4), (2, 0, 4)
    model = train([([(span, ["x"]), (other, ["x"])], {span}, 1.0)] * 4 + [([(span, ["y"])], set(), 1.0)] * 4)
    assert model.score(3, ["x"]) > 1 > 0 > model.score(3, ["y"]) and model.score(2, ["x"]) < 0
    assert train([]).weights == {}


WORDS = "anea thon ereti leai onhe wiet der und para que heesth orin".split()


def passages(rng, n, base):
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def one():
        kind = rng.randrange(4)
        name, host, net = f"{rng.choice(WORDS)}.{digits(2)}", f"mail{digits(1)}.example.{rng.choice(['com', 'org'])}", [str(rng.randrange(256)) for _ in range(4)]
        area, last = digits(3), digits(4)
        if base:
            return kind, (f"{name}@{host}", ".".join(net), card(), f"+1 ({area}) 555-{last}")[kind]
        c = card()
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)")])
        forms = (name + at + host.replace(".", dot), "[.]".join(net), rng.choice([".", "/"]).join(c[k : k + 4] for k in range(0, 16, 4)), rng.choice([f"({area}) 555-{last}", f"{area}-555-{last}", f"{area}.555.{last}"]))
        return kind, forms[kind]

    for _ in range(n):
        kind, span = one()
        left, right = (" ".join(rng.choice(WORDS) for _ in range(rng.randint(2, 9))) for _ in range(2))
        yield kind, f"{left} ", span, f" {right}."


CLEAN = (
    "on 2024-01-15 we met at noon. dot", "it cost 1,234,567.89 in all", "version 1.2.3.4567 is out", "isbn 978-3-16-148410-0 is a book", "the years 1990-1995 and 2001-2004",
    "of 1 234 567 890 people", "order 4539578763621487 was late", "see 300[.]1[.]1[.]1 there", "we look at home. And so", "pi is 3.14159265358979",
)


def test_other_forms_are_found_and_clean_text_is_left_alone(spark, make_docs):
    rng = random.Random(11)
    known, unseen = list(passages(rng, 400, True)), list(passages(rng, 200, False))
    texts = ["".join(p[1:]) for p in known + unseen] + [" ".join(rng.choice(WORDS) for _ in range(12)) for _ in range(100)] + list(CLEAN)
    found = {r["doc_id"]: r for r in personal_data(make_docs(texts)).collect()}
    hit = wrong = 0
    for i, (kind, left, span, _) in enumerate(known + unseen):
        got = [(s["kind"], s["start"], s["end"]) for s in found[i]["spans"]]
        want = (KINDS[kind], len(left), len(left) + len(span))
        if i < len(known):
            assert want in got
        else:
            hit += want in got
            wrong += len(got) - (want in got)
    assert hit >= 0.9 * len(unseen) and wrong <= 0.1 * len(unseen)
    assert [t for i, t in enumerate(texts) if i >= len(known + unseen) and found[i]["spans"]] == []


def test_awkward_documents(spark, awkward, make_docs, tmp_path):
    extra = make_docs([(20, "é mail x@y.de, x@y.de +4915112345678 and 4111 1111 1111 1111 1111 4111111111111111", "en", "a", 1), (21, "1 " * 30_000 + "퟿ 10.0.0.1", "", "", 0)])
    docs = awkward.unionByName(extra).selectExpr("*", "'clash' as base", "1 as spans", "2 as id", "3 as piece")
    rows = {(r["doc_id"], r["text"]): r["text"] or "" for r in docs.collect()}
    got = personal_data(docs).select("doc_id", span_text("base").alias("base"), span_text("spans").alias("spans"), "spans").collect()
    assert len(got) == docs.count()
    want = sorted((str(i), ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(t))) for (i, t) in rows.items()) if len(rows) == docs.count() else None
    text = {i: t for (i, _), t in rows.items()}
    for r in got:
        base = [f"{KINDS[k]}:{a}:{b}" for k, a, b in plain(text[r["doc_id"]])]
        assert r["base"] == ",".join(base) and set(base) <= set(filter(None, r[2].split(",")))
    assert want is None or len(want) == len(got)
    assert personal_data(docs.limit(0)).count() == 0
    nothing = personal_data(make_docs(["no data (017) 555-7713", None])).collect()
    assert all(r["spans"] == [] for r in nothing)


def test_query_returns_the_digest(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_personal_data(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        base = plain(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        order = [(KINDS.index(k), int(a)) for k, a, _ in spans]
        assert order == sorted(order) and {f"{KINDS[k]}:{a}:{b}" for k, a, b in base} <= {":".join(s) for s in spans}
