import random
import re
from collections import Counter

import corpus_pipeline
from recordprofile.llm.common import table
from tests.llm.test_basic_operators import check_packing, filled
from tests.llm.test_pairs import brute, brute_lines


def test_stages_chain_and_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == first.columns, name
        assert out.dtypes == first.dtypes, name
        if name in ("toxicity", "line_dedup", "jaccard_join"):
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    packed = corpus_pipeline.run(spark, sf_dir)
    sums = packed.groupBy("sequence_id").sum("length")
    assert sums.where("`sum(length)` > 1024").count() == 0


def plain_rows():
    """Copies, near copies, shared lines, empty, null and long texts, a null source."""
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    lines = lambda n: "\n".join(" ".join(r.choices(words, k=12)) for _ in range(n))
    texts = [lines(r.randint(1, 12)) for _ in range(25)]
    for t in texts[:8]:
        texts += [t, t.replace("w1", "v1", 3), "shared line of many documents here\n" + t.replace("w2", "v2", 2)]
    texts += [None, "", " \n ", "shared line of many documents here", lines(400)]
    r.shuffle(texts)
    return [(3 * i + 1, t, "en", r.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]


def test_chain_against_brute_force(spark, make_docs, tmp_path):
    sf_dir, rows = str(tmp_path), plain_rows()
    make_docs(rows).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), table(spark, sf_dir, "documents")
    # No toxic example, so nothing is toxic.
    docs = stages["toxicity"](spark, docs, sf_dir)
    assert Counter(map(tuple, docs.collect())) == Counter(rows)
    keep = brute_lines([(d, t) for d, t, *_ in rows])
    cut = {}
    for d, t, *_ in rows:
        left = [x for k, x in enumerate((t or "").split("\n")) if keep[d, k] == (d, k)]
        whole = len(left) == len((t or "").split("\n"))
        if whole or "\n".join(left).strip():
            cut[d] = t if whole else "\n".join(left)
    docs = stages["line_dedup"](spark, docs, sf_dir)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()} == {d: (t, None if t is None else len(t)) for d, t in cut.items()}
    # Documents link by what is left of them and by what they were.
    group = {d: d for d in cut}
    links = [(d, c) for side in ([*cut.items()], [(d, t) for d, t, *_ in rows if d in cut]) for d, (_, c) in brute(side).items()]
    while any(group[a] != group[b] for a, b in links):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    docs = stages["jaccard_join"](spark, docs, sf_dir)
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {d: t for d, t in cut.items() if group[d] == d}
    assert len({*group.values()}) < len(cut)
    given = {r["doc_id"]: (r["source"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    docs = stages["mixing"](spark, docs, sf_dir)
    mixed = docs.collect()
    sizes, taken = Counter(), Counter()
    for s, w in given.values():
        sizes[s] += len(w)
    for r in mixed:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert w == given[r["doc_id"]][1][: len(w)] and r["n_chars"] in (len(r["text"]), None)
        taken[r["source"]] += len(w)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(dict(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    packed = stages["packing"](spark, docs, sf_dir).collect()
    check_packing(packed, 1024)
    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += len(encode(r["text"], add_special_tokens=False).ids) + 1
    assert tokens == want
