"""Token counts, packing, exact dedup, mixing and sharding against plain Python on small tables."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordprofile.llm import exact_dedup, mixing, packing, sharding, token_counts
from recordprofile.llm.bpe import Bpe

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts(n, seed=0):
    r = random.Random(seed)
    words = ["the", "Of", "and", "zébre", "x1", "—", "tion", "ereading", "\n", "日本"]
    return [" ".join(r.choices(words, k=r.choice([0, 1, 5, 40, 200, 1500]))) for _ in range(n)]


def test_both_forms_of_the_vocabulary_agree(tokenizer):
    bpe, r = Bpe(), random.Random(3)
    letters = [chr(c) for c in range(0x260)] + ["   ", "\n\n", "'s", "'LL", " a", "<|endoftext|>", " 9", "　", "é"]
    for _ in range(3000):
        text = "".join(r.choices(letters, k=r.randint(0, 12)))
        assert bpe.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_length_report(make_docs, tokenizer, spark):
    rows = [*texts(60), None, ""]
    lengths = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in rows]
    histogram = token_counts.length_histogram(make_docs(rows))
    report = {r["length"]: r for r in token_counts.length_report(histogram).collect()}
    assert sorted(report) == sorted(set(lengths))
    for limit, r in report.items():
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_within"] == sum(n <= limit for n in lengths)
        assert r["tokens_over"] == sum(n for n in lengths if n > limit)
        assert r["truncated_total"] == sum(min(n, limit) for n in lengths)
        assert r["quantile"] == pytest.approx(sum(n <= limit for n in lengths) / len(lengths))
    asked = [0, 3, 17, 100, 10**6]
    for r in token_counts.answers(histogram, spark.createDataFrame([(x,) for x in asked], "limit long")).collect():
        assert r["truncated_total"] == sum(min(n, r["limit"]) for n in lengths)
        assert r["docs_over"] == sum(n > r["limit"] for n in lengths)
    none = token_counts.length_histogram(make_docs([]))
    assert token_counts.length_report(none).count() == 0
    assert [tuple(r) for r in token_counts.answers(none, spark.createDataFrame([(5,), (5,), (None,)], "limit long")).collect()] == [(5, 0, 0)] * 2


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_keeps_every_id(make_docs, awkward, tokenizer):
    docs = make_docs(texts(80, 5)).unionByName(awkward)
    packed = packing.pack_documents(docs, with_ids=True)
    rows = packed.collect()
    total = sum(r["length"] for r in rows)
    used = check_packing(rows, 1024)
    assert -(-total // 1024) <= used <= -(-total // 1024) * 1.1 + 1
    by_doc = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
    for d in docs.where("doc_id is not null and doc_id <> 7 and doc_id > 9").collect():
        parts = sorted((r for r in by_doc[d["doc_id"]] if r["doc_id"] > 10), key=lambda r: r["piece"])
        if not parts:
            continue
        whole = b"".join(p["ids"] for p in parts)
        assert np.frombuffer(whole, "<u4").tolist() == [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        assert [p["start"] for p in parts] == np.cumsum([0, *[p["length"] for p in parts[:-1]]]).tolist()
        assert all(p["length"] == 1024 for p in parts[1:])
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in rows:
        assert joined[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == r["ids"]


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_the_histogram_tightly(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 100, 1024])
    sizes = Counter(r.randint(1, r.choice([3, capacity // 3, capacity])) for _ in range(r.choice([1, 50, 3000])))
    packed, bins = Counter(), 0
    for count, items in packing.plan_bins(dict(sizes), capacity):
        assert sum(s * n for s, n in items) <= capacity
        assert sum(n for s, n in items if 3 * s > capacity) <= 2
        bins += count
        for s, n in items:
            packed[s] += n * count
    assert packed == sizes
    # First-fit decreasing, item by item, needs as many.
    gaps = []
    for s in sorted(sizes.elements(), reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= s), None)
        if k is None:
            gaps.append(capacity - s)
        else:
            gaps[k] -= s
    assert bins <= len(gaps) + 1


def test_packing_of_clashing_columns(spark):
    rows = [(i, 100 + i % 400, -1, -2, "x", "y") for i in range(500)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, __rank long, sequence_id long, __SIZE string, offset string")
    packed = packing.pack_sized(pieces, order=["doc_id"]).collect()
    assert len(packed) == 500 and all(r["__rank"] == -1 and r["__SIZE"] == "x" for r in packed)
    check_packing(packed, 1024)


def test_pieces_beyond_the_capacity_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack_sized(spark.createDataFrame([(1, 2000)], "doc_id long, length long"), order=["doc_id"])


def expected_dedup(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(LOWER)].append(r["doc_id"])
    out = []
    for r in rows:
        t = (r["text"] or "").translate(LOWER)
        keep = max((i for i in groups[t] if i is not None), default=None)
        out.append((r["doc_id"], keep, len(groups[t]), r["doc_id"] == keep, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("max_bits", "bits_per_row"), [(1 << 30, 16), (1 << 15, 16), (1 << 15, 800)])
def test_exact_dedup(make_docs, awkward, max_bits, bits_per_row):
    copies = [r for t in texts(40, 9) for r in [t] * random.Random(t).randint(1, 4)]
    docs = awkward.unionByName(make_docs([(100 + i, t, "en", "s", 1) for i, t in enumerate(copies)])).repartition(5)
    options = {"max_bits": max_bits, "bits_per_row": bits_per_row}
    found = exact_dedup.exact_dedup(docs, **options)
    narrow = exact_dedup.decisions(docs, **options)
    assert Counter(map(tuple, narrow.collect())) == Counter(map(tuple, found.select(narrow.columns).collect()))
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found.collect())
    assert got == expected_dedup(docs.collect())
    assert set(docs.columns) < set(found.columns)


def test_exact_dedup_of_nothing_and_with_clashing_columns(make_docs, awkward):
    from pyspark.sql import functions as F

    assert exact_dedup.exact_dedup(make_docs([])).count() == 0
    more = awkward.withColumns({"__h": F.lit(1), "__bits": F.lit(2), "kept": F.lit(3), "__Segment": F.lit(4)})
    assert exact_dedup.exact_dedup(more).count() == awkward.count()


def filled(sizes, weights, share, most):
    """Reshare the excess again and again."""
    targets = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        over = 0.0
        for s in list(open_):
            targets[s] += left * weights[s] / w
        for s in list(open_):
            if targets[s] >= most * sizes[s]:
                over += targets[s] - most * sizes[s]
                targets[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return targets


def test_mixing(make_docs, awkward):
    r = random.Random(1)
    docs = make_docs([(i, t, "en", r.choice(["a", "b", "z", "é", None] + ["hot"] * 6), 0) for i, t in enumerate(texts(300, 2))]).unionByName(awkward)
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for x in rows:
        assert x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or ""))
        assert 0 <= x["taken"] <= 2 * x["size"]
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
        target[x["source"]] = x["target"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = filled(dict(sizes), {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert target[s] - 2 <= taken[s] <= target[s] + 1e-6
    assert all(x["source_size"] == sizes[x["source"]] for x in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    # Columns under the names that the mix gives keep what they hold.
    clash = docs.selectExpr("*", "99 size", "98 target", "97 key", "96 plan_s", "95 C0")
    assert {tuple(x)[-5:] for x in mixing.mixed_documents(clash).collect()} == {(99, 98, 97, 96, 95)}
    assert mixing.mix(clash).columns == [*docs.columns, "key", "plan_s", "C0", "size", "source_size", "target", "taken"]
    narrow = mixing.mixed_sizes(docs)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, mixing.mix(docs).select(narrow.columns).collect()))
    words = Counter()
    for x in out.collect():
        words[x["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", x["text"]))
    assert +words == +taken
    assert mixing.mix(make_docs([])).count() == 0
    assert {x["taken"] for x in mixing.mix(make_docs([None, "", " "])).collect()} == {0}


def test_sharding(make_docs, awkward):
    docs = make_docs(texts(900, 4)).unionByName(awkward)
    rows = sharding.kd_shards(docs, shards=16).collect()
    assert len(rows) == docs.count()
    bytes_, slots = Counter(), defaultdict(list)
    for r in rows:
        bytes_[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    largest = max(r["size"] for r in rows)
    assert set(bytes_) == set(range(16)) and max(bytes_.values()) - min(bytes_.values()) <= 4 * largest
    assert sharding.kd_shards(make_docs([])).count() == 0


def test_sharding_of_equal_points_and_hot_groups(make_docs):
    same = make_docs([(i, "one and the same text", "en", "s", 21) for i in range(4000)])
    sizes = Counter(r["shard"] for r in sharding.kd_shards(same, shards=16).collect())
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 60
    # Groups of a third of a shard, one of nearly a whole one, and one that no shard can hold.
    r = random.Random(3)
    filler = [f"filler {i} " * r.randint(3, 9) for i in range(1500)]
    each = sum(map(len, filler)) // 6
    groups = [f"group {k} " * 10 for k in range(6)]
    rows = filler + [g for k, g in enumerate(groups) for _ in range(each // 3 // len(g))] + ["nearly a shard " * 9] * (each // 135) + ["too large for one " * 20] * (each * 3 // 360)
    by_shard, of = Counter(), defaultdict(set)
    for x in sharding.kd_shards(make_docs(rows), shards=8).collect():
        by_shard[x["shard"]] += x["size"]
        of[x["text_crc32"]].add(x["shard"])
    whole = {zlib.crc32(t.encode()) for t in rows if "too large" not in t}
    assert all(len(of[c]) == 1 for c in whole) and len(of[zlib.crc32(rows[-1].encode())]) > 1
    assert len(by_shard) == 8 and max(by_shard.values()) < 1.03 * min(by_shard.values())
    pairs = make_docs([(i, f"text of a pair {i // 2}", "en", f"s{i % 5}", 20) for i in range(4000)])
    placed = defaultdict(set)
    for r in sharding.kd_shards(pairs, shards=5).collect():
        placed[r["text_crc32"]].add(r["shard"])
    assert {len(s) for s in placed.values()} == {1}


@pytest.mark.parametrize("shards", [8, 5])
def test_shards_are_the_leaves_of_a_plain_tree(make_docs, shards):
    """The tree by recursion: the widest dimension is cut where the bytes on its low side come nearest to its part of the shards."""
    r = random.Random(11)
    docs = make_docs([(7 * i, f"text {i} " * r.randint(1, 60), r.choice(["en", "de"]), r.choice(["a", "b", "c"]), n) for i, n in enumerate(r.sample(range(1000), 400))])
    unit = lambda *c: sharding._unit(F.xxhash64(*c))
    rows = docs.select("doc_id", "n_chars", (F.octet_length("text") + 1).alias("size"), unit("source").alias("s"), unit("lang").alias("l"), unit("doc_id", F.xxhash64("text"), F.lit("tie")).alias("tie")).collect()
    scaled = lambda c: lambda x, at=sorted(q[c] for q in rows): (x[c] - at[0]) / (at[-1] - at[0])
    length, place = scaled("n_chars"), scaled("doc_id")
    points = [((length(x), place(x), x["s"], x["l"]), x["tie"], x["size"], x["doc_id"]) for x in rows]
    want = {}

    def cut(points, first, n):
        if n == 1:
            want.update((p[3], first) for p in points)
            return
        wide = [max(p[0][d] for p in points) - min(p[0][d] for p in points) for d in range(4)]
        dim = wide.index(max(wide))
        points = sorted(points, key=lambda p: (p[0][dim], p[1]))
        below, k, part = 0, 0, sum(p[2] for p in points) * (n // 2) / n
        while below + points[k][2] < part:
            below, k = below + points[k][2], k + 1
        k += part - below > points[k][2] / 2
        cut(points[:k], first, n // 2)
        cut(points[k:], first + n // 2, n - n // 2)

    cut(points, 0, shards)
    assert {x["doc_id"]: x["shard"] for x in sharding.kd_shards(docs, shards=shards).collect()} == want


def test_shards_of_any_ids(make_docs, awkward):
    from pyspark.sql import functions as F

    named = make_docs(texts(300, 8)).unionByName(awkward).withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id")).withColumn("slot", F.lit("clash"))
    found = sharding.with_shards(named, shards=None, target_bytes=20_000)
    rows = found.collect()
    assert found.columns == [*named.drop("slot").columns, "shard", "slot"] and len(rows) == named.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    total = sum(len((r["text"] or "").encode()) + 1 for r in rows)
    assert set(slots) <= set(range(-(-total // 20_000))) and len(slots) > 5 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_large_groups_go_to_the_emptiest_shard():
    where, left = sharding.place_groups([9, 8, 5, 4, 1], 2, 12)
    assert where == [0, 1, None, 1, 0] and left == [2, 0]


def test_sifted_rows_keep_every_wanted_key(spark):
    from recordprofile.llm.common import durable, sifted

    rows = spark.range(40_000).selectExpr("id", "id AS __h", "cast(id AS string) AS __bits").unionByName(spark.createDataFrame([(None, 1, "x")], "id long, __h long, __bits string"))
    wanted = durable(spark.range(0, 40_000, 40).selectExpr("id AS w"))
    for max_bits in (1 << 30, 1 << 10):
        out = sifted(rows, "id", wanted, max_bits=max_bits)
        assert out.columns == rows.columns
        ids = [r["id"] for r in out.collect()]
        assert len(ids) == len(set(ids)) and set(range(0, 40_000, 40)) <= set(ids) and len(ids) < 4_000
    assert sifted(rows, "id", durable(wanted.limit(0))).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", " \n\t\r", "a", "1", "!", "_", "é", "<|", "'s"])
@pytest.mark.parametrize("length", [9_999, 10_000, 1_000_000])
def test_long_runs_have_the_ids_of_the_defining_form(run, length):
    from recordprofile.llm.bpe import worker_bpe

    bpe = worker_bpe()
    text = f"x {run * (length // len(run))} y"
    assert bpe.ids(text) == bpe._tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_white_space_is_counted_and_packed(spark, make_docs):
    texts = [f"a{c * n}b" for c, n in ((" ", 1_000_000), ("\n", 1_000_000), (" ", 10_000_000))]
    docs = make_docs(texts)
    from recordprofile.llm.bpe import worker_bpe

    sizes = [len(worker_bpe()._tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    pieces = packing.pack_documents(docs).groupBy("doc_id").sum("length").collect()
    assert sorted(tuple(r) for r in pieces) == list(enumerate(sizes))
    assert token_counts.length_histogram(docs).count() == len({*sizes})


def test_exact_dedup_beyond_one_filter_keeps_rows_in_place(make_docs):
    docs = make_docs([f"text {k}" for k in range(3000)] + ["Twice", "twice"] * 20 + [""] * 40)
    found = exact_dedup.text_groups(docs, max_bits=1 << 15, bits_per_row=400)
    rows = docs.withColumn("__h", F.xxhash64(F.sha2(exact_dedup.normalised(F.col("text")), 256), F.lit(exact_dedup._SEED)))
    marked = found.marked(rows)
    # Only the filter moves: texts and ids meet no shuffle before they pass, and few rows pass that don't repeat.
    plan = marked._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    passed = {r["text"].lower(): r["n"] for r in marked.where("__maybe").groupBy("text").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {"twice", ""} <= set(passed) and len(passed) < 150
    whole = exact_dedup.exact_dedup(docs).collect()
    assert sorted(map(str, whole)) == sorted(map(str, exact_dedup.exact_dedup(docs, max_bits=1 << 15, bits_per_row=400).collect()))
    hashes = rows.select("__h")
    at_once = {r["h"] for r in exact_dedup.repeated_hashes(hashes, 32).collect()}
    tested = exact_dedup._tested(hashes, exact_dedup.repeated_filter(hashes, 32), 32).where("__maybe").select("__h").distinct()
    assert at_once == {r["__h"] for r in tested.collect()} and len(at_once) >= 2
