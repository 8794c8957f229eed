"""All pairs of documents with a Jaccard similarity of word n-grams from a threshold on.

Texts with the same n-grams form a class; only one of each class is compared.

1. MinHash bands give candidates: texts that agree in a band share a bucket.
2. Within a bucket, pairs compare more and more MinHash values.  After n of them, m
   agreeing, the similarity's posterior (uniform prior) is Beta(m + 1, n - m + 1); a
   pair whose probability of reaching the threshold falls below the tolerance is
   dropped.  What is left keeps candidates together in small components.
3. Within a component, pairs are pruned in the same way and the rest verified on the
   n-grams themselves.  Each pair meets once, so links are counted, not listed, and
   each group also yields edges that span its links for the final components.

Large buckets and components are dealt out in pairs of blocks, so a group of near
copies of any size is shared by many tasks and no pair of rows is ever a row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, bloom_marked, components, durable, forest, free_name, groups_in_order, in_pieces, join_groups, sifted

WORDS, THRESHOLD = 5, 0.8
#: Bands of the MinHash values; a pair at 0.8 misses all with probability 3e-5, at 0.9 with 6e-10.
BANDS, ROWS = 20, 4
VALUES = 128
STEP = 16
TOLERANCE = 1e-6
BLOCK = 256
#: Pairs whose MinHash values are compared at once.
PAIRS = 1 << 15

_words = re.compile(r"\w+").findall
_MULTIPLY = np.random.default_rng(20).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 63, VALUES, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-case words; a shorter text is one n-gram, a wordless one has none."""
    found = _words((text or "").lower())
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in found), np.uint64, len(found))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def class_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def minhash(grams: np.ndarray, values: int = VALUES) -> np.ndarray:
    out = np.full(values, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(grams), 2048):
        mixed = grams[a : a + 2048, None] * _MULTIPLY[None, :values]
        mixed += _ADD[None, :values]
        out = np.minimum(out, mixed.min(axis=0) >> np.uint64(32))
    return out.astype(np.uint32)


@cache
def least_agreeing(threshold: float, tolerance: float, values: int = VALUES, step: int = STEP) -> dict[int, int]:
    """After n values: the fewest agreeing ones that keep P(similarity >= threshold) at the tolerance.

    That probability is P(Binomial(n + 1, threshold) <= agreeing).
    """
    least = {}
    for n in range(step, values + 1, step):
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        least[n] = m
    return least


def surviving_pairs(left: np.ndarray, right: np.ndarray, least: dict[int, int], *, same: bool, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of the pairs of two MinHash matrices that are never dropped; ``same``: one matrix, a < b."""
    a, b = np.triu_indices(len(left), 1) if same else (x.ravel() for x in np.indices((len(left), len(right))))
    parts = [_surviving(left, right, a[k : k + PAIRS], b[k : k + PAIRS], least, step) for k in range(0, len(a), PAIRS)]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (a, b)


def _surviving(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int], step: int) -> tuple[np.ndarray, np.ndarray]:
    agree = np.zeros(len(a), np.int32)
    for n, needed in least.items():
        agree += (left[a, n - step : n] == right[b, n - step : n]).sum(axis=1, dtype=np.int32)
        keep = agree >= needed
        a, b, agree = a[keep], b[keep], agree[keep]
        if not len(a):
            break
    return a, b


def common_grams(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of grams[a] and grams[b]."""
    if len(a) <= 4 * len(grams):
        return np.array([len(np.intersect1d(grams[i], grams[j], assume_unique=True)) for i, j in zip(a, b, strict=True)], np.int64)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    _, column, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    often = times > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(grams), len(grams)), np.float64)
    width = 4096
    for first in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(grams), width), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _sides(group: pa.Table) -> tuple[np.ndarray, bool]:
    """Rows of a block pair in the order of their blocks, and whether it is a block with itself."""
    return np.argsort(group.column("b").to_numpy(), kind="stable"), group.column("lo")[0] == group.column("hi")[0]


def _spanning(ids: pa.Array, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Each linked id with the smallest one it is connected with; the same ones in many groups, so that edges fold."""
    by_id = np.asarray(pc.sort_indices(ids))
    rank = np.argsort(by_id)
    root = by_id[forest(len(ids), rank[a], rank[b])[rank]]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids.take(pa.array(child)), ids.take(pa.array(root[child]))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.uint32) for chunk in column.chunks for x in chunk])


def similar_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: id, n_links, component_id and kept.

    n_links counts the other documents linked with it directly, those with the same
    n-grams included.  component_id is the smallest id reachable by links, and kept
    says whether it is the document's own.  Texts without words (null and empty ones
    too) link with nothing; so do rows without an id, whose component is null.  Every
    row is a document: rows that repeat an id link by their own texts, and equal rows
    with each other.  An empty table has no rows; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    arrow_kind = docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 1):
            keys, bands = [], []
            for text in batch.column(1):
                grams = shingles(text.as_py(), words)
                if not len(grams):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(class_key(grams))
                parts = minhash(grams, BANDS * ROWS).reshape(BANDS, ROWS)
                bands.append([xxhash.xxh64_intdigest(p.tobytes(), seed=k) - (1 << 63) for k, p in enumerate(parts)])
            yield pa.RecordBatch.from_pydict({"id": batch.column(0).cast(arrow_kind), "class": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    sketched = durable(docs.select(id_col, text_col).mapInArrow(sketch, f"id {kind}, class binary, bands array<long>"))
    named = sketched.where("id is not null and class is not null")
    # A class is told by the hash of its n-grams, 128 bits, as ids may repeat; the smallest id leads to its text.
    classes = durable(named.groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands")))
    buckets = classes.select(F.col("class").alias("rep"), F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("bucket")
    suspects = durable(buckets.join(shared, "bucket", "left_semi").distinct())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, 0):
            grams = [shingles(t.as_py(), words) for t in batch.column(0)]
            # An id may have other texts besides that of the class.
            own = [k for k, g in enumerate(grams) if class_key(g) == batch.column(1)[k].as_py()]
            yield pa.RecordBatch.from_pydict(
                {
                    "rep": batch.column(1).take(pa.array(own, pa.int64())),
                    "size": batch.column(2).take(pa.array(own, pa.int64())),
                    "values": pa.array([minhash(grams[k]).tobytes() for k in own], pa.binary()),
                    "grams": pa.array([grams[k].tobytes() for k in own], pa.binary()),
                }
            )

    chosen = durable(suspects.select("rep").distinct().join(classes.select(F.col("class").alias("rep"), F.col("least").alias("chosen_id"), "size"), "rep"))
    # Most documents are no suspects; their texts need not shuffle.
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = sifted(own, "id", chosen.select("chosen_id")).join(chosen, F.col("id") == F.col("chosen_id")).select("text", "rep", "size")
    members = durable(texts.mapInArrow(full, "rep binary, size long, values binary, grams binary"))
    # Only rows that repeat an id and its n-grams are dropped; a sort of all n-grams would fill the memory.
    again = durable(members.groupBy("rep").count().where("count > 1").select("rep"))
    if not again.isEmpty():
        marked = bloom_marked(members, "rep", again, "again")
        members = durable(marked.where("not again").unionByName(marked.where("again").dropDuplicates(["rep"])).drop("again"))
    least = least_agreeing(threshold, tolerance)

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["bucket", "lo", "hi"]):
            order, same = _sides(group)
            ids = group.column("rep").take(order)
            values, side = _matrix(group.column("values"))[order], group.column("b").to_numpy()[order]
            cut = len(order) if same else int(np.searchsorted(side, side[-1]))
            right = 0 if same else cut
            a, b = surviving_pairs(values[:cut], values[right:], least, same=bool(same))
            u, v = _spanning(ids.combine_chunks(), a, b + right)
            if len(u):
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})

    dealt = block_pairs(suspects, ["bucket"], "rep", block=2 * block).join(members.select("rep", "values"), "rep")
    edges = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(plausible, "u binary, v binary")
    candidates = components(edges, "u", "v").select(F.col("id").alias("rep"), F.col("component").alias("part"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["part", "lo", "hi"]):
            order, same = _sides(group)
            ids, sizes = group.column("rep").take(order), group.column("size").to_numpy()[order]
            values, side = _matrix(group.column("values"))[order], group.column("b").to_numpy()[order]
            cut = len(order) if same else int(np.searchsorted(side, side[-1]))
            right = 0 if same else cut
            a, b = surviving_pairs(values[:cut], values[right:], least, same=bool(same))
            b = b + right
            if not len(a):
                continue
            grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("grams").take(order)]
            length = np.array([len(g) for g in grams])
            common = common_grams(grams, a, b)
            linked = common >= threshold * (length[a] + length[b] - common) - 1e-9
            a, b = a[linked], b[linked]
            links = np.bincount(a, sizes[b], len(order)) + np.bincount(b, sizes[a], len(order))
            child = np.flatnonzero(links)
            if len(child):
                root = forest(len(order), a, b)
                yield from pa.table({"u": ids.take(child), "v": ids.take(root[child]), "links": pa.array(links[child].astype(np.int64))}).to_batches()

    met = block_pairs(candidates, ["part"], "rep", block=block).join(members, "rep")
    counted = durable(met.repartition("part", "lo", "hi").sortWithinPartitions("part", "lo", "hi").mapInArrow(verified, "u binary, v binary, links long"))
    links = counted.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    parts = durable(components(counted, "u", "v").select(F.col("id").alias("class"), "component"))
    lowest = parts.join(classes.select("class", "least"), "class").groupBy("component").agg(F.min("least").alias("component_id"))
    parts = parts.join(lowest, "component").select("class", "component_id")
    found = durable(
        classes.select("class", "least", "size")
        .join(links.withColumnRenamed("rep", "class"), "class", "left")
        .join(parts, "class", "left")
        .where("size > 1 or links is not null")
        .select("class", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    named = sketched.select("id", F.when(F.col("id").isNotNull(), F.col("class")).alias("class"))
    met = join_groups(named, found, ["class"], "size", ["id"])
    return met.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", earlier: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id.

    Rows under one id are one document here, which links by any of its texts; rows
    without an id stay.  ``earlier`` holds the documents' texts (id and text) before a
    stage that cut them: documents link by these too, in a join of their own, as a
    document's two texts need not be compared with each other.
    """
    key = free_name(docs, "__gone")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    sides = [texts]
    if earlier is not None:
        before = earlier.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        sides.append(before.join(texts.select("id").distinct(), "id", "left_semi"))
    edges = [similar_documents(t, id_col="id", text_col="text", **options).where("not kept").select("id", "component_id") for t in sides]
    # An id with texts in several components links them.
    joined = components(reduce(DataFrame.unionByName, edges), "id", "component_id")
    gone = joined.where("id <> component").select(F.col("id").alias(key))
    return docs.join(gone, F.col(id_col) == F.col(key), "left_anti")
