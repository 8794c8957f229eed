"""Exact deduplication by two passes with a Bloom filter.

One pass over the texts writes down their hashes.  Pass one over these counts them in a blocked Bloom filter with saturating two-bit
counters (unseen, once, more than once).  Each partition fills counters for its
own rows and sends only the positions it touched; the positions of a segment meet
in one task, which keeps a bit for every counter that passed one.  Pass two tests
each row's hash against those bits.  A hash that truly repeats always passes, so
only rows that pass are grouped (id and hash shuffle, with what columns the caller
asks for); all others go straight through.

The filter is broadcast.  It has ``bits_per_row`` bits a row, and never more than
``max_bits`` (128 MB by default).  Past that size it stays where it was made: the
hashes alone (8 bytes a row) shuffle to their segments, whose tasks count and test
them in one go, and a Bloom filter of the hashes that passed, far fewer, is broadcast.
Rows and texts stay in place either way.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEGMENT_BITS, bit_at, bloom_marked, durable, join_groups

_SEED = 0x9E37


def normalised(text: Column) -> Column:
    """Null as empty; A-Z in lower case, all else as it is."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _positions(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each hash and its two places there; ``_tests`` says the same in Spark."""
    u = h.view(np.uint64)
    return (
        (u & np.uint64(segments - 1)).astype(np.int64),
        ((u >> np.uint64(33)) & np.uint64(SEGMENT_BITS - 1)).astype(np.uint16),
        ((u >> np.uint64(48)) & np.uint64(SEGMENT_BITS - 1)).astype(np.uint16),
    )


def _touched(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not seen:
            return
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        seg, p, q = _positions(h, segments)
        # Counters: one for each different hash that meets the place, two at once for a repeated hash.
        where = np.concatenate([seg * SEGMENT_BITS + p, (seg * SEGMENT_BITS + q)[p != q]])
        times = np.concatenate([n, n[p != q]])
        place, inverse = np.unique(where, return_inverse=True)
        total = np.zeros(len(place), np.int64)
        np.add.at(total, inverse, times)
        seg = place // SEGMENT_BITS
        at = (place % SEGMENT_BITS).astype("<u2")
        cuts = np.flatnonzero(np.diff(seg)) + 1
        firsts = np.concatenate([[0], cuts]) if len(seg) else []
        yield pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(seg[firsts] if len(seg) else [], pa.int64()),
                "places": pa.array([x.tobytes() for x in np.split(at, cuts)] if len(seg) else [], pa.binary()),
                "many": pa.array([np.packbits(x > 1).tobytes() for x in np.split(total, cuts)] if len(seg) else [], pa.binary()),
            }
        )

    return run


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    counter = np.zeros(SEGMENT_BITS, np.uint8)
    for places, many in zip(pdf["places"], pdf["many"], strict=True):
        at = np.frombuffer(places, "<u2")
        more = np.unpackbits(np.frombuffer(many, np.uint8), count=len(at))
        counter[at] = np.minimum(counter[at] + 1 + more, 2)
    bits = np.packbits(counter == 2, bitorder="little")
    return pd.DataFrame({"segment": pdf["segment"].iloc[:1], "bits": [bits.tobytes()]})


def repeated_filter(hashes: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the places that two rows or more of the one column of ``hashes`` touch."""
    touched = hashes.mapInArrow(_touched(segments), "segment long, places binary, many binary")
    return touched.groupBy("segment").applyInPandas(_merged, "segment long, bits binary")


def _hashes_by_segment(segments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if not seen:
            return
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(_positions(h, segments)[0], pa.int64()), "h": pa.array(h, pa.int64()), "many": pa.array(n > 1)})

    return run


def _passing(pdf: pd.DataFrame) -> pd.DataFrame:
    """The different hashes of a segment both of whose places are touched more than once there."""
    h, many = pdf["h"].to_numpy(np.int64), pdf["many"].to_numpy(bool)
    _, p, q = _positions(h, 1)
    times = np.where(many, 2, 1)
    counter = np.bincount(p, times, SEGMENT_BITS) + np.bincount(q[p != q], times[p != q], SEGMENT_BITS)
    return pd.DataFrame({"h": np.unique(h[(counter[p] > 1) & (counter[q] > 1)])})


def repeated_hashes(hashes: DataFrame, segments: int) -> DataFrame:
    """(h): the different values of the one column of ``hashes`` that pass the filter of these segments, which is nowhere as a whole.

    A partition sends each of its hashes once, so a hash of very many rows reaches its
    segment as often as there are partitions at most.
    """
    dealt = hashes.mapInArrow(_hashes_by_segment(segments), "segment long, h long, many boolean")
    return dealt.groupBy("segment").applyInPandas(_passing, "h long")


def _tested(rows: DataFrame, filters: DataFrame, segments: int) -> DataFrame:
    """``rows`` (with __h) with __maybe: whether both places of the hash were touched more than once."""
    found = F.broadcast(filters.select(F.col("segment").alias("__segment0"), F.col("bits").alias("__bits")))  # max_bits at most
    places = [bit_at(F.col("__bits"), F.shiftrightunsigned("__h", k).bitwiseAND(SEGMENT_BITS - 1)) for k in (33, 48)]
    joined = rows.withColumn("__segment", F.col("__h").bitwiseAND(segments - 1)).join(found, F.col("__segment") == F.col("__segment0"), "left")
    return joined.withColumn("__maybe", F.coalesce(places[0] & places[1], F.lit(False))).drop("__segment", "__segment0", "__bits")


@dataclass(frozen=True)
class TextGroups:
    """Narrow results of the two passes: rows (id, text_sha256, keep_id, group_size), the groups of rows that passed the filter, and what marks rows (with __h) that pass, as __maybe."""

    rows: DataFrame
    groups: DataFrame
    marked: Callable[[DataFrame], DataFrame]


def text_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> TextGroups:
    """Both passes over (id, hash), which one pass over the texts writes down."""
    sha = F.sha2(normalised(F.col(text_col)), 256)
    narrow = docs.select(F.col(id_col).alias("id"), sha.alias("text_sha256")).withColumn("__h", F.xxhash64("text_sha256", F.lit(_SEED)))
    wanted = durable(narrow)
    segments = 1 << max(0, (max(wanted.count() * bits_per_row, SEGMENT_BITS) // SEGMENT_BITS - 1).bit_length())
    if segments * SEGMENT_BITS <= max(max_bits, SEGMENT_BITS):
        filters = repeated_filter(wanted.select("__h"), segments)
        marked = lambda rows: _tested(rows, filters, segments)
    else:
        passed = durable(repeated_hashes(wanted.select("__h"), segments))
        marked = lambda rows: bloom_marked(rows, "__h", passed, "__maybe", bits_per_key=bits_per_row, max_bits=max_bits)
    tested = marked(wanted)
    once = tested.where(~F.col("__maybe")).select("id", "text_sha256", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = tested.where("__maybe").select("id", "text_sha256", "__h")
    groups = durable(maybe.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    met = join_groups(maybe, groups, ["text_sha256"], "group_size", ["id", "__h"]).select(once.columns)
    return TextGroups(once.unionByName(met), groups, marked)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with keep_id, group_size (long), kept (boolean) and text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the largest id stays.  Rows repeated under one id are one
    document and share its decision; a null id stays only where no other has the
    text.  An empty table has no rows.  The four names replace columns of the same
    name.  Rows that cannot repeat pass straight through, the others shuffle.
    """
    found = text_groups(docs, id_col=id_col, text_col=text_col, **options)
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values()).withColumn("text_sha256", F.sha2(normalised(F.col(names[text_col])), 256)).withColumn("__h", F.xxhash64("text_sha256", F.lit(_SEED)))
    own = F.col(names[id_col])
    columns = [*names.values(), "text_sha256", "keep_id", "group_size"]
    tested = found.marked(rows)
    once = tested.where(~F.col("__maybe")).withColumns({"keep_id": own, "group_size": F.lit(1).cast("long")}).select(columns)
    met = join_groups(tested.where("__maybe").drop("__maybe"), found.groups, ["text_sha256"], "group_size", [names[id_col], "__h"])
    out = once.unionByName(met.select(columns))
    out = out.withColumn("kept", own.eqNullSafe(F.col("keep_id")))
    return out.select(*[F.col(v).alias(k) for k, v in names.items()], "keep_id", "group_size", "kept", "text_sha256")


def decisions(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``exact_dedup`` without the documents' other columns: id, keep_id, group_size, kept and text_sha256; texts are read once."""
    rows = text_groups(docs, id_col=id_col, **options).rows
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
