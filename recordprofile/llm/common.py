"""What the operators of this subpackage share: tables, durable cuts, gapless numbering, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a filter's segment: those of Spark's bitmaps.
SEGMENT_BITS = 1 << 15
_SIFT = 0x51F7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint directory.

    Only where none is set, and only in plain local mode, a temporary one is made.
    """
    context = spark.sparkContext
    if (found := context.getCheckpointDir()) is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = context.getCheckpointDir()
    return found


def settle(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage is cut, and lost executors lose nothing."""
    return settle(df)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove settled tables that nothing reads any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column of ``df`` clashes (names match without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    into: str,
    *,
    rows_per_bucket: int = 40_000,
    bucket: Column | None = None,
) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in an order fixed by ``order``.

    A key's rows are dealt by a hash of ``order`` into as many buckets as its table
    needs for about ``rows_per_bucket`` rows each; the counts of the buckets, summed
    within the key, give each bucket's first number.  So one key may hold all rows
    and still no task sorts more than a bucket.  ``df`` is read three times: pass a
    durable table.  Rows equal in all of ``order`` share a bucket; let ``order``
    tell rows apart.  A ``bucket`` of the caller's (that never falls along
    ``order``) numbers the rows in just that order.
    """
    keys = list(keys)
    h, b, first = (free_name(df, n) for n in ("__h", "__b", "__first"))
    if bucket is None:
        buckets = max(1, -(-df.count() // rows_per_bucket))
        hashed = F.xxhash64(*order)
        dealt = df.withColumn(h, hashed).withColumn(b, F.pmod(hashed, F.lit(buckets)).cast("long"))
    else:
        dealt = df.withColumn(h, F.lit(0)).withColumn(b, bucket.cast("long"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy(*keys, b)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(first))
    )
    within = Window.partitionBy(*keys, b).orderBy(h, *order)
    return (
        dealt.join(firsts, [*keys, b])
        .withColumn(into, F.col(first) + F.row_number().over(within) - 1)
        .drop(h, b, first)
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` reaches.

    Each round takes the smallest label among a vertex and its neighbours
    (aggregated before the shuffle) and then the label of that label, which halves
    paths; each round is a table in the shared folder that replaces the one before,
    and the rounds end when no label changes.  Only ids with an edge are returned.
    """
    spark = edges.sparkSession
    links, links_at = settle(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .where("u <> v")
        .distinct()
    )
    labels = links.groupBy("u").agg(F.min("v").alias("v"))
    labels, at = settle(labels.select(F.col("u").alias("id"), F.least("u", "v").alias("l")))
    while True:
        near = links.join(labels.select(F.col("id").alias("v"), "l"), "v").select(F.col("u").alias("id"), "l")
        met = labels.unionByName(near).groupBy("id").agg(F.min("l").alias("l"))
        jumped = met.alias("m").join(labels.select(F.col("id").alias("t"), F.col("l").alias("tl")), F.col("m.l") == F.col("t"))
        fresh, fresh_at = settle(jumped.select("id", F.least("l", "tl").alias("l")))
        done = fresh.join(labels.withColumnRenamed("l", "was"), "id").where("l <> was").isEmpty()
        discard(spark, at)
        if done:
            discard(spark, links_at)
            return fresh.select("id", F.col("l").alias("component"))
        labels, at = fresh, fresh_at


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, spread: Sequence[Column | str], *, parts: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``groups`` (a durable table with one row per key), however many rows one key has.

    Keys that hold more than 1/parts of the rows in ``groups``, so fewer than ``parts``
    keys, are broadcast.  Their rows, and those with a null key, which have no match,
    are dealt evenly in the shuffle that joins the rest; ``spread`` tells rows apart.
    """
    keys, values = list(keys), [c for c in groups.columns if c not in keys]
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * parts > total)
    packed = lambda df, name: df.select(*[F.col(k).alias(f"{name}{i}") for i, k in enumerate(keys)], F.struct(*values).alias(name))
    on = lambda name: reduce(and_, [F.col(k) == F.col(f"{name}{i}") for i, k in enumerate(keys)])
    # Fewer than ``parts`` rows.
    found = rows.join(F.broadcast(packed(hot, "__hot")), on("__hot"), "left").drop(*[f"__hot{i}" for i in range(len(keys))])
    alone = F.col("__hot").isNotNull() | reduce(or_, [F.col(k).isNull() for k in keys])
    found = found.withColumn("__deal", F.when(alone, F.xxhash64(*spread)).otherwise(F.lit(0)))
    rest = packed(groups, "__cold").withColumn("__deal0", F.lit(0))
    cold = reduce(and_, [F.when(~alone, F.col(k)) == F.col(f"__cold{i}") for i, k in enumerate(keys)]) & (F.col("__deal") == F.col("__deal0"))
    met = found.join(rest, cold, "left")
    return met.select(*rows.columns, *[F.coalesce(F.col("__hot")[v], F.col("__cold")[v]).alias(v) for v in values])


def bit_at(bits: Column, place: Column) -> Column:
    """Whether the bit of that number is set; the first one is the lowest of the first byte."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1


def sifted(rows: DataFrame, key: str, wanted: DataFrame, *, bits_per_key: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """The rows whose key is in the one column of ``wanted`` (a durable table), and a few others, without a shuffle of ``rows``.

    A join that follows so shuffles few rows that find no partner.  The Bloom filter (two
    places a key) is broadcast in segments and has ``max_bits`` at most; with more keys
    than these serve, more rows pass, and none is lost at any size.
    """
    met, passes = _with_bloom(rows, key, wanted, "inner", bits_per_key, max_bits)
    return met.where(passes).select(rows.columns)


def bloom_marked(rows: DataFrame, key: str, wanted: DataFrame, into: str, *, bits_per_key: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """``rows`` with ``into``: whether ``sifted`` would let them pass."""
    met, passes = _with_bloom(rows, key, wanted, "left", bits_per_key, max_bits)
    return met.select(*rows.columns, F.coalesce(passes, F.lit(False)).alias(into))


def _with_bloom(rows: DataFrame, key: str, wanted: DataFrame, how: str, bits_per_key: int, max_bits: int) -> tuple[DataFrame, Column]:
    """``rows`` joined with their segment of the filter of ``wanted``, and whether both bits of the key are set there."""
    most = max(1, max_bits // SEGMENT_BITS)
    segments = 1 << min(most.bit_length() - 1, max(0, (wanted.count() * bits_per_key // SEGMENT_BITS).bit_length()))
    h, segment, bits = (free_name(rows, n) for n in ("__h", "__segment", "__bits"))
    place = lambda hashed, k: F.shiftrightunsigned(hashed, k).bitwiseAND(SEGMENT_BITS - 1)
    hashed = F.xxhash64(F.lit(_SIFT), F.col(wanted.columns[0]))
    places = wanted.select(hashed.alias(h)).select(F.col(h).bitwiseAND(segments - 1).alias(segment), F.explode(F.array(place(h, 33), place(h, 48))).alias("at"))
    filters = places.groupBy(segment).agg(F.bitmap_construct_agg("at").alias(bits))
    tested = rows.withColumn(h, F.xxhash64(F.lit(_SIFT), F.col(key))).withColumn(segment, F.col(h).bitwiseAND(segments - 1))
    # max_bits at most.
    return tested.join(F.broadcast(filters), segment, how), bit_at(F.col(bits), place(h, 33)) & bit_at(F.col(bits), place(h, 48))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def block_pairs(members: DataFrame, keys: Sequence[str], member: str, *, block: int = 256) -> DataFrame:
    """Deal the members of each key so that every two of them meet in exactly one group.

    ``members`` has the keys and the member id, each combination once.  Keys with one
    member vanish.  A key's members fall into blocks of about ``block`` by hash, and
    each member joins a group for every pair (lo, hi) that its block b is part of; so
    a group has about two blocks of rows at most, whatever the size of the key.
    """
    keys = list(keys)
    sizes = durable(members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    blocks = F.ceil(F.col("__n") / block).cast("int")
    dealt = members.join(sizes, keys).withColumn("__nb", blocks).withColumn("b", F.pmod(F.xxhash64(F.lit("block"), member), F.col("__nb")).cast("int"))
    met = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    return met.select(*keys, member, "b", F.least("b", "__o").alias("lo"), F.greatest("b", "__o").alias("hi"))


def in_pieces(batches: Iterator[pa.RecordBatch], column: int, *, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about so many bytes in one column, whatever the session's batch size; a longer value is a piece of its own.

    What a worker makes of a piece so stays small, as its process keeps the memory that it once had.
    """
    for batch in batches:
        # A row costs something besides its text.
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 128
        piece = (np.cumsum(size) - size) // most_bytes
        starts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def groups_in_order(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The runs of equal keys (no nulls) in a partition that is sorted by them, across its batches."""
    pending: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if pending is not None:
            rows = pa.concat_tables([pending, rows])
        changed = np.zeros(rows.num_rows - 1, bool)
        for key in keys:
            values = rows.column(key).to_numpy()
            changed |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1)]
        for a, b in zip(starts, starts[1:], strict=False):
            yield rows.slice(a, b - a)
        pending = rows.slice(starts[-1])
    if pending is not None:
        yield pending


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of n things linked by the pairs (a, b): for each the smallest number it is connected with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return root
