"""Best-fit packing of documents into sequences of fixed capacity, planned on the size histogram.

Sizes are whole numbers up to the capacity, so their histogram is bounded however
many documents there are.  The driver packs the histogram instead of the documents:

* pieces above one third of the capacity: at most two fit in a sequence, so they are
  matched greedily, the largest with the largest that still fits beside it;
* smaller pieces, from the largest down, fill the tightest gap that holds them, as
  often as they fit there; what finds no gap opens new sequences.

Equal sequences are planned together with a count.  The plan gives every size ranges
of ranks, and each range its sequences and offset; rows get their rank within their
size from gapless numbering, and one join by size lays them out.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import END_ID, worker_bpe
from .common import durable, free_name, number_rows

CAPACITY = 1024


def token_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
    path: str | None = None,
    ranks_path: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut where longer than the capacity.

    The first piece is the one that may be shorter.  A null text counts as empty, so
    every row has a piece; ``ids`` are packed little-endian unsigned 32-bit numbers.
    """
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, ranks_path)
        for batch in batches:
            out = defaultdict(list)
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = bpe.pack(text.as_py()) + end
                n = len(ids) // 4
                starts = [0, *range((n - 1) % capacity + 1, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    part = ids[4 * a : 4 * b]
                    for name, value in (("id", key.as_py()), ("piece", k), ("start", a), ("length", b - a), ("crc", zlib.crc32(part))):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(part)
            columns = {
                id_col: pa.array(out["id"], batch.column(0).type),
                "piece": pa.array(out["piece"], pa.int32()),
                "start": pa.array(out["start"], pa.int64()),
                "length": pa.array(out["length"], pa.int64()),
                "ids_crc32": pa.array(out["crc"], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(out["ids"], pa.binary())} if with_ids else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def plan_bins(sizes: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Pack ``sizes`` (size -> count): a list of (number of equal bins, [(size, times), ...])."""
    left = Counter({s: n for s, n in sizes.items() if n > 0})
    bins: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # gap -> bins with that gap
    gaps: list[int] = []

    def put(gap: int, count: int, items: tuple) -> None:
        if not bins[gap]:
            bisect.insort(gaps, gap)
        bins[gap].append((count, items))

    for big in sorted((s for s in left if 3 * s > capacity), reverse=True):
        while left[big] > 0:
            mates = [s for s in left if 3 * s > capacity and s <= capacity - big and left[s] > (s == big)]
            if not mates:
                put(capacity - big, left[big], ((big, 1),))
                left[big] = 0
                break
            mate = max(mates)
            n = left[big] // 2 if mate == big else min(left[big], left[mate])
            put(capacity - big - mate, n, ((big, 2),) if mate == big else ((big, 1), (mate, 1)))
            left[big] -= n
            left[mate] -= n
    for small in sorted((s for s in left if 3 * s <= capacity and left[s] > 0), reverse=True):
        rest = left[small]
        while rest > 0 and (k := bisect.bisect_left(gaps, small)) < len(gaps):
            gap = gaps[k]
            count, items = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(k)
            each = gap // small
            full = min(count, rest // each)
            if full:
                put(gap - each * small, full, (*items, (small, each)))
                rest -= full * each
            if full < count:
                more = min(rest, each - 1) if rest < each else 0
                if more:
                    put(gap - more * small, 1, (*items, (small, more)))
                    rest -= more
                if count - full - bool(more):
                    put(gap, count - full - bool(more), items)
        if rest:
            each = capacity // small
            if rest // each:
                put(capacity - each * small, rest // each, ((small, each),))
            if rest % each:
                put(capacity - rest % each * small, 1, ((small, rest % each),))
    return [(count, list(items)) for gap in gaps for count, items in bins[gap]]


def pack_sized(pieces: DataFrame, *, order: list[str], size_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a durable table) with sequence_id and offset, both long.

    Sizes must lie between 1 and the capacity.  ``order`` names columns that tell
    pieces apart; sequences do not depend on how the table is partitioned.  The two
    names replace columns of the same name; other columns keep theirs.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(size_col).count().collect()}  # at most ``capacity`` rows
    if any(s is None or not 1 <= s <= capacity for s in counts):
        raise ValueError(f"piece sizes must lie between 1 and {capacity}")
    rows, first, used = [], 0, Counter()
    for count, items in plan_bins(counts, capacity):
        offset = 0
        for size, times in items:
            rows.append((size, used[size], used[size] + count * times, first, times, offset))
            used[size] += count * times
            offset += size * times
        first += count
    pieces = pieces.drop("sequence_id", "offset")
    size, rank, start, stop, at, times, place = (free_name(pieces, n) for n in ("__size", "__rank", "__from", "__to", "__first", "__times", "__offset"))
    # Some rows for each size up to the capacity, whatever the number of pieces.
    names = (size, start, stop, at, times, place)
    # From Arrow, as plain rows would pass through Python workers.
    plan = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(names)}))
    ranked = number_rows(pieces, [size_col], order, rank)
    nth = F.col(rank) - F.col(start)
    return (
        ranked.join(F.broadcast(plan), (F.col(size_col) == F.col(size)) & (F.col(rank) >= F.col(start)) & (F.col(rank) < F.col(stop)))
        .withColumn("sequence_id", F.col(at) + F.floor(nth / F.col(times)))
        .withColumn("offset", F.col(place) + nth % F.col(times) * F.col(size_col))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece of each document: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    An empty table has no pieces; repeated rows are packed one by one.
    """
    pieces = durable(token_pieces(docs, id_col=id_col, capacity=capacity, **options))
    return pack_sized(pieces, order=[id_col, "piece", "ids_crc32", "start"], capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): packed ids of each sequence, from ``pack_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(parts["ids"], "")).alias("ids"))
