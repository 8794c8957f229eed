"""Sharding by a k-d tree over document metadata with near equal bytes in each leaf.

Every document is a point: scaled length, scaled or hashed id, hashed source and
hashed language, and a hash to tell points apart.  Equal texts share one point.  A
group of equal texts that fills a good part of a shard cannot be balanced by cuts, so
such groups are placed first, the largest in the emptiest shard, and the tree's leaves
take what room is left; only groups that no shard has room for are split.

A level of the tree takes, for all leaves in one job each: the ranges of the
dimensions (the widest is cut), then histograms of bytes along it, narrowed until the
weighted median is sharp.  Spark finds the bin that holds each leaf's median; the
driver sees a row per leaf, and each document's leaf is a column.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import discard, durable, free_name, number_rows, settle, utf8_bytes

BINS = 1024
#: Groups of equal texts above this part of a shard are placed before the tree is cut; so there are 1/BIG of them for a shard at most.
BIG = 1 / 32
DIMS = ("d0", "d1", "d2", "d3")
#: Narrowings along a dimension, and along the hash that tells equal points apart.
ROUNDS, TIE_ROUNDS = 4, 2


def _unit(h: Column) -> Column:
    """A 64-bit hash in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def _scaled(c: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or high <= low:
        return F.lit(0.0)
    return F.coalesce((c.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)), F.lit(0.0))


def place_groups(sizes: list[int], shards: int, room: float) -> tuple[list[int | None], list[float]]:
    """A shard for each size in turn, the emptiest one, or None where none has the room; and the room that is left."""
    left = [(-room, k) for k in range(shards)]
    heapify(left)
    placed: list[int | None] = []
    for size in sizes:
        most, k = heappop(left)
        fits = size <= -most
        placed.append(k if fits else None)
        heappush(left, (most + size if fits else most, k))
    return placed, [-r for r, _ in sorted(left, key=lambda x: x[1])]


def _leaf_table(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """A row per leaf, as many as there are shards at most, for a broadcast: a leaf may hold all points, which must not meet in one task."""
    return F.broadcast(df.sparkSession.createDataFrame(rows, columns))


def _narrowed(points: DataFrame, cuts: dict[int, dict], x: Column, rounds: int) -> None:
    """Narrow each leaf's [low, high] along ``x`` (of points with ``leaf`` and the cut's columns) to the bin that holds its wanted bytes.

    ``cuts``: low, high, before (bytes below low) and want by leaf; changed in place.
    """
    for _ in range(rounds):
        todo = [(k, c["dim"], c["value"], c["low"], c["high"], c["before"], c["want"]) for k, c in cuts.items() if c["high"] > c["low"]]
        if not todo:
            return
        table = _leaf_table(points, todo, "leaf int, dim int, value double, low double, high double, before double, want double")
        at = points.join(table, "leaf").withColumn("x", x).where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
        scale = F.lit(float(BINS)) / (F.col("high") - F.col("low"))
        at = at.withColumn("b", F.least(F.floor((F.col("x") - F.col("low")) * scale), F.lit(BINS - 1)))
        bins = at.groupBy("leaf", "b").agg(
            F.sum("size").alias("size"), F.min("x").alias("first"), F.max("x").alias("last"), F.first("before").alias("before"), F.first("want").alias("want")
        )
        upto = Window.partitionBy("leaf").orderBy("b")
        held = bins.withColumn("sum", F.col("before") + F.sum("size").over(upto))
        # The first bin at which the wanted bytes are reached; of a leaf that never gets there, the last.
        reached = F.struct((F.col("sum") < F.col("want")).cast("int").alias("short"), F.when(F.col("sum") < F.col("want"), -F.col("b")).otherwise(F.col("b")).alias("b"), "first", "last", "size", "sum")
        for r in held.groupBy("leaf").agg(F.min(reached).alias("r")).select("leaf", "r.*").collect():
            cuts[r["leaf"]] |= {"low": r["first"], "high": r["last"], "before": r["sum"] - r["size"], "size": float(r["size"])}


def _along() -> Column:
    """The coordinate of a point in the dimension its leaf cuts."""
    x = F.col(DIMS[-1])
    for k, d in enumerate(DIMS[:-1]):
        x = F.when(F.col("dim") == k, F.col(d)).otherwise(x)
    return x


def _cut_leaves(points: DataFrame, leaves: dict[int, tuple[int, int]], room: list[float]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """One level: every leaf of two shards or more is cut in two. ``leaves``: (first shard, shards) by number."""
    open_ = {k: v for k, v in leaves.items() if v[1] > 1}
    spans = points.where(F.col("leaf").isin(list(open_))) if len(open_) <= 64 else points
    spans = spans.groupBy("leaf").agg(F.sum("size").alias("size"), *[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("min", F.min), ("max", F.max))]).collect()
    cuts: dict[int, dict] = {}
    for r in spans:
        if r["leaf"] not in open_:
            continue
        first, n = open_[r["leaf"]]
        left, both = sum(room[first : first + n // 2]), sum(room[first : first + n])
        dim = max(range(len(DIMS)), key=lambda d: (r[f"max_{DIMS[d]}"] - r[f"min_{DIMS[d]}"], -d))
        low, high = r[f"min_{DIMS[dim]}"], r[f"max_{DIMS[dim]}"]
        part = left / both if both > 0 else (n // 2) / n
        cuts[r["leaf"]] = {"dim": dim, "value": 0.0, "low": low, "high": high, "before": 0.0, "want": r["size"] * part, "size": float(r["size"])}
    _narrowed(points, cuts, _along(), ROUNDS)
    # Points that share the median's value (or its last bin) are cut along the hash; of the last one the nearer side counts.
    at = {k: c["high"] for k, c in cuts.items()}
    ties = {k: c | {"value": c["high"], "floor": c["low"], "low": 0.0, "high": 1.0} for k, c in cuts.items()}
    _narrowed(points.withColumn("own", F.lit(1)), ties, F.when((_along() <= F.col("value")) & (_along() >= F.col("value")), F.col("tie")), TIE_ROUNDS)
    rows, grown = [], {k: v for k, v in leaves.items() if v[1] == 1}
    for k, (first, n) in open_.items():
        number = first + n // 2
        grown[first], grown[number] = (first, n // 2), (number, n - n // 2)
        if k not in cuts:
            continue
        c = ties[k]
        last = c["high"] if c["want"] - c["before"] > c["size"] / 2 else c["low"] - 1e-12 if c["low"] == c["high"] else c["low"]
        rows.append((k, cuts[k]["dim"], float(at[k]), float(last), number))
    table = _leaf_table(points, rows, "leaf int, dim int, value double, last double, number int")
    x = _along()
    above = (x > F.col("value")) | ((x == F.col("value")) & (F.col("tie") > F.col("last")))
    cut = points.join(table, "leaf", "left").withColumn("leaf", F.when(above, F.col("number")).otherwise(F.col("leaf")))
    return cut.select(points.columns), grown


def kd_shards(
    docs: DataFrame,
    *,
    shards: int | None = 16,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), text_crc32, shard (int) and slot.

    ``shards`` is the number of leaves, or with ``target_bytes`` and no ``shards`` as
    many as reach that size; an odd number of them is cut in that proportion.  Slots
    number a shard's rows from 0 without gaps.  Equal texts share a shard unless none
    has room for all of them.  Null texts have size 1, nulls in metadata lie at the low
    end, ids of any type will do, and an empty table has no rows.  Repeated rows are
    numbered one by one.
    """
    placed = _placed(docs, shards=shards, target_bytes=target_bytes, id_col=id_col, text_col=text_col, length_col=length_col, source_col=source_col, lang_col=lang_col)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def _placed(docs: DataFrame, *, shards: int | None, target_bytes: int | None, id_col: str, text_col: str, length_col: str, source_col: str, lang_col: str) -> DataFrame:
    """(id, h, size, text_crc32, shard, slot) of every row."""
    spark, text = docs.sparkSession, F.col(text_col)
    numeric = isinstance(docs.schema[id_col].dataType, NumericType)
    raw = durable(
        docs.select(
            F.col(id_col).alias("id"),
            (utf8_bytes(text) + 1).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
            F.col(length_col).cast("long").alias("length"),
            (F.col(id_col).cast("double") if numeric else _unit(F.xxhash64(F.col(id_col)))).alias("place"),
            _unit(F.xxhash64(F.col(source_col))).alias("d2"),
            _unit(F.xxhash64(F.col(lang_col))).alias("d3"),
        )
    )
    totals = raw.agg(
        F.sum("size").alias("bytes"), F.min("length").alias("l0"), F.max("length").alias("l1"),
        F.min("place").alias("i0"), F.max("place").alias("i1"),
    ).first()
    total = totals["bytes"] or 0
    shards = shards or max(1, -(-total // target_bytes))
    raw = raw.withColumn("d0", _scaled(F.col("length"), totals["l0"], totals["l1"])).withColumn("d1", _scaled(F.col("place"), totals["i0"], totals["i1"]))
    # Only texts that occur twice need a common point.
    groups = durable(
        raw.groupBy("h", "crc", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "d0", "d1", "d2", "d3"), F.struct("place", "d2", "d3")).alias("p"))
        .where("n > 1")
    )
    room = total / shards
    big = groups.where(F.col("n") * F.col("size") > F.lit(room * BIG)).select("h", "crc", "size", "n").collect()  # shards / BIG rows at most
    big.sort(key=lambda r: (-r["n"] * r["size"], r["h"], r["crc"]))
    where, left = place_groups([r["n"] * r["size"] for r in big], shards, room)
    given = spark.createDataFrame([(r["h"], r["crc"], r["size"], -1 if k is None else k) for r, k in zip(big, where, strict=True)], "h long, crc long, size long, given int")
    groups = groups.join(given, ["h", "crc", "size"], "left").drop("n")
    own = F.struct("id", "d0", "d1", "d2", "d3")
    met = raw.join(groups, ["h", "crc", "size"], "left")
    # Rows of a group that is split are points of their own.
    point = F.when(F.col("p").isNull() | (F.coalesce("given", F.lit(0)) < 0), own).otherwise(F.col("p"))
    rows = met.select(
        "id", "h", "size", "crc", *[point[d].alias(d) for d in DIMS], _unit(F.xxhash64(point["id"], "h", F.lit("tie"))).alias("tie"),
        F.when(F.col("given") >= 0, F.col("given")).alias("given"), F.lit(0).alias("leaf"),
    )
    rows, at = settle(rows)
    leaves = {0: (0, shards)}
    while any(n > 1 for _, n in leaves.values()):
        free, leaves = _cut_leaves(rows.where("given is null"), leaves, left)
        cut, cut_at = settle(free.unionByName(rows.where("given is not null")))
        discard(spark, at)
        rows, at = cut, cut_at
    sharded = durable(rows.select("id", "h", "size", F.col("crc").alias("text_crc32"), F.coalesce("given", "leaf").alias("shard"), "tie"))
    return number_rows(sharded, ["shard"], ["tie", "id", "text_crc32", "size"], "slot")


def with_shards(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = 16, target_bytes: int | None = None,
    length_col: str = "n_chars", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """``docs`` with shard and slot, which replace columns of these names.

    Every row has one, null and repeated ids too: rows alike in id and text take the
    slots of these one by one.
    """
    docs = docs.drop("shard", "slot")
    h, nth = free_name(docs, "__h"), free_name(docs, "__nth")
    placed = _placed(docs, shards=shards, target_bytes=target_bytes, id_col=id_col, text_col=text_col, length_col=length_col, source_col=source_col, lang_col=lang_col)
    placed = placed.select(F.col("id").alias("placed_id"), F.col("h").alias("placed_h"), "shard", "slot")
    alike = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    placed = placed.withColumn("placed_nth", alike("placed_id", "placed_h"))
    ours = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).withColumn(nth, alike(id_col, h))
    same = F.col(id_col).eqNullSafe(F.col("placed_id")) & (F.col(h) == F.col("placed_h")) & (F.col(nth) == F.col("placed_nth"))
    return ours.join(placed, same).select(*docs.columns, "shard", "slot")
