"""Hard negatives for anchors, by an inverted multi-index with certified bounds.

A bounded sample trains a codebook for each half of the vectors' dimensions.  A vector
stands in the cell of its two nearest centroids; the radius of a centroid is the largest
distance of a half that it stands for, over all vectors.  For an anchor q a half's
inner product with anything near centroid c is at most q.c + |q| * radius, so the sum of
two such bounds holds for all of a cell.  A heap over the two descending lists of
half-bounds visits cells by descending sums (multi-sequence), and as no later cell can
hold more, an anchor stops where the next sum is below what each of its windows still
asks for: the result is that of comparing all rows.

Anchors go through the cells in rounds of growing size.  In a round the anchors and the
vectors of each visited cell meet in blocks, however many there are of either, and a
block returns no more rows than the window asks for.  First each anchor's positives are
found (one window, rows of its label), then for each positive the window of scores that
its negatives may have (rows of other labels).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, groups_in_order, join_groups, settle
from .vector_join import _kmeans, _nearest

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: Vectors in the training sample, centroids of a half at most (their square is the number of cells at most), and vectors that a cell should hold.
SAMPLE, MOST_CODES, PER_CELL = 16_384, 256, 512
VECTORS, ANCHORS = 4096, 512
#: Cells that an anchor visits in the first round; each further round visits four times as many.
FIRST_CELLS = 16
#: Vectors of this squared length or more take no part, so that scores and their multiples fit 64 bits.
TOO_LONG = float(1 << 55)
_LEAST, _MOST = -(1 << 62), 1 << 62
_WINDOWS = "array<struct<k:int,lo:long,hi:long>>"
_TOPS = "array<struct<k:int,score:long,id:long,row:long>>"


@dataclass(frozen=True)
class MultiIndex:
    books: tuple[np.ndarray, np.ndarray]  # centroids of each half
    radii: tuple[np.ndarray, np.ndarray]  # the largest distance of a half from each centroid; of those that stand for none, no number
    held: np.ndarray  # first centroids x second ones: whether the cell holds vectors
    width: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows cut in two, filled up with zeros to the width of the index."""
        x = np.pad(x.astype(np.float64), ((0, 0), (0, self.width - x.shape[1])))
        return x[:, : self.width // 2], x[:, self.width // 2 :]

    def visits(self, q: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of the cells that hold vectors, by descending bound of their inner product with q."""
        bounds = []
        for half, book, radius in zip(self.halves(q[None]), self.books, self.radii, strict=True):
            reach = np.linalg.norm(half[0]) * radius
            # More than rounding can take away.
            slack = 1e-9 * (np.linalg.norm(half[0]) * (np.linalg.norm(book, axis=1) + radius) + 1)
            bounds.append(book @ half[0] + reach + slack)
        orders = [np.argsort(-np.where(np.isnan(b), -np.inf, b), kind="stable")[: int((~np.isnan(b)).sum())] for b in bounds]
        first, second = (b[o] for b, o in zip(bounds, orders, strict=True))
        if not len(first) or not len(second):
            return
        heap, seen = [(-(first[0] + second[0]), 0, 0)], {(0, 0)}
        while heap:
            low, i, j = heapq.heappop(heap)
            a, b = orders[0][i], orders[1][j]
            if self.held[a, b]:
                yield -low, int(a) * len(self.books[1]) + int(b)
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(first) and j < len(second) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(first[i] + second[j]), i, j))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def _index(rows: DataFrame, *, sample: int, most_codes: int, per_cell: int) -> tuple[MultiIndex, DataFrame]:
    """The index of (row, id, label, v), and the rows with their cell, a durable table."""
    spark = rows.sparkSession
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(2, shape["width"] or 0)
    codes = max(1, min(most_codes, round((shape["n"] / per_cell) ** 0.5)))
    # At most ``sample`` rows.
    drawn = rows.orderBy(F.xxhash64("v"), "row").limit(sample).select("v").toArrow().column("v")
    bare = MultiIndex((np.zeros((0, 0)),) * 2, (np.zeros(0),) * 2, np.zeros((0, 0)), width)
    training = bare.halves(_matrix(drawn, width))
    books = tuple(_kmeans(half, codes, 8, 3 + k) if len(half) else np.zeros((1, half.shape[1])) for k, half in enumerate(training))
    shared = spark.sparkContext.broadcast(books)  # twice most_codes centroids at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                halves = bare.halves(_matrix(part.column("v"), width))
                near = [_nearest(half, book)[:, 0] for half, book in zip(halves, books, strict=True)]
                far = [np.linalg.norm(half - book[c], axis=1) for half, book, c in zip(halves, books, near, strict=True)]
                made = {"cell": near[0] * len(books[1]) + near[1], "a": far[0], "b": far[1]}
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x) for x in made.values()]], names=[*part.schema.names, *made])

    placed = durable(rows.mapInArrow(place, "row long, id long, label long, v array<int>, cell long, a double, b double"))
    # A row per cell that holds vectors, most_codes squared at most.
    found = placed.groupBy("cell").agg(F.max("a").alias("a"), F.max("b").alias("b")).collect()
    radii = tuple(np.full(len(book), np.nan) for book in books)
    held = np.zeros((len(books[0]), len(books[1])), bool)
    for r in found:
        at = divmod(r["cell"], len(books[1]))
        held[at] = True
        for c, far, radius in zip(at, (r["a"], r["b"]), radii, strict=True):
            radius[c] = np.fmax(radius[c], far * (1 + 1e-9) + 1e-9)
    return MultiIndex(books, radii, held, width), placed.drop("a", "b")


def _best(anchor_id: np.ndarray, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, windows: list[list[dict]], want: int) -> dict[str, list]:
    """The first ``want`` of each anchor's windows; columns of ``scores`` stand by id, and those that don't count are no numbers."""
    out: dict[str, list] = {"anchor": [], "k": [], "score": [], "id": [], "row": []}
    for a, s in enumerate(scores):
        kept = np.flatnonzero(~np.isnan(s)) if s.dtype.kind == "f" else np.flatnonzero(s != _LEAST)
        kept = kept[np.argsort(-s[kept], kind="stable")]
        falling = -s[kept]
        for w in windows[a]:
            for j in kept[np.searchsorted(falling, -w["hi"]) :][:want]:
                if s[j] < w["lo"]:
                    break
                for name, x in (("anchor", anchor_id[a]), ("k", w["k"]), ("score", int(s[j])), ("id", ids[j]), ("row", rows[j])):
                    out[name].append(x)
    return out


def _search(anchors: DataFrame, placed: DataFrame, index: MultiIndex, *, want: int, same_label: bool, first_cells: int, vectors_block: int, anchors_block: int) -> DataFrame:
    """(row, tops) for anchors of (row, label, v, windows): the first ``want`` rows of each window, from its own label or from the others.

    Higher scores come first, ties by id; vectors of another length and the anchor itself don't count.
    """
    shared = anchors.sparkSession.sparkContext.broadcast(index)  # twice most_codes centroids and a flag for each cell at most
    part = F.col("label") if same_label else F.lit(0).cast("long")
    held = placed.withColumn("part", part)
    in_cell = durable(held.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("nv")))
    tops = durable(anchors.select("row", F.lit(None).cast(_TOPS).alias("tops")))
    visited, batch = 0, first_cells

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for rows in batches:
            vs = _matrix(rows.column("v"), index.width)
            made: dict[str, list] = {"at": [], "cell": [], "windows": []}

            def flushed(rows=rows, made=made) -> pa.RecordBatch:
                taken = rows.select(["row", "label", "v"]).take(pa.array(made["at"], pa.int64()))
                kind = rows.schema.field("windows").type
                out = pa.RecordBatch.from_arrays([*taken.columns, pa.array(made["cell"], pa.int64()), pa.array(made["windows"], kind)], names=["row", "label", "v", "cell", "windows"])
                for x in made.values():
                    x.clear()
                return out

            for at, (windows, found) in enumerate(zip(rows.column("windows").to_pylist(), rows.column("tops").to_pylist(), strict=True)):
                for w in windows:
                    scores = [t["score"] for t in found or () if t["k"] == w["k"]]
                    if len(scores) == want:
                        w["lo"] = max(w["lo"], min(scores))
                need = min((w["lo"] for w in windows), default=None)
                for number, (bound, cell) in enumerate(index.visits(vs[at])):
                    if need is None or bound < need or number >= visited + batch:
                        break
                    if number >= visited:
                        made["at"].append(at)
                        made["cell"].append(cell)
                        made["windows"].append(windows)
                        if len(made["at"]) >= 20_000:
                            yield flushed()
            if made["at"]:
                yield flushed()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_order(batches, ["cell", "part", "bq", "bv"]):
            asks = group.column("windows").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            if asks.all() or not asks.any():
                continue
            width = int(np.diff(group.column("v").combine_chunks().offsets.to_numpy()).max())
            size = np.diff(group.column("v").combine_chunks().offsets.to_numpy())
            x, label = _matrix(group.column("v"), width), group.column("label").to_numpy()
            ids, rows = group.column("id").to_numpy(zero_copy_only=False), group.column("row").to_numpy()
            q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
            m = m[np.lexsort((rows[m], ids[m]))]
            length = np.sqrt((x.astype(np.float64) ** 2).sum(1))
            exact = length[q].max() * length[m].max() < 2.0**52
            y = x.astype(np.float64) if exact else x
            windows = group.column("windows").combine_chunks().take(pa.array(q)).to_pylist()
            for a in range(0, len(q), 64):
                part = q[a : a + 64]
                scores = y[part] @ y[m].T
                out = ((label[part][:, None] == label[m][None, :]) != same_label) | (size[part][:, None] != size[m][None, :]) | (rows[part][:, None] == rows[m][None, :])
                scores[out] = np.nan if exact else _LEAST
                found = _best(rows[part], scores, ids[m].astype(np.int64), rows[m], windows[a : a + 64], want)
                if found["anchor"]:
                    yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int32() if n == "k" else pa.int64()) for n, c in found.items()})

    while visited < index.held.size:
        visits, _ = settle(anchors.join(tops, "row").mapInArrow(plan, f"row long, label long, v array<int>, cell long, windows {_WINDOWS}"))
        if visits.isEmpty():
            break
        asked = visits.withColumn("part", part)
        sizes = durable(asked.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("nq")).join(in_cell, ["cell", "part"]).withColumn("size", F.col("nq") + F.col("nv")))
        of = lambda n, most: F.pmod(F.xxhash64("row"), F.ceil(F.col(n) / most)).cast("int")
        every = lambda n, most: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / most) - 1).cast("int")))
        sized = lambda df: join_groups(df, sizes, ["cell", "part"], "size", ["row"]).where("nq is not null")
        common = ["row", "id", "label", "v", "cell", "part", "windows"]
        mine = sized(asked.withColumn("id", F.lit(None).cast("long"))).select(*common, of("nq", anchors_block).alias("bq"), every("nv", vectors_block).alias("bv"))
        other = sized(held.withColumn("windows", F.lit(None).cast(_WINDOWS))).select(*common, every("nq", anchors_block).alias("bq"), of("nv", vectors_block).alias("bv"))
        keys = ["cell", "part", "bq", "bv"]
        met = mine.unionByName(other).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compare, "anchor long, k int, score long, id long, row long")
        known = tops.select(F.col("row").alias("anchor"), F.explode("tops").alias("t")).select("anchor", "t.*")
        first = Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "id", "row")
        ranked = met.unionByName(known).withColumn("n", F.row_number().over(first)).where(F.col("n") <= want)
        # ``want`` rows of each of an anchor's windows.
        fresh = ranked.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(F.struct("k", "score", "id", "row")).cast(_TOPS).alias("fresh"))
        tops = durable(tops.join(fresh, "row", "left").select("row", F.coalesce("fresh", "tops").alias("tops")))
        visited, batch = visited + batch, batch * 4
    return tops


def hard_negatives(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    anchor: Column | None = None,
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = 50,
    high: int = 95,
    sample: int = SAMPLE,
    most_codes: int = MOST_CODES,
    per_cell: int = PER_CELL,
    first_cells: int = FIRST_CELLS,
    vectors_block: int = VECTORS,
    anchors_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score of each anchor's hard negatives.

    Components x become floor(scale * x), and a row's score is its inner product with
    the anchor.  Positives are an anchor's first ``positives`` other rows of its label,
    negatives of each the first ``negatives`` rows of other labels with a score from
    ``low`` to ``high`` per cent of the positive's (so one below zero has none); fewer
    if there are fewer.  Higher scores come first, ties by smaller id.  Anchors are the
    rows with an id that 50 divides unless a condition says otherwise.

    Rows without id or label, with a null vector or a null or non-finite component, and
    those of squared length 2^55 or more after scaling take no part.  Vectors of
    different length have no score; empty ones score 0.  Rows that repeat an id count as
    rows of their own.  An empty table has no rows; other columns are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label) if isinstance(label, str) else label
    anchor = F.col(id_col) % EVERY == 0 if anchor is None else anchor
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = vectors.where(sound & F.col(id_col).isNotNull() & label.isNotNull())
    kept = kept.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, lambda x: F.floor(scale * x)).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    short = F.aggregate(F.col("v"), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) < TOO_LONG
    rows = durable(kept.where(short).select(F.monotonically_increasing_id().alias("row"), "id", "label", F.col("v").cast("array<int>").alias("v"), "asks"))
    index, placed = _index(rows.drop("asks"), sample=sample, most_codes=most_codes, per_cell=per_cell)
    asking = rows.where("asks").drop("asks")
    sizes = {"first_cells": first_cells, "vectors_block": vectors_block, "anchors_block": anchors_block}

    whole = F.array(F.struct(F.lit(0).alias("k"), F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi"))).cast(_WINDOWS)
    found = _search(asking.withColumn("windows", whole), placed, index, want=positives, same_label=True, **sizes)
    order = lambda t: F.struct((-t["score"]).alias("s"), t["id"].alias("i"), t["row"].alias("r"))
    ranked = durable(found.select("row", F.posexplode(F.array_sort(F.transform("tops", order))).alias("k", "t")).select("row", "k", (-F.col("t.s")).alias("score"), F.col("t.i").alias("id")))
    # The bounds are whole numbers: up from low * score / 100, and down from high * score / 100.
    window = F.struct("k", F.expr(f"(score * {low} + pmod(-score * {low}, 100)) div 100").alias("lo"), F.expr(f"(score * {high} - pmod(score * {high}, 100)) div 100").alias("hi"))
    windows = ranked.withColumn("w", window).where("w.lo <= w.hi").groupBy("row").agg(F.collect_list("w").cast(_WINDOWS).alias("windows"))
    mined = _search(asking.join(windows, "row"), placed, index, want=negatives, same_label=False, **sizes)
    nearest = mined.select("row", F.explode("tops").alias("t")).select("row", "t.k", "t.score", "t.id", F.col("t.row").alias("other"))
    rank = F.row_number().over(Window.partitionBy("row", "k").orderBy(F.desc("score"), "id", "other"))
    negative = nearest.select("row", "k", rank.cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    positive = ranked.select("row", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    met = positive.join(negative, ["row", "k"]).join(asking.select("row", F.col("id").alias("anchor_id")), "row")
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
