"""Near-duplicate vectors: product quantisation over coarse inverted lists.

A bounded sample trains coarse centroids and, on what they leave over, a codebook for
each subspace.  Where a table needs more lists than there are coarse centroids, each
of them is divided by one second set of centroids, trained on what the first leaves
over; so lists keep their length while the table grows.  Every vector is then coded
and put in its nearest list, and as a query it visits its ``probes`` nearest ones.  Within a
list, table look-ups give the distance from each query to each coded vector; no true
distance is shorter than that less the vector's own coding error, so the look-ups
drop no link.  What they leave is ranked again by the exact cosine.

Equal vectors count as one with a weight.  A pair found from both sides counts once
for each: a vector that does not visit its partner's list learns of the link where
the partner visits its own.  Links are counted within the tasks and not listed, and
long lists are dealt out in blocks of vectors and of queries.  Vectors of different
length have an index each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, forest, groups_in_order, join_groups

THRESHOLD = 0.9
SUBSPACES, CODES = 8, 256
#: Vectors in the training sample, centroids of a level at most (so their square is the number of lists at most), and vectors that a list should hold.
SAMPLE, MOST_LISTS, PER_LIST = 16_384, 4096, 128
PROBES = 12
BLOCK = 1024


def _nearest(x: np.ndarray, centers: np.ndarray, k: int = 1) -> np.ndarray:
    d = (centers**2).sum(1)[None, :] - 2 * (x @ centers.T)
    if k == 1:
        return d.argmin(1)[:, None]
    k = min(k, len(centers))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[a : a + 4096], centers)[:, 0] for a in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(centers))
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.searchsorted(own[order], filled), axis=0)
        centers[filled] = sums / n[filled, None]
    return centers


@dataclass(frozen=True)
class Index:
    centers: np.ndarray  # coarse centroids x dimension
    finer: np.ndarray  # second centroids x dimension; one of zeros where there is no second level
    books: np.ndarray  # subspaces x codes x part

    def center(self, lists: np.ndarray | int) -> np.ndarray:
        """The centre of each list: coarse number times the count of second ones, plus the second number."""
        return self.centers[lists // len(self.finer)] + self.finer[lists % len(self.finer)]

    def lists(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest lists (fewer if there are fewer) of each row, nearest first."""
        coarse = _nearest(x, self.centers, k)
        if len(self.finer) == 1:
            return coarse
        rows = np.arange(len(x))[:, None]
        found, far = [], []
        for c in range(coarse.shape[1]):
            rest = x - self.centers[coarse[:, c]]
            d = (self.finer**2).sum(1)[None, :] - 2 * (rest @ self.finer.T) + (rest**2).sum(1)[:, None]
            near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            found.append(coarse[:, c : c + 1] * len(self.finer) + near)
            far.append(d[rows, near])
        found, far = np.concatenate(found, axis=1), np.concatenate(far, axis=1)
        return found[rows, np.argsort(far, axis=1, kind="stable")[:, :k]]

    def parts(self, x: np.ndarray) -> np.ndarray:
        """x cut into subspaces, padded with zeros where they don't divide the dimension."""
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of unit vectors in their lists, and each one's distance from what its code says."""
        rest = self.parts(x - self.center(lists))
        codes = np.stack([_nearest(rest[:, m], self.books[m])[:, 0] for m in range(len(self.books))], axis=1)
        said = np.stack([self.books[m][codes[:, m]] for m in range(len(self.books))], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - said) ** 2).sum((1, 2)))

    def distances(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances: exact queries to coded vectors of one list, by table look-up."""
        rest = self.parts(queries - self.center(list_))
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, book in enumerate(self.books):
            table = ((rest[:, m, None, :] - book[None]) ** 2).sum(2, dtype=np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(total)


def train(sample: np.ndarray, lists: int, *, most: int, subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = 6, seed: int = 5) -> Index:
    """An index from unit vectors, with about so many lists, in two levels where they are more than ``most``."""
    centers = _kmeans(sample, min(lists, most), rounds, seed)
    rest = sample - centers[np.concatenate([_nearest(sample[a : a + 4096], centers)[:, 0] for a in range(0, len(sample), 4096)])]
    finer = np.zeros((1, sample.shape[1]))
    if lists > most:
        finer = _kmeans(rest, min(-(-lists // most), most), rounds, seed + 100)
    plain = Index(centers, finer, np.zeros((1, 1, sample.shape[1])))
    near = np.concatenate([plain.lists(sample[a : a + 2048], 4)[:, 0] for a in range(0, len(sample), 2048)])
    rest = sample - plain.center(near)
    width = -(-sample.shape[1] // subspaces)
    rest = np.pad(rest, ((0, 0), (0, subspaces * width - rest.shape[1]))).reshape(len(rest), subspaces, width)
    books = [_kmeans(rest[:, m], codes, rounds, seed + m) for m in range(subspaces)]
    fill = max(len(b) for b in books)
    return Index(centers, finer, np.stack([np.pad(b, ((0, fill - len(b)), (0, 0)), mode="edge") for b in books]))


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def linked_vectors(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    probes: int = PROBES,
    sample: int = SAMPLE,
    per_list: int = PER_LIST,
    most_lists: int = MOST_LISTS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept.

    n_links counts the other vectors found with a cosine (in double precision) from
    the threshold on; component_id is the smallest id reachable by links.  Vectors
    that are null, empty, zero or hold null or non-finite components link with
    nothing, and neither do rows without an id; vectors of different length don't link
    with each other.  An empty table has no rows; other columns are left out.  Rows
    that repeat an id count as vectors of their own, with that id.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    usable = rows.where(sound & F.col("id").isNotNull())
    # As many as there are different lengths, each of which has an index.
    lengths = sorted(r[0] for r in usable.select(F.size("v")).distinct().collect())
    alone = [F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept")]
    out = rows.where(~(sound & F.col("id").isNotNull())).select(alone)
    for length in lengths:
        part = usable if len(lengths) == 1 else usable.where(F.size("v") == length)
        found = _linked(part, threshold=threshold, probes=probes, sample=sample, per_list=per_list, most_lists=most_lists, block=block)
        alike = found.select(F.col("id").alias(id_col), "n_links", "component_id")
        out = alike.withColumn("kept", F.col(id_col) == F.col("component_id")).unionByName(out)
    return out


def _linked(usable: DataFrame, *, threshold: float, probes: int, sample: int, per_list: int, most_lists: int, block: int) -> DataFrame:
    """(id, n_links, component_id) of (id, v), sound vectors of one length."""
    # Equal vectors fold into one of their own number, which is written down with them; ids may repeat.
    folded = usable.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
    folded, kind = durable(folded.withColumn("rep", F.monotonically_increasing_id())), "long"
    different = folded.count()
    # At most ``sample`` rows.
    drawn = folded.orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toArrow().column("v")
    unit = _vectors(drawn)
    scale = lambda x: x / np.abs(x).max(1, keepdims=True)  # noqa: E731  keeps squares in range
    norm = lambda x: (y := scale(x)) / np.sqrt((y**2).sum(1, keepdims=True))
    index = train(norm(unit), max(1, round(different / per_list)), most=most_lists)
    shared = usable.sparkSession.sparkContext.broadcast(index)  # twice most_lists centroids at most
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = norm(_vectors(part.column(0)))
                near = index.lists(x, probes)
                codes, error = index.encode(x, near[:, 0])
                yield pa.RecordBatch.from_pydict(
                    {
                        "rep": part.column(1), "size": part.column(2),
                        "unit": pa.array([r.tobytes() for r in x], pa.binary()),
                        "code": pa.array([r.tobytes() for r in codes], pa.binary()),
                        "error": pa.array(error),
                        "lists": pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())),
                    }
                )

    placed = durable(folded.select("v", "rep", "size").mapInArrow(place, f"rep {kind}, size long, unit binary, code binary, error double, lists array<int>"))
    visits = placed.select("rep", F.explode("lists").alias("list"))
    held = placed.select("rep", F.col("lists")[0].alias("list"))
    sizes = durable(
        visits.withColumn("q", F.lit(1)).unionByName(held.withColumn("q", F.lit(0))).groupBy("list").agg(F.sum("q").alias("nq"), F.sum(1 - F.col("q")).alias("nv")).where("nv > 0")
    )
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    of = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    # A row per list that holds vectors; Spark knows the size of the table and joins accordingly.
    small = sizes
    dealt = (
        visits.join(small, "list").select("rep", "list", of("nq").alias("bq"), every("nv").alias("bv"), F.lit(True).alias("query"))
    ).unionByName(held.join(small, "list").select("rep", "list", every("nq").alias("bq"), of("nv").alias("bv"), F.lit(False).alias("query")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for group in groups_in_order(batches, ["list", "bq", "bv"]):
            query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
            if query.all() or not query.any():
                continue
            list_ = group.column("list")[0].as_py()
            x = np.stack([np.frombuffer(u.as_buffer(), np.float64) for u in group.column("unit").combine_chunks()])
            ids, weight = group.column("rep").combine_chunks(), group.column("size").to_numpy()
            q, m = np.flatnonzero(query), np.flatnonzero(~query)
            codes = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in group.column("code").combine_chunks().take(pa.array(m))])
            error = group.column("error").to_numpy()[m]
            visited = np.array(group.column("lists").combine_chunks().flatten()).reshape(len(query), -1)
            _, same = np.unique(np.array(ids.to_pylist(), dtype=object).astype(str), return_inverse=True)
            found = []
            for a in range(0, len(q), 256):
                part = q[a : a + 256]
                i, j = np.nonzero(index.distances(x[part], list_, codes) <= radius + error[None, :] + 1e-4)
                i, j = part[i], m[j]
                apart = same[i] != same[j]
                i, j = i[apart], j[apart]
                for b in range(0, len(i), 100_000):
                    s = slice(b, b + 100_000)
                    near = np.einsum("ij,ij->i", x[i[s]], x[j[s]]) >= threshold
                    found.append((i[s][near], j[s][near]))
            i, j = (np.concatenate(side) for side in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
            if not len(i):
                continue
            links = np.bincount(i, weight[j], len(query))
            # The vector learns of the link here unless it visits the query's own list.
            unseen = ~(visited[j] == visited[i, :1]).any(1)
            links += np.bincount(j[unseen], weight[i[unseen]], len(query))
            root = forest(len(query), np.append(i, np.arange(len(query))), np.append(j, np.unique(same, return_index=True)[1][same]))
            child = np.flatnonzero((links > 0) | np.isin(np.arange(len(query)), j))
            yield from pa.table({"u": ids.take(pa.array(child)), "v": ids.take(pa.array(root[child])), "links": pa.array(links[child].astype(np.int64))}).to_batches()

    payload = dealt.join(placed, "rep").repartition("list", "bq", "bv").sortWithinPartitions("list", "bq", "bv", "query", "rep")
    counted = durable(payload.mapInArrow(look_up, f"u {kind}, v {kind}, links long"))
    links = counted.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    parts = durable(components(counted, "u", "v").select(F.col("id").alias("rep"), "component"))
    least = parts.join(folded.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    parts = parts.join(least, "component").select("rep", "component_id")
    found = (
        folded.join(links, "rep", "left")
        .join(parts, "rep", "left")
        .where("size > 1 or links is not null")
        .select("v", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    )
    found = durable(found.withColumn("size", F.col("n_links")))
    alike = join_groups(usable, found, ["v"], "size", ["id"])
    return alike.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
