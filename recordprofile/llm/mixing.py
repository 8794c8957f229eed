"""Mixing sources to target weights with DataFrame functions only.

Each row gets a hash-random key, whose leading bits put it in a range of its
source.  Sums of the ranges (aggregated before the shuffle), summed along the
source, say in which range its budget ends.  Only that one range of each source
is sorted, and its running sums give the row at which the budget ends.  A row's
share then follows from comparing its own key with that row's: no document moves
between executors, and a source that holds most rows is cut like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Ranges of the key in each source at least, and rows that one range should hold: the range in which a budget ends is sorted in one task.
RANGES, ROWS_PER_RANGE = 4096, 50_000
KEY_BITS = 60
_SPACE = "\\x20\\x09-\\x0D"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_SPACE}]+")), F.lit(0)).cast("long")


def random_key(seed: int, id_: Column, size: Column) -> Column:
    """A uniform number of KEY_BITS bits by which SQL elsewhere can follow the order."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null")), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.regexp_extract_all(text, F.lit(f"[{_SPACE}]*[^{_SPACE}]+"), F.lit(0))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")


def source_targets(
    sizes: DataFrame,
    *,
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per source: source_size and target, from rows of (source, source_size).

    Weights repeat along the sources by code point, null last.  ``share`` of all sizes
    goes to the sources by weight, none above ``most`` times its size; what is over
    goes to the others by weight.  Sorted by size for weight, the sources at their
    bound come first, and the rest get one common rate: the first rate that leaves
    the next source below its bound.
    """
    rank = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__w", table[(rank % len(weights)).cast("int")])
    bound = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(F.col("__ratio"), F.col(source_col).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    laid = (
        ranked.withColumn("__bound", bound)
        .withColumn("__ratio", F.col("__bound") / F.col("__w"))
        .withColumn("__total", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("__rate", (F.col("__total") - F.coalesce(F.sum("__bound").over(before), F.lit(0.0))) / F.sum("__w").over(onward))
    )
    free = F.min(F.when(F.col("__rate") <= F.col("__ratio"), F.struct("__ratio", "__rate"))).over(whole)["__rate"]
    return laid.withColumn("target", F.coalesce(F.least(F.col("__bound"), free * F.col("__w")), F.col("__bound"))).select(
        source_col, "source_size", "target"
    )


def shares(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    ranges: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): id, s, size and key of every row, durable, and the plan that ``_taken`` applies, a row per source.

    The words are counted once, for the rows; all sums come from them.
    """
    size = word_count(F.col(text_col))
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), size.alias("size"))
    rows = durable(narrow.withColumn("key", random_key(seed, F.col("id"), F.col("size"))))
    ranges = ranges or max(RANGES, rows.count() // ROWS_PER_RANGE)
    ranged = rows.withColumn("r", F.shiftright("key", KEY_BITS - (ranges - 1).bit_length()))
    sums = durable(ranged.groupBy("s", "r").agg(F.sum("size").alias("size")))
    targets = source_targets(
        sums.groupBy("s").agg(F.sum("size").alias("source_size")), source_col="s", weights=weights, share=share, most=most
    )
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("x.s").eqNullSafe(F.col("t.s"))
    ending = durable(
        sums.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .alias("x")
        .join(targets.alias("t"), same)
        .where("start <= rest and rest < start + size")
        .select("x.s", "r", (F.col("rest") - F.col("start")).alias("left"))
    )
    # Rows with one key count as one: they share the key's part by their sizes, which are alike.
    inside = (
        ranged.alias("a")
        .join(ending.alias("e"), F.col("a.s").eqNullSafe(F.col("e.s")) & (F.col("a.r") == F.col("e.r")))
        .groupBy("a.s", "left", "key")
        .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    )
    running = Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        inside.withColumn("start", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .where("start <= left and left < start + size")
        .select("s", F.col("key").alias("cut_key"), ((F.col("left") - F.col("start")) / F.col("n")).cast("long").alias("part"))
    )
    # A row per source, durable so that its known size decides whether the join broadcasts it.
    plan = durable(
        targets.alias("t")
        .join(cut.alias("c"), F.col("t.s").eqNullSafe(F.col("c.s")), "left")
        .select(F.col("t.s").alias("plan_s"), F.col("source_size").alias("plan_size"), F.col("target").alias("plan_target"), "epochs", "rest", "cut_key", "part")
    )
    return rows, plan


def _taken(rows: DataFrame, plan: DataFrame, *, source: str, size: str, key: str, into: Sequence[str]) -> DataFrame:
    """``rows`` with source_size, target and taken under the names ``into``; ``rows`` has no column of the plan's names."""
    place, end = F.col(key), F.col("cut_key")
    more = (
        F.when(F.col("rest") == 0, F.lit(0))
        .when(F.col("cut_key").isNull(), F.lit(0))
        .when(place < end, F.col(size))
        .when(place == end, F.col("part"))
        .otherwise(F.lit(0))
    )
    joined = rows.join(plan, F.col(source).eqNullSafe(F.col("plan_s")), "left")
    taken = (F.col("epochs") * F.col(size) + more).cast("long")
    return joined.select(*rows.columns, F.col("plan_size").alias(into[0]), F.col("plan_target").alias(into[1]), taken.alias(into[2]))


def mixed_sizes(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``mix`` without the documents' other columns: id, size, source_size, target and taken; every text is read once."""
    rows, plan = shares(docs, id_col=id_col, **options)
    found = _taken(rows, plan, source="s", size="size", key="key", into=("source_size", "target", "taken"))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _with_shares(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, seed: int, **options) -> DataFrame:
    """``docs``, its columns renamed to c0, c1, ..., with size, source_size, target and taken."""
    _rows, plan = shares(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    sized = docs.toDF(*name.values()).withColumn("size", word_count(F.col(name[text_col])))
    sized = sized.withColumn("key", random_key(seed, F.col(name[id_col]), F.col("size")))
    return _taken(sized, plan, source=name[source_col], size="size", key="key", into=("source_size", "target", "taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """``docs`` with size, source_size, target (double) and taken (long, words the mix takes).

    A source's taken words add up to its target's whole part: every document as often
    as the target holds the whole source, then documents in the order of their keys
    up to the budget, the last one in part.  Keys come from id, size and seed, so
    reruns agree; of rows alike in these the cut takes equal parts.  Null texts and texts
    without words have size 0 and are never taken; a null source is a source; an empty
    table has no rows.  The four names replace columns of the same name.
    """
    found = _with_shares(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    kept = [(c, f"c{k}") for k, c in enumerate(docs.columns) if c.lower() not in ("size", "source_size", "target", "taken")]
    return found.select(*[F.col(v).alias(c) for c, v in kept], "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``, whatever their names: each document as often as it is taken whole, then the part that is taken in part.

    ``length_col``, if there is one, is counted anew for parts.
    """
    found = _with_shares(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options).where("taken > 0")
    times = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    copies = found.withColumn("nth", F.explode(times))
    words = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size"))
    whole = F.col(f"c{docs.columns.index(text_col)}")
    text = F.when(words < F.col("size"), first_words(whole, words)).otherwise(whole)
    shown = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)} | {text_col: text}
    if length_col in shown:
        length = F.char_length(text).cast(docs.schema[length_col].dataType)
        shown[length_col] = F.when(words < F.col("size"), length).otherwise(shown[length_col])
    return copies.select(*[v.alias(c) for c, v in shown.items()])
