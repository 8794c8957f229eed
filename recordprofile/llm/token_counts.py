"""Exact token counts from a length histogram.

Documents are tokenised once, and only the histogram of their encoded lengths
(aggregated before the shuffle) goes on.  Suffix sums over it answer, for every
context limit, how many documents and tokens exceed it and what remains when
documents are cut at it; prefix sums answer quantiles.  The histogram has at most
as many rows as there are different lengths, and its sums run in blocks of
lengths, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import worker_bpe
from .common import durable

LENGTHS_PER_BLOCK = 4096


def encoded_lengths(docs: DataFrame, *, text_col: str = "text", path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One column, length: the ids of each text under the vocabulary; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, ranks_path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"length": pa.array([len(bpe.ids(t.as_py())) for t in batch.column(0)], pa.int64())})

    return docs.select(text_col).mapInArrow(run, "length long")


def length_histogram(docs: DataFrame, **options) -> DataFrame:
    """(length, n_docs) over all documents."""
    counted = encoded_lengths(docs, **options).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))
    # Written once: what reads it must not tokenise again.
    return durable(counted)


def _sums(sized: DataFrame) -> DataFrame:
    """``sized`` (length, n_docs, tokens, ...) with docs_within, tokens_within, d_all and t_all: sums over all lengths up to each, in blocks of lengths."""
    blocked = sized.withColumn("__block", F.floor(F.col("length") / LENGTHS_PER_BLOCK))
    # A row per block of lengths.
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = (
        blocked.groupBy("__block")
        .agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
        .select(
            "__block",
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "dt"],
            *[F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"],
        )
    )
    within = Window.partitionBy("__block").orderBy("length").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        blocked.join(blocks, "__block")
        .withColumn("docs_within", F.col("d_before") + F.sum("n_docs").over(within))
        .withColumn("tokens_within", F.col("t_before") + F.sum("tokens").over(within))
    )


def length_report(histogram: DataFrame) -> DataFrame:
    """For each length in the histogram, taken as context limit L:

    n_docs and tokens of that length; docs_within and tokens_within (length <= L);
    docs_over and tokens_over, the suffix sums (length > L); truncated_total, the
    tokens left when longer documents are cut at L; and quantile, the part of
    documents within L.  An empty table has no rows; null and empty texts have length
    0; repeated rows and texts of any length count as they are.
    """
    sized = histogram.withColumn("tokens", F.col("length") * F.col("n_docs"))
    return (
        _sums(sized)
        .withColumn("docs_over", F.col("d_all") - F.col("docs_within"))
        .withColumn("tokens_over", F.col("t_all") - F.col("tokens_within"))
        .withColumn("truncated_total", F.col("tokens_within") + F.col("length") * F.col("docs_over"))
        .withColumn("quantile", F.col("docs_within") / F.col("d_all"))
        .select(
            "length", "n_docs", "tokens", "docs_within", "tokens_within", "docs_over", "tokens_over", "truncated_total", "quantile"
        )
    )


def answers(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` (column: limit) with docs_over and truncated_total; any limit, seen as a length or not.

    The limits are lengths without documents in the same sums, so nothing is compared
    pair by pair.  Of an empty table all answers are 0; a null limit has none.
    """
    lengths = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.lit(False).alias("asked"))
    asked = limits.where("limit is not null").select(F.col("limit").cast("long").alias("length"), F.lit(0).cast("long").alias("n_docs"), F.lit(0).cast("long").alias("tokens"), F.lit(True).alias("asked"))
    over = F.col("d_all") - F.col("docs_within")
    found = _sums(lengths.unionByName(asked)).where("asked")
    return found.select(F.col("length").alias("limit"), over.alias("docs_over"), (F.col("tokens_within") + F.col("length") * over).alias("truncated_total"))

