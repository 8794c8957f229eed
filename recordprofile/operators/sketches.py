"""Sketches of paths: estimates in place of exact counts and quantiles, for where these cost too much.

A path's sketches have a few kilobytes at any number of rows and merge without the
leaves, so each part, day or source can keep its own.  HyperLogLog estimates how many
different documents and values a path has (standard error about 1.04 / sqrt(2^lg_k)), KLL the
quantiles of its numbers (ranks off by about 1.3 % with k = 200).  The exact forms in
``profile`` stay the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^12 registers: a standard error of 1.6 %.
LG_K, KLL_K = 12, 200


def path_sketches(eav: DataFrame, *by: str, lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """One row by path (and ``by``): leaves, and sketches of its documents, values and numbers.

    Null values count in leaves and documents alone.  A path without numbers has no
    sketch of them.  Text that reads as a number counts as one only where it is JSON's.
    """
    number = F.when(F.col("value_type") == "number", F.expr("try_cast(value AS double)"))
    return eav.groupBy(*by, "path").agg(
        F.count(F.lit(1)).alias("leaves"), F.hll_sketch_agg("version_key", lg_k).alias("documents"), F.hll_sketch_agg("value", lg_k).alias("values"),
        F.kll_sketch_agg_double(number, k).alias("numbers"),
    )


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of what is left of the keys: those of parts, days or sources become those of all."""
    return sketches.groupBy(*by, "path").agg(
        F.sum("leaves").alias("leaves"), F.hll_union_agg("documents").alias("documents"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("numbers").alias("numbers"),
    )


def estimates(sketches: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """``sketches`` with documents and different_values estimated, and quantiles (array, null without numbers)."""
    kept = [c for c in sketches.columns if c not in ("documents", "values", "numbers")]
    at = F.array(*[F.lit(q) for q in quantiles])
    return sketches.select(
        *kept, F.hll_sketch_estimate("documents").alias("documents"), F.hll_sketch_estimate("values").alias("different_values"), _having(F.kll_sketch_get_quantile_double("numbers", at)).alias("quantiles"),
    )


def _having(found: Column) -> Column:
    return F.when(F.kll_sketch_get_n_double("numbers") > 0, found)
