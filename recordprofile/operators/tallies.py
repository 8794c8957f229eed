"""Counts from which a field report follows, which add up.

A tally says how often something occurs: a path in the leaves, or a top element of a
document's field (with what the report needs of it).  The tally of a corpus is the sum
of those of its parts, and documents that go are taken off by adding theirs with the
sign turned; what comes to 0 is gone.  So smallest and largest numbers, samples, member
lists and counts of different values follow exactly after any run of updates, from
tables that hold one row for each different thing of a part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordprofile.operators import profile

KEYS = ("path", "field", "is_item", "kind", "value", "h", "g", "n")
TALLY_SCHEMA = "path string, field string, is_item boolean, kind string, value string, h long, g long, n int, times long"


def tally(eav: DataFrame) -> DataFrame:
    """(KEYS, times): one row for each different path, and for each different element of a field."""
    paths = eav.groupBy("path").agg(F.count(F.lit(1)).alias("times"))
    elements = profile.field_elements(eav).groupBy(*KEYS[1:]).agg(F.count(F.lit(1)).alias("times"))
    return _shaped(paths.unionByName(elements, allowMissingColumns=True))


def taken_off(tallied: DataFrame) -> DataFrame:
    return tallied.withColumn("times", -F.col("times"))


def merged(*tallied: DataFrame) -> DataFrame:
    """The sum of tallies, without what came to 0.

    Rows meet by what tells things apart, so that the report's grouping by thing needs
    no shuffle of its own; the rows of a part differ, so there is little to add before.
    """
    rows = reduce(DataFrame.unionByName, tallied).repartition("path", "field", "is_item", "value", "h", "g")
    return _shaped(rows.groupBy(*KEYS).agg(F.sum("times").alias("times")).where("times <> 0"))


def report(summed: DataFrame, total: int) -> DataFrame:
    """The schema overview of ``total`` documents from their merged tally."""
    elements = summed.where("field is not null")
    things = elements.groupBy("path", "field", "is_item", "value", "h", "g").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("docs"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum(F.col("n") * F.col("times")).alias("all"),
        *[F.sum(F.when(F.col("kind") == t, F.col("times"))).alias(f"of_{t}") for t in profile.LEAF_TYPES],
    )
    spark = summed.sparkSession
    return profile.overview(summed.where("path is not null").select("path"), things, spark.range(1).select(F.lit(total).cast("long").alias("total")))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (c.split() for c in TALLY_SCHEMA.split(", "))])
