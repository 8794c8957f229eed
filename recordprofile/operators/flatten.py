"""JSON payloads to one row per leaf: (keys..., path, path_indexed, value, value_type).

The payload is parsed once to a variant and exploded level by level with outer
generators, in one stage without a shuffle; a row that does not explode is a finished
leaf and passes through.  Where the caller states a depth there are so many levels and
nothing is written.  Otherwise levels come in blocks: a block writes its rows to a
durable table, finished leaves stay there, and only rows that still hold containers go
through the next block.  So payloads of any depth are flattened, their plan never grows,
and typical ones, no deeper than a block, take one pass.  Empty containers and nulls
are leaves.  Number text is Spark's (1.0 is written 1).  Of duplicate object keys the
last one counts where the session allows them (``spark.sql.variant.allowDuplicateKeys``);
otherwise they fail the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordprofile.functions.values import leaf_text, leaf_type
from recordprofile.sources import files

#: Levels of the first block, which typical payloads do not exceed, and of each further one, which few rows reach.
BLOCK_LEVELS, MORE_LEVELS = 5, 25


def flatten_leaves(
    df: DataFrame,
    payload: str = "payload",
    keys: Sequence[str] = ("version_key",),
    *,
    excluded_fields: Sequence[str] = (),
    max_depth: int | None = None,
    lenient: bool = False,
) -> DataFrame:
    """Leaves of every payload that is not null.

    A payload that isn't JSON fails the query, or with ``lenient`` (which also leaves
    out payloads that aren't objects) has no rows.  ``excluded_fields`` are dropped at
    the top level; a record left without members is one empty object at path ''.
    With ``max_depth`` the result is a plan that flattens so many levels, and payloads
    nested deeper fail the query.  Without it any depth is flattened at once, to a table
    in the folder that executors share (Spark's JSON parser ends at about 1000 levels).
    """
    parsed = F.try_parse_json(payload) if lenient else F.parse_json(payload)
    rows = df.where(F.col(payload).isNotNull())
    if excluded_fields:
        names = F.array(*[F.lit(f) for f in excluded_fields])
        members = F.json_object_keys(payload)
        bare = (F.size(members) > 0) & (F.size(F.array_except(members, names)) == 0)
        parsed = F.when(F.coalesce(bare, F.lit(False)), F.parse_json(F.lit("{}"))).otherwise(parsed)
    rows = rows.select(*keys, parsed.alias("v"))
    if lenient:
        rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = rows.select(*keys, F.lit("").alias("path"), F.lit("").alias("path_indexed"), "v", F.lit(False).alias("done"))
    if max_depth is None:
        return _any_depth(rows, keys, excluded_fields)
    rows = _levels(rows, keys, max_depth, excluded_fields)
    kind = leaf_type(F.col("v"))
    too_deep = ~F.col("done") & kind.isin("object-empty", "array-empty")
    kind = F.when(too_deep, F.raise_error(F.lit(f"payload is nested deeper than {max_depth} levels"))).otherwise(kind)
    return rows.select(*keys, "path", "path_indexed", leaf_text(F.col("v")).alias("value"), kind.alias("value_type"))


def _levels(rows: DataFrame, keys: Sequence[str], levels: int, excluded_fields: Sequence[str] = ()) -> DataFrame:
    """Rows of (keys, path, path_indexed, v, done) so many levels further; ``excluded_fields`` go at the first one."""
    for level in range(levels):
        child = rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "key", "child")
        exploded = rows.lateralJoin(child)
        if level == 0 and excluded_fields:
            exploded = exploded.where(F.col("key").isNull() | ~F.col("key").isin(list(excluded_fields)))
        leaf, element = F.col("pos").isNull(), F.col("key").isNull()
        dotted = F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        dotted_indexed = F.when(F.col("path_indexed") == "", F.col("key")).otherwise(F.concat("path_indexed", F.lit("."), "key"))
        rows = exploded.select(
            *keys,
            F.when(leaf, F.col("path")).when(element, F.concat("path", F.lit("[]"))).otherwise(dotted).alias("path"),
            F.when(leaf, F.col("path_indexed")).when(element, F.concat("path_indexed", F.lit("["), "pos", F.lit("]"))).otherwise(dotted_indexed).alias("path_indexed"),
            F.when(leaf, F.col("v")).otherwise(F.col("child")).alias("v"),
            leaf.alias("done"),
        )
    return rows


def _any_depth(rows: DataFrame, keys: Sequence[str], excluded_fields: Sequence[str]) -> DataFrame:
    """All leaves, a block of levels after the other; what is still open after a block is written as text."""
    spark, paths = rows.sparkSession, []
    while True:
        rows = _levels(rows, keys, MORE_LEVELS if paths else BLOCK_LEVELS, () if paths else excluded_fields)
        kind = leaf_type(F.col("v"))
        rest = F.when(~F.col("done") & kind.isin("object-empty", "array-empty"), F.to_json("v"))
        block = rows.select(*keys, "path", "path_indexed", leaf_text(F.col("v")).alias("value"), kind.alias("value_type"), rest.alias("__rest"))
        # An empty container is a leaf wherever it comes.
        block = block.withColumn("__rest", F.when(~F.col("__rest").isin("{}", "[]"), F.col("__rest")))
        paths.append(files.scratch(spark))
        block.write.parquet(paths[-1])
        opened = spark.read.schema(block.schema).parquet(paths[-1]).where("__rest is not null")
        if opened.isEmpty():
            return spark.read.schema(block.schema).parquet(*paths).where("__rest is null").drop("__rest")
        rows = opened.select(*keys, "path", "path_indexed", F.parse_json("__rest").alias("v"), F.lit(False).alias("done"))


def leaf_print() -> Column:
    """An aggregate over a payload's leaves that tells different sets of leaves apart, whatever order they come in."""
    leaf = ("path_indexed", "value", "value_type")
    h, g = F.xxhash64(*leaf), F.xxhash64(F.lit("leaf"), *leaf)
    # Of the second hash 40 bits are summed, so that a payload that stands twice does not cancel out.
    return F.struct(F.bit_xor(h).alias("h"), F.sum(F.pmod(g, F.lit(1 << 40))).alias("g"))


def leaf_prints(df: DataFrame, payload: str = "payload", keys: Sequence[str] = ("version_key",), *, max_depth: int | None = None) -> DataFrame:
    """(keys..., leaf_print) of every payload that is not null.  Leaves meet where they are made, so a small row for each payload is all that shuffles."""
    return flatten_leaves(df, payload, keys, max_depth=max_depth).groupBy(*keys).agg(leaf_print().alias("leaf_print"))
