"""What a run changed: its records against the version each had before.

The rows of both sides are found in metadata first, and payloads then read of just
their files and runs.  Pairs of equal payload text are unchanged without being parsed.
Both sides of the others are flattened together and meet leaf by leaf in one grouping;
nothing but the report's few rows needs to reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordprofile.operators.flatten import flatten_leaves, leaf_prints
from recordprofile.operators.history import run_header
from recordprofile.sources import files
from recordprofile.sources.versions import metadata_only, newest_first, pruned

STATUSES = ("added", "modified", "unchanged", "deleted")


def touched_records(versions: DataFrame, run_id: str) -> DataFrame:
    """(record_id, action, run_offset) of the run's records; of several rows the one with the highest (offset, filename) counts."""
    last = F.max_by(F.struct("action", "run_record_offset"), F.struct("run_record_offset", "filename"))
    run = metadata_only(versions).where(F.col("run_id") == run_id)
    return run.groupBy("record_id").agg(last.alias("t")).select("record_id", "t.action", F.col("t.run_record_offset").alias("run_offset"))


def prior_versions(versions: DataFrame, run_id: str) -> DataFrame:
    """(record_id, prev_run_id, prev_offset, prev_run_date, prev_filename): the newest version strictly before the run's last timestamp."""
    meta = metadata_only(versions)
    run = meta.where(F.col("run_id") == run_id)
    # One row.
    end = F.broadcast(run.agg(F.max("run_timestamp").alias("__end")))
    before = meta.join(run.select("record_id"), "record_id", "left_semi").crossJoin(end).where(F.col("run_timestamp") < F.col("__end"))
    newest = F.row_number().over(Window.partitionBy("record_id").orderBy(*newest_first()))
    return (
        before.withColumn("__n", newest)
        .where("__n = 1")
        .select(
            "record_id", F.col("run_id").alias("prev_run_id"), F.col("run_record_offset").alias("prev_offset"),
            F.col("run_date").cast("string").alias("prev_run_date"), F.col("filename").alias("prev_filename"),
        )
    )


#: What names a version's row, offsets starting again in each file.
ROW = ("source", "run_date", "run_id", "run_record_offset", "filename")


def run_keys(versions: DataFrame, run_id: str) -> DataFrame:
    """(record_id, action, run_offset, new, old) of the run's records, from metadata, as a durable table.

    ``new`` and ``old`` name the rows of the run's version and of the newest one strictly
    before the run's last timestamp, with their actions; ``old`` is null if there is none.
    """
    meta = metadata_only(versions)
    # The run's own rows are read once; they serve three times.
    run = files.settled(meta.where(F.col("run_id") == run_id))
    # One row; as a literal it reaches the scan of the earlier versions.
    end = run.agg(F.unix_micros(F.max("run_timestamp"))).first()[0]
    row = F.struct(*ROW, "action")
    touched = run.groupBy("record_id").agg(F.max_by(row, F.struct("run_record_offset", "filename")).alias("new"))
    # Nulls are the smallest parts of a struct, as nulls come last from the newest on.
    age = F.struct("run_timestamp", "run_id", "run_record_offset", "filename")
    earlier = meta.where(F.col("run_timestamp") < F.timestamp_micros(F.lit(end).cast("long"))).join(run.select("record_id"), "record_id", "left_semi")
    old = earlier.groupBy("record_id").agg(F.max_by(row, age).alias("old"))
    found = touched.join(old, "record_id", "left")
    return files.settled(found.select("record_id", "new.action", F.col("new.run_record_offset").alias("run_offset"), "new", "old"))


def needles(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """(record_id, side, payload) of the rows that ``new`` and ``old`` of the keys name, deletes left out."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("row")) for s in ("new", "old")]))
    named = keys.select("record_id", sides.alias("s")).select("record_id", "s.side", "s.row.*").where("run_id is not null and action <> 'delete' or action is null and run_id is not null")
    named = named.select("record_id", "side", *ROW)
    on = [F.col("v.record_id") == F.col("k.record_id"), *[F.col(f"v.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ROW]]
    rows = pruned(versions, named).select("record_id", *ROW, "payload")
    return rows.alias("v").join(named.alias("k"), on).select("k.record_id", "k.side", "v.payload")


def run_pairs(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """(record_id, new, old): the payloads of both sides of ``run_keys``, as a durable table. Deletes and missing payloads are null."""
    sides = [F.max(F.when(F.col("side") == s, F.col("payload"))).alias(s) for s in ("new", "old")]
    return files.settled(needles(versions, keys).groupBy("record_id").agg(*sides))


def compared_payloads(pairs: DataFrame, keys: tuple[str, ...], *, lenient: bool = False, max_depth: int | None = None) -> DataFrame:
    """(keys..., path, path_indexed, change, old and new value and type) of the payload pairs in ``new`` and ``old``.

    change is added, removed, changed or same.  Pairs of equal text have no rows: only
    the others are flattened, both sides at once, and meet in one grouping.
    """
    differ = pairs.where(~F.col("new").eqNullSafe(F.col("old")))
    sides = differ.select(*keys, F.explode(F.array(F.struct(F.lit("new").alias("side"), F.col("new").alias("p")), F.struct(F.lit("old").alias("side"), F.col("old").alias("p")))).alias("s"))
    leaves = flatten_leaves(sides.select(*keys, "s.side", F.col("s.p").alias("payload")), keys=(*keys, "side"), lenient=lenient, max_depth=max_depth)
    # Only dotted keys can write one indexed path twice; of these the largest counts.
    leaf = F.struct("path", "value", "value_type")
    both = leaves.groupBy(*keys, "path_indexed").agg(*[F.max(F.when(F.col("side") == s, leaf)).alias(s) for s in ("new", "old")])
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("new.value").eqNullSafe(F.col("old.value")) & (F.col("new.value_type") == F.col("old.value_type")), "same")
        .otherwise("changed")
    )
    return both.select(
        *keys, F.coalesce("new.path", "old.path").alias("path"), "path_indexed", change.alias("change"),
        F.col("old.value").alias("old_value"), F.col("old.value_type").alias("old_type"), F.col("new.value").alias("new_value"), F.col("new.value_type").alias("new_type"),
    )


@dataclass(frozen=True)
class RunDiff:
    """header, summary (one row), fields, detail and examples of a run."""

    header: DataFrame
    summary: DataFrame
    fields: DataFrame
    detail: DataFrame
    examples: DataFrame


def status_of(action: Column, new: Column, old: Column, differs: Column) -> Column:
    """deleted: the run deletes it, or it had content and has none now; added: it has content and had none; unchanged: no leaf differs; else modified."""
    return (
        F.when(F.coalesce(action == "delete", F.lit(False)) | (old.isNotNull() & new.isNull()), "deleted")
        .when(new.isNotNull() & old.isNull(), "added")
        .when(~F.coalesce(differs, F.lit(False)), "unchanged")
        .otherwise("modified")
    )


def classified(versions: DataFrame, run_id: str, *, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, leaves): touched records with status and prior version, and the compared leaves of those whose payload text differs."""
    keys = run_keys(versions, run_id)
    pairs = run_pairs(versions, keys)
    leaves = compared_payloads(pairs, ("record_id",), max_depth=max_depth)
    changed = leaves.where("change <> 'same'").groupBy("record_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    named = keys.select(
        "record_id", "action", "run_offset", F.col("old.run_id").alias("prev_run_id"), F.col("old.run_record_offset").alias("prev_offset"),
        F.col("old.run_date").cast("string").alias("prev_run_date"), F.col("old.filename").alias("prev_filename"),
    )
    records = named.join(pairs, "record_id", "left").join(changed, "record_id", "left")
    status = status_of(F.col("action"), F.col("new"), F.col("old"), F.col("paths").isNotNull())
    return records.withColumns({"status": status, "now": F.col("new").isNotNull(), "before": F.col("old").isNotNull()}).drop("new", "old"), leaves


def detail_rows(records: DataFrame) -> DataFrame:
    """The changed records; changed_paths is empty unless modified."""
    paths = F.when(F.col("status") == "modified", F.col("paths")).otherwise(F.array().cast("array<string>"))
    return records.where("status <> 'unchanged'").select("record_id", "status", "run_offset", "prev_run_id", "prev_run_date", "prev_offset", paths.alias("changed_paths"))


def field_rollup(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, added_in, changed_in, removed_in, records_affected) over modified records, each record once per path and change."""
    modified = leaves.where("change <> 'same'").join(records.where("status = 'modified'").select("record_id"), "record_id", "left_semi")
    counts = modified.select("record_id", "path", "change").distinct().groupBy("path")
    counts = counts.agg(*[F.count_if(F.col("change") == c).alias(f"{c}_in") for c in ("added", "changed", "removed")])
    affected = F.col("added_in") + F.col("changed_in") + F.col("removed_in")
    return counts.withColumn("records_affected", affected).orderBy(F.desc("records_affected"), "path")


def summary_row(records: DataFrame) -> DataFrame:
    """Counts by status, records read on both sides, and touched records without an earlier version."""
    return records.agg(
        F.count(F.lit(1)).alias("touched"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        F.count_if("now").alias("run_version"), F.count_if("before").alias("previous_version"),
        F.count_if(F.col("prev_run_id").isNull()).alias("without_prior"),
    )


def example_ids(records: DataFrame, n: int = 10) -> DataFrame:
    """(status, record_id): the first ids of each status in order."""
    first = F.row_number().over(Window.partitionBy("status").orderBy("record_id"))
    return records.select("status", "record_id", first.alias("n")).where(F.col("n") <= n).select("status", "record_id")


def diff_run(versions: DataFrame, run_id: str, *, examples: int = 10, max_depth: int | None = None) -> RunDiff:
    """The whole report; a run that is unknown is an error."""
    header = run_header(versions, run_id)
    if header.isEmpty():
        raise ValueError(f"unknown run: {run_id}")
    records, leaves = classified(versions, run_id, max_depth=max_depth)
    return RunDiff(header, summary_row(records), field_rollup(records, leaves), detail_rows(records), example_ids(records, examples))


def changed_at(detail: DataFrame, path: str) -> DataFrame:
    return detail.where(F.array_contains("changed_paths", path))


def version_pair_diff(versions: DataFrame, pairs: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """Leaf differences of many pairs of versions.

    ``pairs``: pair, and struct columns ``a`` and ``b`` of (record_id, run_id,
    run_record_offset), and of filename where offsets start again in each file.
    One row per leaf that differs, with change, old and new value and type.
    """

    def side(name: str) -> DataFrame:
        parts = pairs.schema[name].dataType.names
        keys = pairs.select("pair", *[F.col(f"{name}.{c}").alias(f"__{c}") for c in parts])
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) if c == "filename" else F.col(c) == F.col(f"__{c}") for c in parts]
        return versions.join(keys, on).groupBy("pair").agg(F.max("payload").alias(name))

    both = side("b").join(side("a"), "pair", "full_outer").withColumnsRenamed({"b": "new", "a": "old"})
    return compared_payloads(both, ("pair",), lenient=True, max_depth=max_depth).where("change <> 'same'")


def consecutive_pairs(versions: DataFrame) -> DataFrame:
    """(pair, a, b) for ``version_pair_diff``: each version with content, b, and the one with content before it, a.

    ``pair`` is the struct b, which tells a record's pairs apart.
    """
    order = Window.partitionBy("record_id").orderBy("run_timestamp", "run_id", "run_record_offset", "filename")
    v = F.struct("record_id", "run_id", "run_record_offset", "filename")
    chained = versions.where("payload is not null").select(v.alias("b"), F.lag(v).over(order).alias("a"))
    return chained.where("a is not null").select(F.col("b").alias("pair"), "a", "b")


def version_prints(versions: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(record_id, run_id, run_record_offset, filename, run_timestamp, action, leaf_print) of every version, the print null without content.

    Each payload is parsed once, where it lies, and does not move.
    """
    keys = ("record_id", "run_id", "run_record_offset", "filename", "run_timestamp", "action")
    has = F.col("payload").isNotNull() & F.coalesce(F.col("action") != "delete", F.lit(True))
    prints = leaf_prints(versions.where(has), keys=keys, max_depth=max_depth)
    return prints.unionByName(versions.where(~has).select(*keys, F.lit(None).cast(prints.schema["leaf_print"].dataType).alias("leaf_print")))


def all_run_changes(versions: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """(run_id, status, records) of every run at once, each as ``classified`` tells it.

    Versions are compared by the prints of their leaves, which are written once; payloads
    take no part in what follows.  A record's versions are ordered by time once; the
    newest one strictly before a run's end is the last before the first of that time.
    """
    known = files.settled(version_prints(versions, max_depth=max_depth))
    ends = known.groupBy("run_id").agg(F.max("run_timestamp").alias("end"))
    last = F.max_by(F.struct("action", "leaf_print"), F.struct("run_record_offset", "filename"))
    touched = known.groupBy("run_id", "record_id").agg(last.alias("t")).join(ends, "run_id")
    # A version and a question, what lies before the run's end, meet in the order of time; questions come first.
    v = F.struct("run_id", "run_record_offset", "filename", "leaf_print")
    told = known.select("record_id", F.col("run_timestamp").alias("at"), F.lit(1).alias("kind"), v.alias("v"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast(touched.schema["t"].dataType).alias("t"))
    asked = touched.select("record_id", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(told.schema["v"].dataType).alias("v"), "run_id", "t")
    earlier = Window.partitionBy("record_id").orderBy("at", "kind", "v").rowsBetween(Window.unboundedPreceding, -1)
    met = told.unionByName(asked).withColumn("prior", F.last("v", ignorenulls=True).over(earlier)).where("kind = 0")
    new, old = F.col("t.leaf_print"), F.col("prior.leaf_print")
    return met.groupBy("run_id", status_of(F.col("t.action"), new, old, new != old).alias("status")).agg(F.count(F.lit(1)).alias("records"))
