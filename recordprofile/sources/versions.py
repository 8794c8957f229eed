"""Record versions: the scan, the current version of each record, and reads of single records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordprofile.sources import files

IDENTITY = ("record_id", "run_id", "run_record_offset")
METADATA = ("record_id", "source", "run_date", "run_type", "action", "run_id", "run_record_offset", "run_timestamp", "filename")
PAYLOADS = ("payload", "raw_payload")

#: Size of a row group of the look-up table: what a look-up reads.
LOOKUP_GROUP_BYTES = 4 << 20
#: Different runs and files that a read names one by one at most.
MOST_NAMED = 1000

VERSION_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("run_date", T.DateType()),
        T.StructField("run_type", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("run_record_offset", T.LongType()),
        T.StructField("run_timestamp", T.TimestampType()),
        T.StructField("payload", T.StringType()),
        T.StructField("raw_payload", T.BinaryType()),
    ]
)


def read_versions(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = VERSION_SCHEMA) -> DataFrame:
    """All versions under the paths. Columns that a query does not use are never read; filename is the file of the row."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    return df if "filename" in df.columns else df.withColumn("filename", F.col("_metadata.file_path"))


def write_versions(versions: DataFrame, path: str) -> None:
    """Add versions below ``path`` by source and run date, within files by run and record.

    A read that names sources or dates then lists only their folders, one that joins on
    them prunes at run time, and one that names runs or records skips row groups.
    """
    ordered = versions.drop("filename").repartition("source", "run_date", "run_id").sortWithinPartitions("source", "run_date", "run_id", "record_id")
    ordered.write.mode("append").partitionBy("source", "run_date").parquet(path)


def write_lookup(versions: DataFrame, path: str, *, group_bytes: int = LOOKUP_GROUP_BYTES) -> None:
    """Write the versions' metadata for look-ups of single records: by record over all files, with Bloom filters of the ids.

    A read that names a record skips all row groups but the one or two that hold it,
    by their statistics; ids that no file has are settled by the filters.  A record with
    very many versions is shared by several files.
    """
    meta = metadata_only(versions)
    ordered = meta.repartitionByRange("record_id", "run_timestamp").sortWithinPartitions("record_id", *newest_first())
    options = {"parquet.bloom.filter.enabled#record_id": "true", "parquet.block.size": group_bytes, "parquet.page.row.count.limit": 1000}
    ordered.write.options(**options).parquet(path)


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_lookup`` wrote, for ``current_key`` and ``record_history``."""
    return spark.read.parquet(path)


def pruned(versions: DataFrame, keys: DataFrame, *, most: int = MOST_NAMED) -> DataFrame:
    """The versions without files, folders and row groups that ``keys`` cannot mean; the caller joins what is left.

    ``keys`` (a durable table) has any of source, run_date, run_id and filename.  Up to
    ``most`` different ones become predicates that the scan knows before it starts:
    files are listed by name and folder, row groups skipped by run.  More of them change
    nothing here: the join on source and run date prunes folders while it runs.
    """
    columns = [c for c in ("source", "run_date", "run_id", "filename") if c in keys.columns and c in versions.columns]
    named = keys.select(*columns).distinct().limit(most + 1).collect()
    if len(named) > most:
        return versions
    for c in columns:
        values = {r[c] for r in named}
        inside = F.col(c).isin(sorted(v for v in values if v is not None))
        versions = versions.where(inside | F.col(c).isNull() if None in values else inside)
    return versions


def metadata_only(versions: DataFrame) -> DataFrame:
    return versions.select([c for c in METADATA if c in versions.columns])


def newest_first() -> list[Column]:
    return [F.col("run_timestamp").desc_nulls_last(), F.desc("run_id"), F.desc("run_record_offset"), F.col("filename").desc_nulls_last()]


def current_records(versions: DataFrame) -> DataFrame:
    """The newest version of each (source, record id). It may be a delete."""
    newest = F.row_number().over(Window.partitionBy("source", "record_id").orderBy(*newest_first()))
    return versions.withColumn("__n", newest).where("__n = 1").drop("__n")


def read_payloads(
    versions: DataFrame, columns: Sequence[str] | None = None, *, where: str | None = None, limit: int | None = None, **filters
) -> DataFrame:
    """Versions by equality (a value) or membership (a list) on columns and a raw predicate; both reach the scan."""
    for column, value in filters.items():
        many = isinstance(value, (list, tuple, set, frozenset))
        versions = versions.where(F.col(column).isin(list(value)) if many else F.col(column) == value)
    if where:
        versions = versions.where(F.expr(f"({where})"))
    if columns:
        versions = versions.select(*columns)
    return versions if limit is None else versions.limit(limit)


def sample_parsed(versions: DataFrame, limit: int = 1, **filters) -> DataFrame:
    """Some versions with their payload parsed to a variant in ``parsed``."""
    return read_payloads(versions, where="payload is not null", **filters).limit(limit).withColumn("parsed", F.parse_json("payload"))


def of_runs(versions: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    return versions.where(F.col("run_id").isin(list(run_ids)))


def current_key(versions: DataFrame, record_id: str) -> DataFrame:
    """(record_id, run_id, run_record_offset) of the record's current versions, one for each source that has it."""
    return current_records(metadata_only(versions).where(F.col("record_id") == record_id)).select(*IDENTITY)


def record_version(versions: DataFrame, record_id: str, run_id: str | None = None, offset: int | None = None) -> DataFrame:
    """One version with its payloads; the current one unless run and offset are given."""
    if run_id is None or offset is None:
        return current_records(versions.where(F.col("record_id") == record_id)).orderBy(*newest_first()).limit(1)
    return read_payloads(versions, record_id=record_id, run_id=run_id, run_record_offset=offset, limit=1)


def record_history(versions: DataFrame, record_id: str) -> DataFrame:
    """The record's versions, newest first."""
    return metadata_only(versions).where(F.col("record_id") == record_id).orderBy(*newest_first())


class RegressionError(RuntimeError):
    """A table that had rows came back empty."""


def rebuild_metadata(
    spark: SparkSession, types: Mapping[str, Callable[[], DataFrame | None]], root: str, on_progress: Callable[[str, dict], None] | None = None
) -> dict[str, dict]:
    """Write the payload-free table of each type anew and publish all of them together.

    ``types`` gives for each name what reads it, or None for nothing to read (skipped).
    A type whose published table has rows and whose new one has none fails the whole
    rebuild before anything is published; one that was empty or missing may stay so.
    Returns status and row count by type.
    """
    manifest = f"{root}/manifest.json"
    published = json.loads(files.read_text(spark, manifest)) if files.exists(spark, manifest) else {}
    done: dict[str, dict] = {}
    for name, read in types.items():
        df = read()
        if df is None:
            done[name] = {"status": "skipped", "rows": 0}
        else:
            path = f"{root}/{name}/{uuid.uuid4().hex}"
            df.select([c for c in df.columns if c not in PAYLOADS]).write.parquet(path)
            done[name] = {"status": "built", "rows": spark.read.parquet(path).count(), "path": path}
        if on_progress:
            on_progress(name, done[name])
    lost = [n for n, d in done.items() if not d["rows"] and published.get(n, {}).get("rows", 0) > 0]
    if lost:
        raise RegressionError(f"tables that had rows came back empty: {', '.join(sorted(lost))}")
    files.write_text(spark, manifest, json.dumps(published | {n: d for n, d in done.items() if d["status"] == "built"}))
    return done
