"""Source and run history from version metadata; payloads are never read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordprofile.operators.filters import Page, all_of, in_filters, on_day, search
from recordprofile.sources.versions import current_records, metadata_only

ACTIONS = ("index", "delete", "skip", "error")
RUN_ORDER = ("run_id", "source", "run_type", "run_date", "run_timestamp", "record_count", *[f"{a}_count" for a in ACTIONS])


def source_overview(versions: DataFrame) -> DataFrame:
    """(source, record_count, version_count, run_count, first_run_date, last_run_date) by source.

    record_count counts current records that are indexed; a source of which only
    history is left has 0.
    """
    meta = metadata_only(versions)
    live = current_records(meta).where("action = 'index'").groupBy("source").agg(F.count(F.lit(1)).alias("record_count"))
    # Runs fold first, so that counting them needs no second expansion of the rows.
    per_run = meta.groupBy("source", "run_id").agg(F.count(F.lit(1)).alias("n"), F.min("run_date").alias("a"), F.max("run_date").alias("b"))
    history = per_run.groupBy("source").agg(
        F.sum("n").alias("version_count"), F.count("run_id").alias("run_count"), F.min("a").alias("first_run_date"), F.max("b").alias("last_run_date")
    )
    joined = history.join(live, "source", "full_outer")
    return joined.select(
        "source", F.coalesce("record_count", F.lit(0)).alias("record_count"), "version_count", "run_count",
        F.col("first_run_date").cast("string").alias("first_run_date"), F.col("last_run_date").cast("string").alias("last_run_date"),
    ).orderBy("source")


def run_summary(versions: DataFrame) -> DataFrame:
    """One row per run: source, run_type, run_date and run_timestamp as text, record_count and counts by action."""
    return (
        metadata_only(versions)
        .groupBy("run_id")
        .agg(
            F.min("source").alias("source"), F.min("run_type").alias("run_type"), F.min("run_date").cast("string").alias("run_date"),
            F.date_format(F.max("run_timestamp"), "yyyy-MM-dd HH:mm:ss").alias("run_timestamp"), F.count(F.lit(1)).alias("record_count"),
            *[F.count_if(F.coalesce(F.col("action") == a, F.lit(False))).alias(f"{a}_count") for a in ACTIONS],
        )
    )


def recent_runs(versions: DataFrame, *, sources: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    runs = run_summary(versions.where(F.col("source").isin(list(sources))) if sources else versions)
    runs = runs.orderBy(F.col("run_timestamp").desc_nulls_last(), F.desc("run_id"))
    return runs if limit is None else runs.limit(limit)


def _matching_runs(versions: DataFrame, term: str | None, sources: Sequence[str], run_types: Sequence[str], run_date: str | None) -> DataFrame:
    condition = all_of([*in_filters({"source": sources, "run_type": run_types}), search(term, ("run_id", "source", "run_type")), on_day("run_date", run_date)])
    return run_summary(versions).where(condition)


def run_rows(
    versions: DataFrame, *, term: str | None = None, sources: Sequence[str] = (), run_types: Sequence[str] = (), run_date: str | None = None,
    by: str = "run_timestamp", descending: bool = True, start: int = 0, length: int = 50,
) -> DataFrame:
    """A page of run summaries; ties by run timestamp in the same direction, then run id downwards."""
    if by not in RUN_ORDER:
        raise ValueError(f"cannot order by {by}")
    way = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    return _matching_runs(versions, term, sources, run_types, run_date).orderBy(way(by), way("run_timestamp"), F.desc("run_id")).offset(start).limit(length)


def run_page(versions: DataFrame, **options) -> Page:
    total = versions.select("run_id").distinct().count()
    bare = {"term": None, "sources": (), "run_types": (), "run_date": None} | {k: v for k, v in options.items() if k in ("term", "sources", "run_types", "run_date")}
    filtered = _matching_runs(versions, **bare).count() if any(bare.values()) else total
    return Page(total, filtered, run_rows(versions, **options))


def one_source(versions: DataFrame, source: str, *, limit: int | None = 20) -> tuple[DataFrame, DataFrame]:
    """(overview row, runs) of a source that exists."""
    own = versions.where(F.col("source") == source)
    overview = source_overview(own)
    if overview.isEmpty():
        raise ValueError(f"unknown source: {source}")
    return overview, recent_runs(own, limit=limit)


def run_header(versions: DataFrame, run_id: str) -> DataFrame:
    """The run's summary, or no row."""
    return run_summary(versions.where(F.col("run_id") == run_id))


