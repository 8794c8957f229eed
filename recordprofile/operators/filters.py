"""Filters, search, ordering and pages over versions and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

IN_COLUMNS = ("source", "run_type", "action", "run_id")
SEARCH_COLUMNS = ("record_id", "source", "run_id", "run_type", "action")
LARGEST_PAGE = 200


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def in_filters(values: Mapping[str, Sequence], columns: Sequence[str] = IN_COLUMNS) -> list[Column]:
    """One IN condition for each known column that has values; other names are ignored."""
    return [F.col(c).isin(list(values[c])) for c in columns if values.get(c)]


def search(term: str | None, columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    """Case-insensitive containment in any of the columns; ``%`` and ``_`` are wildcards, a backslash is not special."""
    if not term:
        return F.lit(True)
    pattern = "%" + term.replace("\\", "\\\\") + "%"
    return reduce(or_, [F.coalesce(F.col(c).cast("string").ilike(pattern), F.lit(False)) for c in columns])


def on_day(column: str, day: str | None) -> Column:
    return F.lit(True) if not day else F.to_date(F.col(column)) == F.to_date(F.lit(day))


def version_filter(
    values: Mapping[str, Sequence] | None = None, *, term: str | None = None, run_date: str | None = None, where: str | None = None,
    search_columns: Sequence[str] = SEARCH_COLUMNS,
) -> Column:
    """IN filters, search, run date and a raw SQL predicate, all of which must hold."""
    conditions = [*in_filters(values or {}), search(term, search_columns), on_day("run_date", run_date)]
    if where:
        conditions.append(F.expr(f"({where})"))
    return all_of(conditions)


@dataclass(frozen=True)
class Page:
    """Counts before and after filtering, and the rows of one page."""

    total: int
    filtered: int
    rows: DataFrame


def ordered(df: DataFrame, by: str, ties: Sequence[str], *, descending: bool = False, allowed: Sequence[str] | None = None) -> DataFrame:
    """Rows by a column of ``allowed``, nulls last, ties broken by ``ties``."""
    if allowed is not None and by not in allowed:
        raise ValueError(f"cannot order by {by}: one of {', '.join(allowed)} is asked for")
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_last() for t in ties if t != by])


def page_rows(df: DataFrame, by: str, ties: Sequence[str], *, descending: bool = False, start: int = 0, length: int = 50, allowed: Sequence[str] | None = None) -> DataFrame:
    return ordered(df, by, ties, descending=descending, allowed=allowed).offset(start).limit(min(length, LARGEST_PAGE))


def continuation(row: Row, by: str, ties: Sequence[str]) -> tuple:
    """What ``seek_rows`` goes on after: the row's place in the order."""
    return tuple(row[c] for c in (by, *[t for t in ties if t != by]))


def beyond(df: DataFrame, by: str, ties: Sequence[str], after: Sequence, *, descending: bool = False) -> Column:
    """The rows that come after a place in the order of ``ordered``.

    The bound on ``by`` stands alone in front, where a scan can use it: row groups that
    earlier pages have shown are skipped.
    """
    columns = (by, *[t for t in ties if t != by])
    at = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(columns, after, strict=True)]
    less = lambda c, v: F.col(c) < v if descending and c == by else F.col(c) > v
    # Nulls come last, so nothing but further ties comes after one.
    later = [F.lit(False) if raw is None else less(c, v) | F.col(c).isNull() for c, v, raw in zip(columns, at, after, strict=True)]
    same = [F.col(c).eqNullSafe(v) for c, v in zip(columns, at, strict=True)]
    steps = [all_of([*same[:k], later[k]]) for k in range(len(columns))]
    first = F.col(by).isNull() if after[0] is None else (F.col(by) <= at[0] if descending else F.col(by) >= at[0]) | F.col(by).isNull()
    return first & reduce(or_, steps)


def seek_rows(
    df: DataFrame, by: str, ties: Sequence[str], *, after: Sequence | None = None, descending: bool = False, length: int = 50, allowed: Sequence[str] | None = None
) -> DataFrame:
    """The page that follows ``after`` (a ``continuation``), the first one without it; ``ties`` must tell rows apart.

    Unlike an offset, which orders and drops all earlier rows anew, a page far behind
    reads no more than the first.
    """
    kept = df if after is None else df.where(beyond(df, by, ties, after, descending=descending))
    return ordered(kept, by, ties, descending=descending, allowed=allowed).limit(min(length, LARGEST_PAGE))


def page(df: DataFrame, condition: Column, by: str, ties: Sequence[str], *, cap: int | None = None, start: int = 0, length: int = 50, **options) -> Page:
    """A page of the rows that meet the condition; ``cap`` bounds both what is counted as filtered and what pages can show."""
    kept = df.where(condition)
    # Both counts come from one pass.
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(condition, F.lit(False))).alias("filtered")).first()
    filtered = counts["filtered"]
    if cap is not None:
        filtered, length = min(filtered, cap), max(0, min(length, cap - start))
    return Page(counts["total"], filtered, page_rows(kept, by, ties, start=start, length=length, **options))


VERSION_ORDER = ("record_id", "source", "run_date", "run_timestamp", "run_type", "action", "run_id", "run_record_offset")


def shown_versions(versions: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text."""
    return versions.withColumns({"run_date": F.to_date("run_date").cast("string"), "run_timestamp": F.date_format("run_timestamp", "yyyy-MM-dd'T'HH:mm:ss")})


def browse_versions(versions: DataFrame, *, by: str = "run_timestamp", descending: bool = True, start: int = 0, length: int = 50, cap: int | None = None, **conditions) -> Page:
    """A page of versions under ``version_filter`` conditions."""
    found = page(
        versions, version_filter(**conditions), by, ("record_id", "run_id", "run_record_offset"), descending=descending,
        start=start, length=length, cap=cap, allowed=VERSION_ORDER,
    )
    return Page(found.total, found.filtered, shown_versions(found.rows))
