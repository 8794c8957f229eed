"""Read-only SQL over docs, eav and corpus_meta under a scope."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from recordprofile.operators.scope import EMPTY, Scope, scoped

MOST_ROWS = 1000
#: Leaves of a plan that read nothing: constants, ranges and references to what the query itself defines.
_HARMLESS = ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef")
#: Expressions that call Java methods by name.
_REFLECTIVE = ("CallMethodViaReflection", "TryReflect")


@dataclass(frozen=True)
class SqlResult:
    columns: list[str]
    rows: list[tuple]
    truncated: bool
    error: str | None = None


def _all(seq) -> list:
    return [seq.apply(k) for k in range(seq.length())]


def _guard(plan, views: set[str]) -> None:
    """Refuse an analysed plan that reads anything but the views of these names, or calls Java by name; what the views themselves do is theirs."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        kind, children = node.getClass().getSimpleName(), _all(node.children())
        if kind == "View":
            if node.desc().identifier().table() in views:
                continue
            raise ValueError("only docs, eav and corpus_meta can be read")
        if not children and kind not in _HARMLESS:
            raise ValueError("only docs, eav and corpus_meta can be read")
        expressions = _all(node.expressions())
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() in _REFLECTIVE:
                raise ValueError("functions that call Java methods are not allowed")
            expressions += _all(e.children())
        open_ += [*children, *_all(node.innerChildren()), *_all(node.subqueries())]


def scoped_sql(sql: str, docs: DataFrame, eav: DataFrame, meta: DataFrame | None = None, scope: Scope = EMPTY) -> DataFrame:
    """The query as a DataFrame. It stands in parentheses, so only queries parse: no DDL, DML or SET.

    Only the given tables can be read: the analysed plan is refused if it reads a file, a
    table of the catalogue or another view of the session, or if it calls Java by name.
    """
    inside_docs, inside_eav = scoped(docs, eav, scope)
    views = {"docs": inside_docs, "eav": inside_eav} | ({"corpus_meta": meta} if meta is not None else {})
    spark, tag = docs.sparkSession, uuid.uuid4().hex
    known = {name: f"{name}_{tag}" for name in views}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(known[name])
        names = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in known.items())
        found = spark.sql(f"WITH {names} SELECT * FROM (\n{sql.strip().rstrip(';')}\n)")
        _guard(found._jdf.queryExecution().analyzed(), set(known.values()))
    finally:
        for view in known.values():
            spark.catalog.dropTempView(view)
    return found


def run_sql(sql: str, docs: DataFrame, eav: DataFrame, meta: DataFrame | None = None, scope: Scope = EMPTY, *, limit: int = MOST_ROWS) -> SqlResult:
    """Up to ``limit`` rows; one more is fetched to tell whether there are more. Errors are reported, not raised."""
    try:
        df = scoped_sql(sql, docs, eav, meta, scope)
        rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    except (PySparkException, ValueError) as e:
        return SqlResult([], [], False, str(e))
    return SqlResult(df.columns, rows[:limit], len(rows) > limit)
