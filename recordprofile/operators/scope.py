"""Scopes: a part of the documents, by which every profiling operator can be restricted."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordprofile.operators.filters import all_of, in_filters

SCOPE_COLUMNS = ("source", "run_type", "action", "run_id")


@dataclass(frozen=True)
class Scope:
    """IN lists over document columns and a raw predicate. Unknown columns are ignored."""

    filters: Mapping[str, Sequence[str]] = field(default_factory=dict)
    where: str = ""

    def _known(self) -> dict[str, list[str]]:
        return {c: sorted(set(map(str, self.filters[c]))) for c in SCOPE_COLUMNS if self.filters.get(c)}

    def is_empty(self) -> bool:
        return not self._known() and not self.where.strip()

    def key(self) -> str:
        """The same text for the same scope, however it was written; empty for the empty scope."""
        return "" if self.is_empty() else json.dumps({"filters": self._known(), "where": self.where.strip()}, sort_keys=True)

    def predicate(self) -> Column:
        raw = [F.expr(f"({self.where})")] if self.where.strip() else []
        return all_of([*in_filters(self._known(), SCOPE_COLUMNS), *raw])


EMPTY = Scope()


def scoped(docs: DataFrame, eav: DataFrame, scope: Scope = EMPTY) -> tuple[DataFrame, DataFrame]:
    """(docs, eav) of the scope; leaves follow their documents by a semi join, and an empty scope changes nothing."""
    if scope.is_empty():
        return docs, eav
    inside = docs.where(scope.predicate())
    return inside, eav.join(inside.select("version_key"), "version_key", "left_semi")


def scoped_total(docs: DataFrame, scope: Scope = EMPTY) -> int:
    return (docs if scope.is_empty() else docs.where(scope.predicate())).count()
