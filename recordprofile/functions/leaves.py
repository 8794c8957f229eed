"""JSON leaves as a table function, for SQL: ``FROM docs d, LATERAL json_leaves(d.payload) l``.

Rows and texts are those of ``operators.flatten``, which stays inside the JVM and is the
one to use from DataFrames; this one reads a payload of any depth in one step, wherever
SQL has a column of JSON, and needs no stated depth and no table in between.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

SCHEMA = "path string, path_indexed string, value string, value_type string"
#: Digits that Spark's decimals hold; longer numbers and those with an exponent are doubles.
MOST_DIGITS = 38


class _Number(str):
    """A number as the payload writes it."""


def _double(x: float) -> str:
    """A double as Spark writes it: plain from 0.001 up to 10 million, else with one digit before the point and an exponent."""
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x) if "e" not in repr(x) else f"{Decimal(repr(x)):f}"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    return f"{'-' if sign else ''}{text[0]}.{text[1:] or '0'}E{exponent + len(digits) - 1}"


def _number(text: str) -> str:
    if "e" not in text.lower() and sum(map(str.isdigit, text)) <= MOST_DIGITS:
        plain = f"{Decimal(text):f}" if Decimal(text) else "0"
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    return _double(float(text))


def _leaf(value) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return str(value).lower(), "boolean"
    if isinstance(value, _Number):
        return _number(value), "number"
    return (value, "string") if isinstance(value, str) else (None, "object-empty" if isinstance(value, dict) else "array-empty")


def walked(payload: str) -> Iterator[tuple[str, str, str | None, str]]:
    """(path, path_indexed, value, value_type) of the payload's leaves, in its order."""
    stack = [("", "", json.loads(payload, parse_float=_Number, parse_int=_Number))]
    while stack:
        path, indexed, value = stack.pop()
        if isinstance(value, dict) and value:
            stack += [(f"{path}.{k}" if path else k, f"{indexed}.{k}" if indexed else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            stack += [(f"{path}[]", f"{indexed}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            yield path, indexed, *_leaf(value)


class JsonLeaves:
    def eval(self, payload: str, lenient: bool = False) -> Iterator[tuple[str, str, str | None, str]]:
        if payload is None:
            return
        try:
            found = list(walked(payload))
        except (ValueError, RecursionError):
            if not lenient:
                raise
            return
        if not lenient or payload.lstrip().startswith("{"):
            yield from found


def register_json_leaves(spark: SparkSession, name: str = "json_leaves") -> None:
    """Make the table function known to SQL: ``json_leaves(payload [, lenient])``; batches travel by Arrow.

    Null payloads have no rows.  One that isn't JSON fails the query; with ``lenient`` it
    has no rows, and neither have payloads that aren't objects.
    """
    spark.udtf.register(name, udtf(JsonLeaves, returnType=SCHEMA, useArrow=True))
