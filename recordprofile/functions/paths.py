"""Column functions over leaf paths.

A path writes array elements as ``[]`` and members after a dot (``a.b[].c``); an
indexed path has the element's number in the brackets (``a.b[0].c``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How value types are shown; all others are shown as they are.
SHOWN_TYPES = {"object-empty": "object", "array-empty": "array"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def under(prefix: str, path: Column | str = "path") -> Column:
    """Whether a path is the prefix or lies below it, at a boundary; the empty prefix holds all."""
    if prefix == "":
        return F.lit(True)
    path = _col(path)
    return (path == prefix) | path.startswith(f"{prefix}[") | path.startswith(f"{prefix}.")


def under_column(leaf: Column | str, element: Column | str) -> Column:
    """``under`` with the prefix in a column."""
    leaf, element = _col(leaf), _col(element)
    return (leaf == element) | leaf.startswith(F.concat(element, F.lit("["))) | leaf.startswith(F.concat(element, F.lit(".")))


def element_prefix(path: Column | str) -> Column:
    """The path up to its last closing bracket; paths without one stay."""
    return F.regexp_replace(_col(path), r"\][^\]]*\z", "]")


def object_prefix(path: Column | str) -> Column:
    """The path up to its last closing bracket, or an empty string."""
    return F.regexp_extract(_col(path), r"(?s)^(.*\])", 1)


def object_prefix_of(path: str) -> str:
    return path[: path.rfind("]") + 1]


def instance_key(indexed: Column | str, depth: int) -> Column:
    """The first ``depth`` bracket groups of an indexed path; with fewer, the whole path; for depth 0 an empty string."""
    if depth == 0:
        return F.lit("")
    indexed = _col(indexed)
    head = F.substring_index(indexed, "]", depth)
    return F.when(F.length(head) < F.length(indexed), F.concat(head, F.lit("]"))).otherwise(indexed)


def top_field(path: Column | str) -> Column:
    """The member of the record that a path begins with; a path that begins with a dot or bracket is itself one."""
    path = _col(path)
    head = F.substring_index(F.substring_index(path, ".", 1), "[", 1)
    return F.when(head == "", path).otherwise(head)


def top_element(indexed: Column | str) -> Column:
    """The top field with the number of its array element, if it has one."""
    indexed = _col(indexed)
    field = top_field(indexed)
    number = F.substring_index(F.substring(indexed, F.length(field) + 2, F.length(indexed)), "]", 1)
    numbered = F.concat(field, F.lit("["), number, F.lit("]"))
    is_element = indexed.startswith(numbered) & (number != "") & (F.translate(number, "0123456789", "") == "")
    return F.when(is_element, numbered).otherwise(field)


def member_label(path: Column | str, prefix: str) -> Column:
    """A member's path relative to its object's prefix; the full path if nothing is left."""
    path = _col(path)
    rest = F.ltrim(F.substring(path, len(prefix) + 1, 1 << 30), F.lit("."))
    return F.coalesce(F.nullif(rest, F.lit("")), path)


def display_type(value_type: Column | str) -> Column:
    value_type = _col(value_type)
    shown = reduce(lambda c, kv: c.when(value_type == kv[0], kv[1]), SHOWN_TYPES.items(), F.when(value_type.isNull(), "null"))
    return shown.otherwise(value_type)


def content_hashes(path: Column | str = "path", value: Column | str = "value") -> tuple[Column, Column]:
    """Two 64-bit hashes of a path with its value; a missing value differs from all others.

    Combined with ``bit_xor`` over the different pairs of an object, they are a key of
    its content as a set, whatever the order, that plain hash aggregation can build.
    """
    pair = (_col(path), _col(value).isNull(), _col(value))
    return F.xxhash64(*pair), F.xxhash64(F.lit(1), *pair)


def element_numbers(indexed: Column | str) -> Column:
    """The numbers in an indexed path's brackets, for sorting elements by number and not by text."""
    return F.transform(F.regexp_extract_all(_col(indexed), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
