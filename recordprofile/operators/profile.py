"""Profiling queries over documents and their leaves.

Percentages and averages are rounded half up at the stated decimals by whole-number
arithmetic, so results do not depend on binary fractions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordprofile.functions.paths import (
    content_hashes,
    display_type,
    element_numbers,
    element_prefix,
    instance_key,
    member_label,
    top_element,
    top_field,
    under,
    under_column,
)
from recordprofile.operators.filters import Page, page, search
from recordprofile.sources import files

IDENTITY = ("record_id", "source", "run_id", "run_record_offset")
#: The types of leaves, in the order in which equally frequent ones are preferred.
LEAF_TYPES = ("array-empty", "boolean", "null", "number", "object-empty", "string")


def percent(n: Column, d: Column, decimals: int = 1) -> Column:
    """n of d in percent, half up; 0 where d is 0."""
    scale = 10**decimals
    return F.when(d == 0, F.lit(0.0)).otherwise(_whole((200 * scale) * n + d, 2 * d) / float(scale))


def mean(total: Column, n: Column, decimals: int = 2) -> Column:
    scale = 10**decimals
    return _whole((2 * scale) * total + n, 2 * n) / float(scale)


def _whole(a: Column, b: Column) -> Column:
    """Whole-number quotient; null where b is 0."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0)))


def _single(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def _mode(df: DataFrame, keys: list[str], column: str, into: str) -> DataFrame:
    """The most frequent value by key, of equal ones the smallest; counts combine before the shuffle."""
    return df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n")).groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(column).alias("v")))["v"].alias(into))


# Schema


def classified_fields(paths: DataFrame) -> DataFrame:
    """(field, is_array, is_complex, prefix) of each top-level field, from the different paths."""
    found = paths.withColumn("field", top_field("path")).where("field <> ''").groupBy("field")
    found = found.agg(F.bool_or(F.col("path").startswith(F.concat("field", F.lit("[")))).alias("is_array"), F.bool_or(F.col("path").contains(".")).alias("is_complex"))
    return found.withColumn("prefix", F.when(F.col("is_array"), F.concat("field", F.lit("[]"))).otherwise(F.col("field")))


def field_members(paths: DataFrame, fields: DataFrame) -> DataFrame:
    """(field, m): of fields that hold objects, the sorted member paths with their labels, as structs."""
    inside = paths.withColumn("field", top_field("path")).join(fields.where("is_complex"), "field").where(under_column("path", "prefix"))
    relative = F.ltrim(F.expr("substring(path, length(prefix) + 1)"), F.lit("."))
    label = F.coalesce(F.nullif(relative, F.lit("")), F.col("path"))
    return inside.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("path", label.alias("label")))).alias("m"))


def field_elements(eav: DataFrame) -> DataFrame:
    """One row per different top element of a document's field: n on the field's first row there, is_item, kind, value, and a content key (h, g).

    n counts the field's elements in the document, and is_item tells array elements
    from members that are none.  kind and value are those of the leaf that is the
    element itself, the key is that of all its leaves.  The leaves of a document's
    field meet in one shuffle that serves all groupings.
    """
    field, element = top_field("path"), top_element("path_indexed")
    itself = (F.col("path") == F.col("field")) | (F.col("path") == F.concat("field", F.lit("[]")))
    h, g = content_hashes()
    leaves = eav.select("version_key", "path", field.alias("field"), element.alias("element"), "value", "value_type", h.alias("h"), g.alias("g")).where("field <> ''")
    leaves = leaves.select(
        "version_key", "field", "element", "h", "g", F.when(itself, F.col("value_type")).alias("kind"), F.when(itself, F.col("value")).alias("value"),
    )
    pairs = leaves.repartition("version_key", "field").distinct()
    elements = pairs.groupBy("version_key", "field", "element", "kind", "value").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    order = Window.partitionBy("version_key", "field").orderBy("element")
    ranked = elements.withColumns({"place": F.dense_rank().over(order), "row": F.row_number().over(order)})
    n = F.max("place").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("field", F.when(F.col("row") == 1, n).alias("n"), (F.col("element") != F.col("field")).alias("is_item"), "kind", "value", "h", "g")


def schema_overview(docs: DataFrame, eav: DataFrame) -> DataFrame:
    """One row per top-level field, most frequent first.

    field, type, is_complex, is_array, prefix, drill_path, doc_count, coverage_pct,
    count_min, count_avg, count_max, distinct_values, sample_value, members.  The
    leaves are read twice: for their different paths, and for the elements from which
    all else follows.  Where some documents have an array, only array elements tell a
    field's type, values and contents; plain ones count in the numbers of elements.
    """
    # The leaves may be long in the making; the different paths are needed more than once, too.
    eav = files.settled(eav.select("version_key", "path", "path_indexed", "value", "value_type"))
    # Two levels of groups, as a field may have any number of values.
    things = field_elements(eav).groupBy("field", "is_item", "value", "h", "g").agg(
        F.count("n").alias("docs"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("all"),
        *[F.count_if(F.col("kind") == t).alias(f"of_{t}") for t in LEAF_TYPES],
    )
    return overview(files.settled(eav.select("path").distinct()), things, _single(docs, "total"))


def overview(paths: DataFrame, things: DataFrame, total: DataFrame) -> DataFrame:
    """``schema_overview`` from the different paths, the different elements of fields with their counts, and one row with the number of documents."""
    # As many rows as there are different paths.
    fields = classified_fields(paths)
    some = lambda c: F.when(F.col("is_item"), c), lambda c: F.when(~F.col("is_item"), c)
    counts = things.groupBy("field").agg(
        F.sum("docs").alias("doc_count"), F.min("low").alias("count_min"), mean(F.sum("all"), F.sum("docs")).alias("count_avg"), F.max("high").alias("count_max"),
        *[
            f.alias(f"{name}_{which}")
            for which, part in zip(("items", "plain"), some, strict=True)
            for name, f in {"contents": F.count(part(F.col("h"))), "values": F.count(part(F.col("value"))), "sample": F.min(part(F.col("value")))}.items()
        ],
        *[F.sum(part(F.col(f"of_{t}"))).alias(f"{t}_{which}") for which, part in zip(("items", "plain"), some, strict=True) for t in LEAF_TYPES],
    )
    chosen = lambda name: F.when(F.col("is_array"), F.col(f"{name}_items")).otherwise(F.col(f"{name}_plain"))
    most = F.greatest(*[F.struct(F.coalesce(chosen(t), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(LEAF_TYPES)])
    shown = F.when(F.col("is_complex"), F.lit("object")).otherwise(display_type(F.when(most["n"] > 0, most["t"])))
    return (
        fields.join(counts, "field").join(field_members(paths, fields), "field", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "field",
            F.when(F.col("is_array"), F.concat(F.lit("array["), shown, F.lit("]"))).otherwise(shown).alias("type"),
            "is_complex", "is_array", "prefix",
            F.when(F.col("is_complex"), F.col("field")).otherwise(F.col("prefix")).alias("drill_path"),
            "doc_count", percent(F.col("doc_count"), F.col("total")).alias("coverage_pct"), "count_min", "count_avg", "count_max",
            F.when(F.col("is_complex"), chosen("contents")).otherwise(chosen("values")).alias("distinct_values"),
            F.when(F.col("is_complex"), F.array_join(F.col("m.label"), ", ")).otherwise(chosen("sample")).alias("sample_value"),
            F.coalesce(F.col("m.path"), F.array().cast("array<string>")).alias("members"),
        )
        .orderBy(F.desc("doc_count"), "field")
    )


# Values


def path_extremes(eav: DataFrame) -> DataFrame:
    """(path, value_type, leaves, least, most): leaves of each path and type, with their smallest and largest value in code-point order.

    Text has no place in Spark's hash aggregation, which would sort all leaves of a task
    to find both; here each Arrow batch is grouped where it is, and few rows are left.
    """

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(["path", "value_type"]).aggregate([([], "count_all"), ("value", "min"), ("value", "max")])
            yield from found.select(["path", "value_type", "count_all", "value_min", "value_max"]).rename_columns(["path", "value_type", "n", "least", "most"]).to_batches()

    rows = eav.select("path", "value_type", "value").mapInArrow(reduced, "path string, value_type string, n long, least string, most string")
    return rows.groupBy("path", "value_type").agg(F.sum("n").alias("leaves"), F.min("least").alias("least"), F.max("most").alias("most"))


def value_frequencies(eav: DataFrame, prefix: str = "") -> DataFrame:
    """(path, value, documents, occurrences, pct_of_path) of the non-null values under a prefix."""
    counted = eav.where(under(prefix) & F.col("value").isNotNull()).groupBy("path", "value", "version_key").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy("path", "value").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("occurrences"))
    # A path's total comes from a small aggregate, not from a window over all its values.
    totals = counted.groupBy("path").agg(F.sum("occurrences").alias("__all"))
    # One row for each different path.
    return counted.join(F.broadcast(totals), "path").select("path", "value", "documents", "occurrences", percent(F.col("occurrences"), F.col("__all")).alias("pct_of_path"))


VALUE_COLUMNS = ("path", "value", "documents", "occurrences", "pct_of_path")


def path_values(eav: DataFrame, prefix: str = "", *, term: str | None = None, by: str = "documents", descending: bool = True, **paging) -> Page:
    return page(value_frequencies(eav, prefix), search(term, ("value", "path")), by, ("path", "value"), descending=descending, allowed=VALUE_COLUMNS, **paging)


def record_page(rows: DataFrame, *, term: str | None = None, by: str = "record_id", descending: bool = False, **paging) -> Page:
    """Records under a search on id and source, ordered by any column, ties by identity."""
    return page(rows, search(term, ("record_id", "source")), by, IDENTITY, descending=descending, allowed=rows.columns, **paging)


def records_with_value(docs: DataFrame, eav: DataFrame, path: str, value: str) -> DataFrame:
    """Identities of records that hold the value at the path, as often as they hold it."""
    hits = eav.where((F.col("path") == path) & (F.col("value") == value)).select("version_key")
    return hits.join(docs, "version_key").select(*IDENTITY, "version_key")


def path_record_counts(docs: DataFrame, eav: DataFrame, path: str) -> DataFrame:
    """Identity and value_count, the non-null values at the path; records that hold only nulls there have 0."""
    counts = eav.where(F.col("path") == path).groupBy("version_key").agg(F.count("value").alias("value_count"))
    return counts.join(docs, "version_key").select(*IDENTITY, "version_key", "value_count")


def is_scalar_array(eav: DataFrame, prefix: str) -> bool:
    return prefix.endswith("[]") and not eav.where(F.col("path") == prefix).isEmpty()


# Objects


def _depth(prefix: str) -> int:
    return prefix.count("]")


def object_field_paths(eav: DataFrame) -> DataFrame:
    """Paths in array elements that share their element with another path."""
    paths = eav.select("path").distinct().where(F.col("path").contains("]")).withColumn("element", element_prefix("path"))
    # As many rows as there are different paths; equal elements meet by hash, then elements within elements.
    elements = paths.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    ancestors = F.filter(
        F.transform(F.sequence(F.lit(1), F.size(F.split("element", r"\]")) - 1), lambda k: F.concat(F.array_join(F.slice(F.split("element", r"\]"), F.lit(1), k), "]"), F.lit("]"))),
        lambda e: e != F.col("element"),
    )
    below = elements.select(F.explode(ancestors).alias("element"), "n").groupBy("element").agg(F.sum("n").alias("below"))
    return (
        paths.join(elements, "element").join(below, "element", "left").where((F.col("n") > 1) | (F.coalesce("below", F.lit(0)) > 0)).select("path").distinct()
    )


def under_text(prefix: str, path: str) -> bool:
    """``under`` of a path that is at hand."""
    return prefix == "" or path == prefix or path.startswith((f"{prefix}[", f"{prefix}."))


def instances_with_value(eav: DataFrame, prefix: str, path: str, value: str) -> DataFrame:
    """(version_key, element) of the object instances at a prefix that hold the value at the path."""
    hits = eav.where((F.col("path") == path) & (F.col("value") == value))
    return hits.select("version_key", instance_key("path_indexed", _depth(prefix)).alias("element")).distinct()


def object_leaves(eav: DataFrame, prefix: str, value_path: str | None = None, value: str | None = None) -> DataFrame:
    """Leaves of the object instances at a prefix, with their instance in ``element``; with a value, of the instances that hold it."""
    leaves = eav.where(under(prefix)).withColumn("element", instance_key("path_indexed", _depth(prefix)))
    if value_path is None:
        return leaves
    if not under_text(prefix, value_path):
        return leaves.join(instances_with_value(eav, prefix, value_path, value), ["version_key", "element"], "left_semi")
    # Both sides of the semi join read leaves that are made once.
    leaves = files.settled(leaves)
    return leaves.join(leaves.where(_holds(value_path, value)).select("version_key", "element"), ["version_key", "element"], "left_semi")


def _holds(path: str, value: str) -> Column:
    return (F.col("path") == path) & (F.col("value") == value)


def _instances(eav: DataFrame, prefix: str, value_path: str | None, value: str | None, *aggregates: Column) -> DataFrame:
    """One row per object instance (with a value, per one that holds it) and the aggregates over its leaves, in one shuffle."""
    if value_path is None or not under_text(prefix, value_path):
        return object_leaves(eav, prefix, value_path, value).groupBy("version_key", "element").agg(F.count(F.lit(1)).alias("__n"), *aggregates).drop("__n")
    grouped = object_leaves(eav, prefix).groupBy("version_key", "element").agg(F.bool_or(_holds(value_path, value)).alias("__holds"), *aggregates)
    return grouped.where("__holds").drop("__holds")


def object_columns(eav: DataFrame, prefix: str, *, value_path: str | None = None, value: str | None = None) -> DataFrame:
    """Sorted member paths of the objects at a prefix; with a value, of the instances that hold it."""
    leaves = eav.where(under(prefix)) if value_path is None else object_leaves(eav, prefix, value_path, value)
    return leaves.select("path").distinct().orderBy("path")


def _member_text(path: str, is_array: bool) -> Column:
    """The values at one path, joined in the order of their elements; null if there are none."""
    own = F.when(F.col("path") == path, F.struct(element_numbers("path_indexed").alias("at"), F.coalesce("value", F.lit("")).alias("v"), F.col("value").isNotNull().alias("has")))
    kept = F.filter(F.array_sort(F.collect_list(own)), lambda x: x["has"])
    text = F.array_join(F.transform(kept, lambda x: x["v"]), ", ")
    return F.when(F.size(kept) > 0, F.concat(F.lit("["), text, F.lit("]")) if is_array else text)


def object_table(docs: DataFrame, eav: DataFrame, prefix: str, members: list[str], *, value_path: str | None = None, value: str | None = None) -> DataFrame:
    """One row per object instance: identity, element and c0..cN, the members' values joined by ", ".

    Members whose path ends in ``[]`` stand in brackets; absent ones are null.
    """
    cells = [_member_text(m, m.endswith("[]")).alias(f"c{k}") for k, m in enumerate(members)]
    grouped = _instances(eav, prefix, value_path, value, *cells)
    return grouped.join(docs, "version_key").select(*IDENTITY, "version_key", "element", *[f"c{k}" for k in range(len(members))])


def object_rows(
    docs: DataFrame, eav: DataFrame, prefix: str, members: list[str], *, value_path: str | None = None, value: str | None = None, term: str | None = None,
    by: str = "record_id", descending: bool = False, start: int = 0, length: int = 50,
) -> Page:
    """A page of the object table.

    Instances are found and ordered first, with at most the one member that orders
    them; only the page's instances are then pivoted.  A search looks at record ids
    and at all values of the instance.  ``by`` is an identity column, element or cN;
    anything else means record_id.
    """
    if value_path is not None and not under_text(prefix, value_path):
        leaves, value_path = object_leaves(eav, prefix, value_path, value), None
    else:
        leaves = object_leaves(eav, prefix)
    # The instances are counted and ordered, and the page's are pivoted, from leaves that are made once.
    leaves = files.settled(leaves.select("version_key", "path", "path_indexed", "value"))
    aggregates = []
    if term:
        aggregates.append(F.bool_or(search(term, ("value",))).alias("__hit"))
    if by not in (*IDENTITY, "element", *[f"c{k}" for k in range(len(members))]):
        by = "record_id"
    cell = {f"c{k}": _member_text(m, m.endswith("[]")).alias(f"c{k}") for k, m in enumerate(members)}
    if by in cell:
        aggregates.append(cell[by])
    found = files.settled(_instances(leaves, prefix, value_path, value, *aggregates))
    total = found.count()
    found = found.join(docs, "version_key").select(*found.columns, *IDENTITY)
    if term:
        found = found.where(F.col("__hit") | search(term, ("record_id",)))
    filtered = found.count() if term else total
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    ties = [F.col("record_id"), F.col("run_record_offset"), element_numbers("element"), F.col("element")]
    # A page of instances; Spark broadcasts it if it is as small as pages are.
    chosen = files.settled(found.orderBy(order, *ties).offset(start).limit(length).select("version_key", "element", *IDENTITY))
    own = object_leaves(leaves, prefix).join(chosen.select("version_key", "element"), ["version_key", "element"], "left_semi")
    rows = own.groupBy("version_key", "element").agg(F.count(F.lit(1)).alias("__n"), *cell.values()).join(chosen, ["version_key", "element"])
    return Page(total, filtered, rows.orderBy(order, *ties).select(*IDENTITY, "element", *cell))


def object_record_shape(docs: DataFrame, eav: DataFrame, prefix: str) -> DataFrame:
    """Identity, objects, total_values (non-null) and max_per_object of each record with objects at the prefix."""
    per_object = object_leaves(eav, prefix).groupBy("version_key", "element").agg(F.count("value").alias("n"))
    per_record = per_object.groupBy("version_key").agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("total_values"), F.max("n").alias("max_per_object"))
    return per_record.join(docs, "version_key").select(*IDENTITY, "version_key", "objects", "total_values", "max_per_object")


def distinct_object_count(eav: DataFrame, prefix: str) -> DataFrame:
    """One row, distinct_objects: different sets of (path, value) among the instances at a prefix."""
    h, g = content_hashes()
    pairs = object_leaves(eav, prefix).select("version_key", "element", h.alias("h"), g.alias("g")).repartition("version_key", "element").distinct()
    contents = pairs.groupBy("version_key", "element").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    return contents.select("h", "g").distinct().agg(F.count(F.lit(1)).alias("distinct_objects"))


def object_member_stats(eav: DataFrame, prefix: str) -> DataFrame:
    """One row per member path: label, type, how many instances have it and how many values they hold."""
    # Three groupings read them.
    leaves = files.settled(object_leaves(eav, prefix).select("version_key", "element", "path", "value_type"))
    per_instance = leaves.groupBy("path", "version_key", "element").agg(F.count(F.lit(1)).alias("n"))
    stats = per_instance.groupBy("path").agg(
        F.count(F.lit(1)).alias("present"), F.min("n").alias("count_min"), mean(F.sum("n"), F.count(F.lit(1))).alias("count_avg"), F.max("n").alias("count_max")
    )
    total = _single(leaves.select("version_key", "element").distinct(), "total")
    is_array = F.col("path").endswith("[]")
    shown = display_type("value_type")
    return (
        stats.join(_mode(leaves, ["path"], "value_type", "value_type"), "path")
        .crossJoin(F.broadcast(total))
        .select(
            "path", member_label("path", prefix).alias("label"), "value_type", is_array.alias("is_array"),
            F.when(is_array, F.concat(F.lit("array["), shown, F.lit("]"))).otherwise(shown).alias("type"),
            "present", percent(F.col("present"), F.col("total")).alias("presence_pct"), "count_min", "count_avg", "count_max",
        )
        .orderBy("path")
    )


# Query templates


def field_usage(eav: DataFrame, limit: int = 50) -> DataFrame:
    """(path, occurrences, docs), most occurrences first."""
    per_doc = eav.groupBy("path", "version_key").agg(F.count(F.lit(1)).alias("n"))
    counted = per_doc.groupBy("path").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("docs"))
    return counted.orderBy(F.desc("occurrences"), "path").limit(limit)


def path_coverage(docs: DataFrame, eav: DataFrame, path: str) -> DataFrame:
    """One row: documents with the path, all documents, coverage_pct."""
    having = eav.where(F.col("path") == path).select("version_key").distinct().agg(F.count(F.lit(1)).alias("docs_with"))
    return having.crossJoin(F.broadcast(_single(docs, "total_docs"))).select("docs_with", "total_docs", percent(F.col("docs_with"), F.col("total_docs")).alias("coverage_pct"))


def value_distribution(eav: DataFrame, path: str, limit: int = 50) -> DataFrame:
    """(value, occurrences) at a path, null as a value of its own."""
    return eav.where(F.col("path") == path).groupBy("value").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), F.col("value").asc_nulls_last()).limit(limit)


def records_using(docs: DataFrame, eav: DataFrame, path: str, limit: int = 100) -> DataFrame:
    keys = eav.where(F.col("path") == path).select("version_key").distinct()
    return docs.join(keys, "version_key", "left_semi").select(*IDENTITY).orderBy(*IDENTITY).limit(limit)


def leaf_counts(docs: DataFrame, eav: DataFrame) -> DataFrame:
    """Identity and leaves of every document."""
    return eav.groupBy("version_key").agg(F.count(F.lit(1)).alias("leaves")).join(docs, "version_key").select(*IDENTITY, "leaves")


def leaf_count_outliers(docs: DataFrame, eav: DataFrame, limit: int = 20) -> DataFrame:
    """The documents with the most and the fewest leaves: end (fat or thin), identity, leaves."""
    counts = leaf_counts(docs, eav)
    fat = counts.orderBy(F.desc("leaves"), *IDENTITY).limit(limit).select(F.lit("fat").alias("end"), *IDENTITY, "leaves")
    thin = counts.orderBy("leaves", *IDENTITY).limit(limit).select(F.lit("thin").alias("end"), *IDENTITY, "leaves")
    return fat.unionByName(thin)


def leaf_count_quantiles(eav: DataFrame) -> DataFrame:
    counts = eav.groupBy("version_key").agg(F.count(F.lit(1)).alias("leaves"))
    at = lambda q: F.percentile("leaves", q)
    return counts.agg(
        F.min("leaves").alias("least"), mean(F.sum("leaves"), F.count(F.lit(1))).alias("average"), at(0.5).alias("median"),
        F.max("leaves").alias("most"), at(0.95).alias("p95"), at(0.05).alias("p05"),
    )


def source_path_matrix(docs: DataFrame, eav: DataFrame) -> DataFrame:
    """(source, path, docs_with, source_docs, coverage_pct) for every path of every source."""
    having = eav.select("version_key", "path").distinct().join(docs.select("version_key", "source"), "version_key")
    counted = having.groupBy("source", "path").agg(F.count(F.lit(1)).alias("docs_with"))
    totals = docs.groupBy("source").agg(F.count(F.lit(1)).alias("source_docs"))
    return counted.join(totals, "source").withColumn("coverage_pct", percent(F.col("docs_with"), F.col("source_docs")))


def prefix_coverage(docs: DataFrame, eav: DataFrame, prefix: str) -> DataFrame:
    """One row: documents with any leaf under the prefix, and their part of all."""
    having = eav.where(under(prefix)).select("version_key").distinct().agg(F.count(F.lit(1)).alias("docs_with"))
    return having.crossJoin(F.broadcast(_single(docs, "total_docs"))).select("docs_with", percent(F.col("docs_with"), F.col("total_docs")).alias("coverage_pct"))


def records_blank_at(docs: DataFrame, eav: DataFrame, prefix: str) -> DataFrame:
    """Identities of documents without any leaf under the prefix."""
    having = eav.where(under(prefix)).select("version_key")
    return docs.join(having, "version_key", "left_anti").select(*IDENTITY)
