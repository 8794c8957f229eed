"""The registered queries of the profiling engine with their DuckDB SQL.

Versions come from ``events`` and order documents from ``orders`` and ``lineitem``
(see ``fixtures``); every query runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordprofile.functions import leaves, paths, values
from recordprofile.operators import filters, history, profile, rundiff, scope, sketches, sql
from recordprofile.operators.flatten import flatten_leaves
from recordprofile.plans import fixtures as fx
from recordprofile.sources import corpus, export, files, versions as vs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

IDENTITY_SQL = "record_id, source, run_id, run_record_offset"
RUN = "2024-01-03-src3"
OLD_DAY, NEW_DAY = "2024-01-15", "2024-01-30"
SCOPE = scope.Scope({"source": ["src1", "src2"]}, "run_date >= '2024-01-10'")


def query(name: str, oracle: str, ctes: str = fx.DOCS_SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {ctes}\n{oracle}"
        return f

    return add


def user_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(docs, eav) of the current user versions that have a payload."""
    current = vs.current_records(fx.versions(spark, sf_dir)).where("payload is not null")
    return corpus.Corpus.documents(current), flatten_leaves(current.withColumn("version_key", values.version_key()), max_depth=fx.VERSION_DEPTH)


def order_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = fx.order_docs(spark, sf_dir)
    return docs.drop("payload"), flatten_leaves(docs, max_depth=fx.ORDER_DEPTH)


def percent_sql(n: str, d: str) -> str:
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE ((2000 * {n} + {d}) // (2 * {d})) / 10.0 END"


def mean_sql(total: str, n: str) -> str:
    return f"((200 * {total} + {n}) // (2 * {n})) / 100.0"


# Versions


@query("current_records", "SELECT record_id, source, run_id, run_record_offset, action FROM current", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return vs.current_records(vs.metadata_only(fx.versions(spark, sf_dir))).select("record_id", "source", "run_id", "run_record_offset", "action")


@query(
    "payload_reads",
    """SELECT record_id, run_id, payload FROM versions
       WHERE run_type = 'daily' AND source IN ('src0', 'src3') AND payload LIKE '%purchase%'""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    found = fx.versions(spark, sf_dir)
    return vs.read_payloads(found, ["record_id", "run_id", "payload"], where="payload like '%purchase%'", run_type="daily", source=["src0", "src3"])


@query("record_versions", "SELECT record_id, run_id, run_record_offset, action, CAST(run_date AS VARCHAR) AS run_date FROM versions WHERE record_id = 'u:7'", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return vs.record_history(fx.versions(spark, sf_dir), "u:7").select("record_id", "run_id", "run_record_offset", "action", F.col("run_date").cast("string"))


@query("versions_of_runs", f"SELECT record_id, run_id, action FROM versions WHERE run_id IN ('{RUN}', '2024-01-05-src1')", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return vs.of_runs(fx.versions(spark, sf_dir), [RUN, "2024-01-05-src1"]).select("record_id", "run_id", "action")


@query(
    "browse_versions",
    """SELECT record_id, source, run_id, run_record_offset, action, CAST(run_date AS VARCHAR) AS run_date, strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S') AS run_timestamp
       FROM versions WHERE source IN ('src1', 'src2') AND (record_id ILIKE '%u:1%' OR source ILIKE '%u:1%' OR run_id ILIKE '%u:1%' OR run_type ILIKE '%u:1%' OR action ILIKE '%u:1%')
         AND (action = 'index')
       ORDER BY versions.run_timestamp DESC NULLS LAST, record_id, run_id, run_record_offset LIMIT 50 OFFSET 20""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    condition = filters.version_filter({"source": ["src1", "src2"], "unknown": ["x"]}, term="U:1", where="action = 'index'")
    kept = fx.versions(spark, sf_dir).drop("payload").where(condition)
    rows = filters.page_rows(kept, "run_timestamp", ("record_id", "run_id", "run_record_offset"), descending=True, start=20, length=50, allowed=filters.VERSION_ORDER)
    return filters.shown_versions(rows).select("record_id", "source", "run_id", "run_record_offset", "action", "run_date", "run_timestamp")


@query(
    "browse_versions_seek",
    """SELECT record_id, run_id, run_record_offset, action FROM versions WHERE source IN ('src1', 'src2')
       ORDER BY run_timestamp DESC NULLS LAST, record_id, run_id, run_record_offset LIMIT 50 OFFSET 100""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    """The third page, each page going on where the one before ended."""
    kept = fx.versions(spark, sf_dir).drop("payload").where(filters.version_filter({"source": ["src1", "src2"]}))
    order = {"by": "run_timestamp", "ties": ("record_id", "run_id", "run_record_offset")}
    after = None
    for _page in range(2):
        last = filters.seek_rows(kept, **order, descending=True, after=after, allowed=filters.VERSION_ORDER).collect()[-1]  # a page's rows
        after = filters.continuation(last, **order)
    return filters.seek_rows(kept, **order, descending=True, after=after).select("record_id", "run_id", "run_record_offset", "action")


@query(
    "record_lookup",
    """SELECT record_id, run_id, run_record_offset, action, CAST(run_date AS VARCHAR) AS run_date, 'history' AS what FROM versions WHERE record_id = 'u:7'
       UNION ALL SELECT record_id, run_id, run_record_offset, NULL, NULL, 'current' FROM current WHERE record_id = 'u:7'""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    """One record in the table that is laid out for look-ups."""
    path = files.scratch(spark)
    vs.write_lookup(fx.versions(spark, sf_dir), path)
    found = vs.read_lookup(spark, path)
    history_ = vs.record_history(found, "u:7").select("record_id", "run_id", "run_record_offset", "action", F.col("run_date").cast("string"), F.lit("history").alias("what"))
    return history_.unionByName(vs.current_key(found, "u:7").withColumn("what", F.lit("current")), allowMissingColumns=True)


@query(
    "headline_fields",
    """SELECT record_id, run_id, json_extract_string(payload, '$.title') AS title, CAST(NULL AS VARCHAR) AS kinds, length(payload) AS payload_length
       FROM versions WHERE payload IS NOT NULL""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    found = fx.versions(spark, sf_dir).where("payload is not null").withColumn("text", values.decoded(F.col("payload").cast("binary")))
    return found.select(
        "record_id", "run_id", values.headline(F.col("text"), "title").alias("title"), values.headline(F.col("text"), "kinds").alias("kinds"),
        F.char_length("text").cast("long").alias("payload_length"),
    )


# Flatten


@query("flatten_leaves", f"SELECT * FROM eav UNION ALL SELECT * FROM ({fx.leaves_sql('payloads', 'version_key')}) WHERE false")
def _(spark, sf_dir):
    return user_corpus(spark, sf_dir)[1]


@query("flatten_excluding", "SELECT * FROM eav WHERE path NOT LIKE 'profile%' AND path <> 'title'")
def _(spark, sf_dir):
    current = vs.current_records(fx.versions(spark, sf_dir)).where("payload is not null").withColumn("version_key", values.version_key())
    return flatten_leaves(current, excluded_fields=("profile", "title"), max_depth=fx.VERSION_DEPTH)


@query("flatten_order_docs", "SELECT path, value_type, count(*) AS leaves, min(value) AS least, max(value) AS most FROM eav GROUP BY ALL", fx.ORDERS_SQL)
def _(spark, sf_dir):
    return profile.path_extremes(order_corpus(spark, sf_dir)[1])


@query("flatten_deep", fx.leaves_sql("deep", "version_key"), fx.DEEP_SQL)
def _(spark, sf_dir):
    """200 levels, by the path that states no depth."""
    return flatten_leaves(fx.deep_docs(spark, sf_dir))


@query(
    "flatten_malformed",
    f"SELECT path, value_type, count(*) AS leaves, count(DISTINCT record_id) AS records FROM ({fx.leaves_sql('sound', 'record_id')}) GROUP BY ALL",
    fx.BROKEN_SQL,
)
def _(spark, sf_dir):
    """Cut texts, endless nesting and payloads that are no objects have no leaves."""
    eav = flatten_leaves(fx.broken_versions(spark, sf_dir), keys=("record_id",), lenient=True)
    return eav.groupBy("path", "value_type").agg(F.count(F.lit(1)).alias("leaves"), F.count_distinct("record_id").alias("records"))


@query("flatten_sql", "SELECT * FROM eav")
def _(spark, sf_dir):
    """The leaves by a table function in SQL."""
    leaves.register_json_leaves(spark)
    current = vs.current_records(fx.versions(spark, sf_dir)).where("payload is not null").withColumn("version_key", values.version_key())
    return spark.sql("SELECT d.version_key, l.* FROM {docs} d, LATERAL json_leaves(d.payload) l", docs=current.select("version_key", "payload"))


@query("flatten_any_depth_orders", "SELECT path, value_type, count(*) AS leaves, min(value) AS least, max(value) AS most FROM eav GROUP BY ALL", fx.ORDERS_SQL)
def _(spark, sf_dir):
    """The same as flatten_order_docs without a stated depth."""
    return profile.path_extremes(flatten_leaves(fx.order_docs(spark, sf_dir)))


# Paths


@query(
    "path_functions",
    r"""SELECT DISTINCT path, path_indexed, regexp_replace(path, '\][^\]]*$', ']') AS element, regexp_extract(path, '^(.*\])', 1) AS object_prefix,
              CASE WHEN path_indexed LIKE '%]%' THEN regexp_replace(path_indexed, '^((?:[^\]]*\]){1}).*$', '\1') ELSE path_indexed END AS instance,
              regexp_replace(path, '^([^.\[]+).*$', '\1') AS field, regexp_replace(path_indexed, '^([^.\[]+(\[[0-9]+\])?).*$', '\1') AS top_element,
              coalesce(nullif(ltrim(substr(path, 9), '.'), ''), path) AS label,
              CASE value_type WHEN 'object-empty' THEN 'object' WHEN 'array-empty' THEN 'array' ELSE value_type END AS shown,
              (path = 'orders' OR starts_with(path, 'orders[') OR starts_with(path, 'orders.')) AS in_orders
       FROM eav""",
)
def _(spark, sf_dir):
    eav = user_corpus(spark, sf_dir)[1]
    return eav.select(
        "path", "path_indexed", paths.element_prefix("path").alias("element"), paths.object_prefix("path").alias("object_prefix"),
        paths.instance_key("path_indexed", 1).alias("instance"), paths.top_field("path").alias("field"), paths.top_element("path_indexed").alias("top_element"),
        paths.member_label("path", "orders[]").alias("label"), paths.display_type("value_type").alias("shown"), paths.under("orders").alias("in_orders"),
    ).distinct()


# Profiling


@query("field_usage", "SELECT path, count(*) AS occurrences, count(DISTINCT version_key) AS docs FROM eav GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, sf_dir):
    return profile.field_usage(user_corpus(spark, sf_dir)[1])


@query("field_usage_orders", "SELECT path, count(*) AS occurrences, count(DISTINCT version_key) AS docs FROM eav GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", fx.ORDERS_SQL)
def _(spark, sf_dir):
    return profile.field_usage(order_corpus(spark, sf_dir)[1])


@query(
    "path_coverage",
    f"""SELECT docs_with, total_docs, {percent_sql("docs_with", "total_docs")} AS coverage_pct
        FROM (SELECT count(DISTINCT version_key) AS docs_with, (SELECT count(*) FROM docs) AS total_docs FROM eav WHERE path = 'orders[].count')""",
)
def _(spark, sf_dir):
    return profile.path_coverage(*user_corpus(spark, sf_dir), "orders[].count")


@query("value_distribution", "SELECT value, count(*) AS occurrences FROM eav WHERE path = 'profile.extra[]' GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 50")
def _(spark, sf_dir):
    return profile.value_distribution(user_corpus(spark, sf_dir)[1], "profile.extra[]")


@query("records_using_field", f"SELECT {IDENTITY_SQL} FROM docs WHERE version_key IN (SELECT version_key FROM eav WHERE path = 'orders[].kind') ORDER BY ALL LIMIT 100")
def _(spark, sf_dir):
    return profile.records_using(*user_corpus(spark, sf_dir), "orders[].kind")


@query(
    "leaf_count_outliers",
    f"""SELECT * FROM (SELECT 'fat' AS "end", {IDENTITY_SQL}, leaves FROM c ORDER BY leaves DESC, {IDENTITY_SQL} LIMIT 20)
        UNION ALL SELECT * FROM (SELECT 'thin', {IDENTITY_SQL}, leaves FROM c ORDER BY leaves, {IDENTITY_SQL} LIMIT 20)""",
    fx.ORDERS_SQL + f", c AS (SELECT {IDENTITY_SQL}, count(*) AS leaves FROM eav JOIN docs USING (version_key) GROUP BY ALL)",
)
def _(spark, sf_dir):
    return profile.leaf_count_outliers(*order_corpus(spark, sf_dir))


@query(
    "leaf_count_quantiles",
    f"""SELECT min(n) AS least, {mean_sql("sum(n)", "count(*)")} AS average, quantile_cont(n, 0.5) AS median, max(n) AS most,
               quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.05) AS p05 FROM (SELECT count(*) AS n FROM eav GROUP BY version_key)""",
    fx.ORDERS_SQL,
)
def _(spark, sf_dir):
    return profile.leaf_count_quantiles(order_corpus(spark, sf_dir)[1])


@query(
    "source_path_matrix",
    f"""SELECT source, path, docs_with, source_docs, {percent_sql("docs_with", "source_docs")} AS coverage_pct
        FROM (SELECT source, path, count(DISTINCT version_key) AS docs_with FROM eav JOIN docs USING (version_key) GROUP BY ALL)
        JOIN (SELECT source, count(*) AS source_docs FROM docs GROUP BY 1) USING (source)""",
)
def _(spark, sf_dir):
    return profile.source_path_matrix(*user_corpus(spark, sf_dir))


@query(
    "prefix_coverage",
    f"""SELECT docs_with, {percent_sql("docs_with", "total_docs")} AS coverage_pct
        FROM (SELECT count(DISTINCT version_key) AS docs_with, (SELECT count(*) FROM docs) AS total_docs FROM eav
              WHERE path = 'orders' OR path LIKE 'orders[%' OR path LIKE 'orders.%')""",
)
def _(spark, sf_dir):
    return profile.prefix_coverage(*user_corpus(spark, sf_dir), "orders")


@query("records_blank_at", f"SELECT {IDENTITY_SQL} FROM docs WHERE version_key NOT IN (SELECT version_key FROM eav WHERE path LIKE 'orders[%')")
def _(spark, sf_dir):
    return profile.records_blank_at(*user_corpus(spark, sf_dir), "orders[]")


OVERVIEW_SQL = f"""
    , f AS (SELECT *, regexp_replace(path, '^([^.\\[]+).*$', '\\1') AS field FROM eav),
    kinds AS (SELECT field, bool_or(path LIKE field || '[%') AS is_array, bool_or(contains(path, '.')) AS is_complex FROM f GROUP BY 1),
    shape AS (SELECT *, CASE WHEN is_array THEN field || '[]' ELSE field END AS prefix FROM kinds),
    card AS (
        SELECT field, count(*) AS doc_count, min(n) AS count_min, {mean_sql("sum(n)", "count(*)")} AS count_avg, max(n) AS count_max
        FROM (SELECT field, version_key, count(DISTINCT regexp_replace(path_indexed, '^([^.\\[]+(\\[[0-9]+\\])?).*$', '\\1')) AS n FROM f GROUP BY ALL) GROUP BY 1),
    types AS (
        SELECT field, value_type FROM (SELECT field, value_type, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value_type) AS k
            FROM f JOIN shape USING (field) WHERE path = prefix AND NOT is_complex GROUP BY 1, 2) WHERE k = 1),
    scalars AS (SELECT field, count(DISTINCT value) AS n, min(value) AS sample FROM f JOIN shape USING (field) WHERE path = prefix AND NOT is_complex GROUP BY 1),
    inside AS (
        SELECT f.*, prefix, CASE WHEN is_array THEN regexp_extract(path_indexed, '^([^\\]]*\\])', 1) ELSE '' END AS e FROM f JOIN shape USING (field)
        WHERE is_complex AND (path = prefix OR starts_with(path, prefix || '[') OR starts_with(path, prefix || '.'))),
    members AS (
        SELECT field, list(path ORDER BY path) AS members, string_agg(coalesce(nullif(ltrim(substr(path, length(prefix) + 1), '.'), ''), path), ', ' ORDER BY path) AS labels
        FROM (SELECT DISTINCT field, path, prefix FROM inside) GROUP BY 1),
    objects AS (
        SELECT field, count(DISTINCT c) AS n
        FROM (SELECT field, version_key, e, string_agg(DISTINCT path || chr(31) || coalesce(value, '<null>'), chr(30) ORDER BY path || chr(31) || coalesce(value, '<null>')) AS c
              FROM inside GROUP BY ALL) GROUP BY 1),
    shown AS (
        SELECT shape.*, CASE WHEN is_complex THEN 'object' WHEN value_type = 'object-empty' THEN 'object' WHEN value_type = 'array-empty' THEN 'array'
                             ELSE coalesce(value_type, 'null') END AS t FROM shape LEFT JOIN types USING (field))
    SELECT field, CASE WHEN is_array THEN 'array[' || t || ']' ELSE t END AS type, is_complex, is_array, prefix,
           CASE WHEN is_complex THEN field ELSE prefix END AS drill_path, doc_count,
           {percent_sql("doc_count", "(SELECT count(*) FROM docs)")} AS coverage_pct, count_min, count_avg, count_max,
           coalesce(CASE WHEN is_complex THEN objects.n ELSE scalars.n END, 0) AS distinct_values,
           CASE WHEN is_complex THEN labels ELSE sample END AS sample_value, coalesce(members, []) AS members
    FROM shown JOIN card USING (field) LEFT JOIN scalars USING (field) LEFT JOIN members USING (field) LEFT JOIN objects USING (field)
    ORDER BY doc_count DESC, field"""


@query("schema_overview", "", fx.DOCS_SQL + OVERVIEW_SQL)
def _(spark, sf_dir):
    return profile.schema_overview(*user_corpus(spark, sf_dir))


@query("schema_overview_orders", "", fx.ORDERS_SQL + OVERVIEW_SQL)
def _(spark, sf_dir):
    return profile.schema_overview(*order_corpus(spark, sf_dir))


def values_sql(where: str, more: str = "") -> str:
    return f"""SELECT path, value, documents, occurrences, {percent_sql("occurrences", "whole")} AS pct_of_path
        FROM (SELECT path, value, count(DISTINCT version_key) AS documents, count(*) AS occurrences, CAST(sum(count(*)) OVER (PARTITION BY path) AS BIGINT) AS whole
              FROM eav WHERE value IS NOT NULL AND ({where}) GROUP BY 1, 2) {more}"""


@query("path_values", values_sql("true", "WHERE value ILIKE '%pur%' OR path ILIKE '%pur%' ORDER BY documents DESC, path, value LIMIT 200"))
def _(spark, sf_dir):
    found = profile.value_frequencies(user_corpus(spark, sf_dir)[1]).where(filters.search("pur", ("value", "path")))
    return filters.page_rows(found, "documents", ("path", "value"), descending=True, length=200)


@query("value_frequencies_orders", values_sql("path LIKE 'lines[%'"), fx.ORDERS_SQL)
def _(spark, sf_dir):
    return profile.value_frequencies(order_corpus(spark, sf_dir)[1], "lines")


@query("value_records", f"SELECT {IDENTITY_SQL}, version_key FROM eav JOIN docs USING (version_key) WHERE path = 'lines[].l_returnflag' AND value = 'R'", fx.ORDERS_SQL)
def _(spark, sf_dir):
    return profile.records_with_value(*order_corpus(spark, sf_dir), "lines[].l_returnflag", "R")


@query("path_record_counts", f"SELECT {IDENTITY_SQL}, version_key, count(value) AS value_count FROM eav JOIN docs USING (version_key) WHERE path = 'profile.extra[]' GROUP BY ALL")
def _(spark, sf_dir):
    return profile.path_record_counts(*user_corpus(spark, sf_dir), "profile.extra[]")


@query(
    "object_field_paths",
    r"""SELECT DISTINCT q.path FROM (SELECT DISTINCT path, regexp_replace(path, '\][^\]]*$', ']') AS e FROM eav WHERE contains(path, ']')) q, (SELECT DISTINCT path FROM eav) a
        WHERE q.path <> a.path AND (a.path = e OR starts_with(a.path, e || '[') OR starts_with(a.path, e || '.'))""",
)
def _(spark, sf_dir):
    return profile.object_field_paths(user_corpus(spark, sf_dir)[1])


LINE_SQL = r"""
    , o AS (SELECT *, regexp_extract(path_indexed, '^([^\]]*\])', 1) AS element FROM eav WHERE path LIKE 'lines[]%'),
    hit AS (SELECT DISTINCT version_key, element FROM o WHERE path = 'lines[].l_returnflag' AND value = 'N')"""


@query("object_columns", "SELECT DISTINCT path FROM o JOIN hit USING (version_key, element) ORDER BY 1", fx.ORDERS_SQL + LINE_SQL)
def _(spark, sf_dir):
    return profile.object_columns(order_corpus(spark, sf_dir)[1], "lines[]", value_path="lines[].l_returnflag", value="N")


PIVOT_SQL = f"""SELECT {IDENTITY_SQL}, element, string_agg(value, ', ' ORDER BY path_indexed) FILTER (path = 'lines[].l_partkey') AS c0,
    string_agg(value, ', ' ORDER BY path_indexed) FILTER (path = 'lines[].qty') AS c1, string_agg(value, ', ') FILTER (path = 'lines[].absent') AS c2
    FROM o JOIN hit USING (version_key, element) JOIN docs USING (version_key) GROUP BY ALL"""
LINE_MEMBERS = ["lines[].l_partkey", "lines[].qty", "lines[].absent"]


@query("object_table", PIVOT_SQL, fx.ORDERS_SQL + LINE_SQL)
def _(spark, sf_dir):
    return profile.object_table(*order_corpus(spark, sf_dir), "lines[]", LINE_MEMBERS, value_path="lines[].l_returnflag", value="N").drop("version_key")


@query(
    "object_rows",
    f"""SELECT * FROM ({PIVOT_SQL}) ORDER BY c0 DESC NULLS LAST, record_id, run_record_offset, CAST(regexp_extract(element, '([0-9]+)', 1) AS INT) LIMIT 50 OFFSET 10""",
    fx.ORDERS_SQL + LINE_SQL,
)
def _(spark, sf_dir):
    found = profile.object_rows(
        *order_corpus(spark, sf_dir), "lines[]", LINE_MEMBERS, value_path="lines[].l_returnflag", value="N", by="c0", descending=True, start=10, length=50
    )
    return found.rows


@query(
    "object_record_shape",
    f"""SELECT {IDENTITY_SQL}, version_key, count(*) AS objects, CAST(sum(n) AS BIGINT) AS total_values, max(n) AS max_per_object
        FROM (SELECT version_key, element, count(value) AS n FROM o GROUP BY ALL) JOIN docs USING (version_key) GROUP BY ALL""",
    fx.ORDERS_SQL + LINE_SQL,
)
def _(spark, sf_dir):
    return profile.object_record_shape(*order_corpus(spark, sf_dir), "lines[]")


def member_stats_sql(leaves: str, prefix: str) -> str:
    n = len(prefix) + 1
    return f"""SELECT path, coalesce(nullif(ltrim(substr(path, {n}), '.'), ''), path) AS label, value_type, suffix(path, '[]') AS is_array,
               CASE WHEN suffix(path, '[]') THEN 'array[' || replace(value_type, '-empty', '') || ']' ELSE replace(value_type, '-empty', '') END AS type, present,
               {percent_sql("present", f"(SELECT count(DISTINCT (version_key, element)) FROM {leaves})")} AS presence_pct, count_min, count_avg, count_max
        FROM (SELECT path, count(*) AS present, min(n) AS count_min, {mean_sql("sum(n)", "count(*)")} AS count_avg, max(n) AS count_max
              FROM (SELECT path, version_key, element, count(*) AS n FROM {leaves} GROUP BY ALL) GROUP BY 1)
        JOIN (SELECT path, value_type FROM (SELECT path, value_type, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, value_type) AS k FROM {leaves} GROUP BY 1, 2)
              WHERE k = 1) USING (path) ORDER BY path"""


@query("object_member_stats", member_stats_sql("o", "lines[]"), fx.ORDERS_SQL + LINE_SQL)
def _(spark, sf_dir):
    return profile.object_member_stats(order_corpus(spark, sf_dir)[1], "lines[]")


@query(
    "object_member_stats_nested",
    member_stats_sql("m", "s[]"),
    fx.NESTED_SQL + r""", m AS (SELECT *, regexp_extract(path_indexed, '^([^\]]*\])', 1) AS element FROM nested_eav)""",
)
def _(spark, sf_dir):
    """Members of arrays within arrays: those that are elements themselves are arrays, those inside elements aren't."""
    return profile.object_member_stats(flatten_leaves(fx.nested_orders(spark, sf_dir), max_depth=fx.ORDER_DEPTH + 2), "s[]")


@query(
    "distinct_object_count",
    """SELECT count(DISTINCT c) AS distinct_objects
       FROM (SELECT version_key, element, string_agg(DISTINCT path || '=' || value, '|' ORDER BY path || '=' || value) AS c FROM o GROUP BY ALL)""",
    fx.ORDERS_SQL + LINE_SQL,
)
def _(spark, sf_dir):
    return profile.distinct_object_count(order_corpus(spark, sf_dir)[1], "lines[]")


# Scope and SQL

SCOPE_SQL = "SELECT version_key FROM docs WHERE source IN ('src1', 'src2') AND run_date >= DATE '2024-01-10'"


@query("scoped_path_values", values_sql(f"path LIKE 'kinds%' AND version_key IN ({SCOPE_SQL})"))
def _(spark, sf_dir):
    return profile.value_frequencies(scope.scoped(*user_corpus(spark, sf_dir), SCOPE)[1], "kinds")


@query("scoped_doc_total", f"SELECT count(*) AS n FROM ({SCOPE_SQL})")
def _(spark, sf_dir):
    docs, _eav = scope.scoped(*user_corpus(spark, sf_dir), SCOPE)
    return docs.agg(F.count(F.lit(1)).alias("n"))


AD_HOC = "WITH t AS (SELECT source, path, count(*) AS n FROM eav JOIN docs USING (version_key) GROUP BY source, path) SELECT * FROM t WHERE n > 1 ORDER BY n DESC, source, path"


@query("scoped_sql", "SELECT source, path, count(*) AS n FROM eav JOIN docs USING (version_key) WHERE version_key IN (" + SCOPE_SQL + ") GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    return sql.scoped_sql(AD_HOC, *user_corpus(spark, sf_dir), scope=SCOPE)


# History

SOURCES_SQL = """SELECT source, coalesce(record_count, 0) AS record_count, version_count, run_count, first_run_date, last_run_date
    FROM (SELECT source, count(*) AS version_count, count(DISTINCT run_id) AS run_count, CAST(min(run_date) AS VARCHAR) AS first_run_date,
                 CAST(max(run_date) AS VARCHAR) AS last_run_date FROM versions GROUP BY 1)
    FULL JOIN (SELECT source, count(*) AS record_count FROM current WHERE action = 'index' GROUP BY 1) USING (source)"""
RUNS_SQL = """SELECT run_id, any_value(source) AS source, any_value(run_type) AS run_type, CAST(any_value(run_date) AS VARCHAR) AS run_date,
    strftime(max(run_timestamp), '%Y-%m-%d %H:%M:%S') AS run_timestamp, count(*) AS record_count, count(*) FILTER (action = 'index') AS index_count,
    count(*) FILTER (action = 'delete') AS delete_count, count(*) FILTER (action = 'skip') AS skip_count, count(*) FILTER (action = 'error') AS error_count
    FROM versions GROUP BY 1"""


@query("source_overview", SOURCES_SQL, fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return history.source_overview(fx.versions(spark, sf_dir))


@query("one_source", f"SELECT * FROM ({SOURCES_SQL}) WHERE source = 'src2'", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return history.one_source(fx.versions(spark, sf_dir), "src2")[0]


@query("run_summaries", RUNS_SQL, fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return history.run_summary(fx.versions(spark, sf_dir))


@query("recent_runs", f"SELECT * FROM ({RUNS_SQL}) WHERE source IN ('src0', 'src2') ORDER BY run_timestamp DESC, run_id DESC LIMIT 15", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return history.recent_runs(fx.versions(spark, sf_dir), sources=["src0", "src2"], limit=15)


@query(
    "run_page",
    f"SELECT * FROM ({RUNS_SQL}) WHERE run_id ILIKE '%-1%' AND run_type IN ('daily') ORDER BY record_count DESC NULLS LAST, run_timestamp DESC NULLS LAST, run_id DESC LIMIT 20 OFFSET 5",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    return history.run_rows(fx.versions(spark, sf_dir), term="-1", run_types=["daily"], by="record_count", start=5, length=20)


@query("run_meta", f"SELECT * FROM ({RUNS_SQL}) WHERE run_id = '{RUN}'", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return history.run_header(fx.versions(spark, sf_dir), RUN)


# Reading, single records and values


@query("versions_scanned", "SELECT source, run_type, count(*) AS versions, count(payload) AS payloads, sum(length(payload)) AS payload_chars FROM versions GROUP BY ALL", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    """The versions written as files and scanned anew."""
    path = files.scratch(spark)
    fx.versions(spark, sf_dir).drop("filename").write.parquet(path)
    found = vs.read_versions(spark, path).where("filename is not null")
    counts = F.count(F.lit(1)).alias("versions"), F.count("payload").alias("payloads"), F.sum(F.char_length("payload")).alias("payload_chars")
    return found.groupBy("source", "run_type").agg(*counts)


@query(
    "sample_parsed",
    """SELECT record_id, run_id, json_extract_string(payload, '$.title') AS title, CAST(json_extract_string(payload, '$.profile.signup') AS BOOLEAN) AS signup
       FROM versions WHERE record_id = 'u:7' AND payload IS NOT NULL""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    found = vs.sample_parsed(fx.versions(spark, sf_dir), 1_000_000, record_id="u:7")
    return found.select("record_id", "run_id", F.variant_get("parsed", "$.title", "string").alias("title"), F.variant_get("parsed", "$.profile.signup", "boolean").alias("signup"))


@query("versions_on_day", "SELECT record_id, run_id, action FROM versions WHERE run_date = DATE '2024-01-05'", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return fx.versions(spark, sf_dir).where(filters.on_day("run_timestamp", "2024-01-05")).select("record_id", "run_id", "action")


@query(
    "documents_of_versions",
    """SELECT record_id || '|' || run_id || '|' || run_record_offset AS version_key, strftime(run_timestamp, '%Y-%m-%d %H:%M:%S') AS run_timestamp,
              CAST(run_date AS VARCHAR) AS run_date, CASE source WHEN 'src1' THEN 'json' ELSE 'xml' END AS raw_format FROM versions""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    """Naive UTC timestamps, run dates and raw formats of every version."""
    docs = corpus.Corpus.documents(fx.versions(spark, sf_dir))
    return docs.select(
        "version_key", F.col("run_timestamp").cast("string").alias("run_timestamp"), F.col("run_date").cast("string").alias("run_date"),
        values.raw_format("source", {"src1": "json"}).alias("raw_format"),
    )


@query("current_key", "SELECT record_id, run_id, run_record_offset FROM current WHERE record_id = 'u:7'", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    return vs.current_key(fx.versions(spark, sf_dir), "u:7")


@query(
    "one_version",
    """SELECT record_id, run_id, run_record_offset, action, payload FROM current WHERE record_id = 'u:7'
       UNION ALL SELECT record_id, run_id, run_record_offset, action, payload FROM versions WHERE record_id = 'u:7' AND run_id = '2024-01-04-src3' AND run_record_offset = 1""",
    fx.VERSIONS_SQL,
)
def _(spark, sf_dir):
    """The current version of a record and one of a run."""
    found = fx.versions(spark, sf_dir)
    both = vs.record_version(found, "u:7").unionByName(vs.record_version(found, "u:7", "2024-01-04-src3", 1))
    return both.select("record_id", "run_id", "run_record_offset", "action", "payload")


@query("metadata_rebuilt", "SELECT source, action, count(*) AS versions, count(DISTINCT filename) AS files FROM versions GROUP BY ALL", fx.VERSIONS_SQL)
def _(spark, sf_dir):
    done = vs.rebuild_metadata(spark, {"versions": lambda: fx.versions(spark, sf_dir)}, files.scratch(spark))
    found = spark.read.parquet(done["versions"]["path"])
    return found.groupBy("source", "action").agg(F.count(F.lit(1)).alias("versions"), F.count_distinct("filename").alias("files"))


EXPORTED = "record_id string, run_date string, run_timestamp string, payload string"
EXPORT_SQL = "SELECT record_id, CAST(run_date AS VARCHAR) AS run_date, strftime(run_timestamp, '%Y-%m-%dT%H:%M:%S') AS run_timestamp, payload FROM current"


@query("exported_csv", EXPORT_SQL, fx.VERSIONS_SQL)
def _(spark, sf_dir):
    path = files.scratch(spark)
    export.write_csv(vs.current_records(fx.versions(spark, sf_dir)).select("record_id", "run_date", "run_timestamp", "payload"), path)
    return spark.read.schema(EXPORTED).option("header", True).option("escape", '\\').csv(path)


@query("exported_json", EXPORT_SQL, fx.VERSIONS_SQL)
def _(spark, sf_dir):
    path = files.scratch(spark)
    export.write_json(vs.current_records(fx.versions(spark, sf_dir)).select("record_id", "run_date", "run_timestamp", "payload"), path)
    return spark.read.schema(EXPORTED).json(path)


@query(
    "scalar_arrays",
    """SELECT prefix, EXISTS (SELECT 1 FROM eav WHERE path = prefix) AND prefix LIKE '%[]' AS is_scalar
       FROM (VALUES ('kinds[]'), ('orders[]'), ('title'), ('profile.extra[]')) AS p (prefix)""",
)
def _(spark, sf_dir):
    eav = user_corpus(spark, sf_dir)[1]
    return spark.createDataFrame([(p, profile.is_scalar_array(eav, p)) for p in ("kinds[]", "orders[]", "title", "profile.extra[]")], "prefix string, is_scalar boolean")


@query(
    "record_page",
    f"""SELECT {IDENTITY_SQL}, version_key, count(value) AS value_count FROM eav JOIN docs USING (version_key)
        WHERE path = 'kinds[]' AND (record_id ILIKE '%1%' OR source ILIKE '%1%') GROUP BY ALL
        ORDER BY value_count DESC, record_id, source, run_id, run_record_offset LIMIT 30 OFFSET 5""",
)
def _(spark, sf_dir):
    counts = profile.path_record_counts(*user_corpus(spark, sf_dir), "kinds[]")
    return profile.record_page(counts, term="1", by="value_count", descending=True, start=5, length=30).rows


@query(
    "sketches_in_bounds",
    "SELECT path, count(*) AS leaves, true AS documents_near, true AS values_near, true AS median_near FROM eav GROUP BY 1",
)
def _(spark, sf_dir):
    """Whether the estimates of each path, merged from sketches by source, lie within four standard errors of the exact numbers."""
    docs, eav = user_corpus(spark, sf_dir)
    sourced = eav.join(docs.select("version_key", "source"), "version_key")
    found = sketches.estimates(sketches.merge_sketches(sketches.path_sketches(sourced, "source")), (0.45, 0.55))
    number = F.when(F.col("value_type") == "number", F.col("value").cast("double"))
    exact = eav.groupBy("path").agg(F.count_distinct("version_key").alias("d"), F.count_distinct("value").alias("v"), F.percentile(number, 0.5).alias("median"))
    near = lambda estimate, n: F.abs(F.col(estimate) - F.col(n)) <= F.greatest(F.lit(1), F.col(n) * 0.065)
    between = F.coalesce(F.col("median").between(F.col("quantiles")[0], F.col("quantiles")[1]), F.col("median").isNull())
    return found.join(exact, "path").select("path", "leaves", near("documents", "d").alias("documents_near"), near("different_values", "v").alias("values_near"), between.alias("median_near"))


# Corpus

DAYS_SQL = ", ".join(
    f"""{name} AS (SELECT *, record_id || '|' || run_id || '|' || run_record_offset AS version_key FROM versions WHERE run_date <= DATE '{day}'
        QUALIFY row_number() OVER (PARTITION BY source, record_id ORDER BY run_timestamp DESC, run_id DESC, run_record_offset DESC, filename DESC) = 1)"""
    for name, day in (("old_current", OLD_DAY), ("live", NEW_DAY))
)
UPDATE_SQL = f"{fx.VERSIONS_SQL}, {DAYS_SQL}, docs AS (SELECT * FROM old_current WHERE payload IS NOT NULL)"


def _by_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(documents as of the old day, live keys as of the new day)."""
    found = fx.versions(spark, sf_dir)
    docs = corpus.Corpus.documents(vs.current_records(found.where(F.col("run_date") <= F.lit(OLD_DAY).cast("date"))).where("payload is not null"))
    return docs, corpus.live_keys(found.where(F.col("run_date") <= F.lit(NEW_DAY).cast("date")))


@query("corpus_insert_set", "SELECT version_key, run_id, action FROM live WHERE action <> 'delete' AND version_key NOT IN (SELECT version_key FROM docs)", UPDATE_SQL)
def _(spark, sf_dir):
    docs, live = _by_day(spark, sf_dir)
    return corpus.insert_set(live, docs).select("version_key", "run_id", "action")


@query("corpus_delete_set", "SELECT version_key FROM docs WHERE version_key NOT IN (SELECT version_key FROM live)", UPDATE_SQL)
def _(spark, sf_dir):
    docs, live = _by_day(spark, sf_dir)
    return corpus.delete_set(live, docs)


@query(
    "corpus_after_update",
    f"""SELECT path, count(*) AS leaves, count(DISTINCT version_key) AS docs, count(DISTINCT value) AS different
        FROM ({fx.leaves_sql("kept", "version_key")}) GROUP BY 1""",
    UPDATE_SQL + ", kept AS (SELECT * FROM live WHERE action <> 'delete' AND payload IS NOT NULL)",
)
def _(spark, sf_dir):
    """Leaves of documents that stay and of those that come in, each flattened once."""
    docs, live = _by_day(spark, sf_dir)
    keyed = fx.versions(spark, sf_dir).withColumn("version_key", values.version_key()).where("payload is not null")
    stay = docs.join(live, "version_key", "left_semi").select("version_key")
    keys = stay.unionByName(corpus.insert_set(live, docs).select("version_key"))
    eav = flatten_leaves(keyed.join(keys, "version_key", "left_semi"), max_depth=fx.VERSION_DEPTH)
    return eav.groupBy("path").agg(F.count(F.lit(1)).alias("leaves"), F.count_distinct("version_key").alias("docs"), F.count_distinct("value").alias("different"))


LIVE_SQL = fx.TWICE_SQL + ", " + ", ".join(
    f"""{name} AS (SELECT *, record_id || '|' || run_id || '|' || run_record_offset AS version_key FROM twice WHERE run_date <= DATE '{day}'
        QUALIFY row_number() OVER (PARTITION BY source, record_id ORDER BY run_timestamp DESC, run_id DESC, run_record_offset DESC, filename DESC) = 1)"""
    for name, day in (("old_current", OLD_DAY), ("live", NEW_DAY))
)
OF_OLD, OF_NEW = (
    f"{LIVE_SQL}, docs AS (SELECT * FROM {name} WHERE payload IS NOT NULL), eav AS ({fx.leaves_sql('docs', 'version_key')})" for name in ("old_current", "live")
)
PATHS_SQL = "SELECT path, count(*) AS leaves, count(DISTINCT version_key) AS docs, min(value) AS least, max(value) AS most FROM eav GROUP BY 1"
META_SQL = """SELECT {version} AS version, (SELECT count(*) FROM docs) AS doc_count, (SELECT count(*) FROM eav) AS eav_count, (SELECT count(DISTINCT source) FROM docs) AS source_count,
    (SELECT count(*) FROM old_current WHERE payload IS NULL) AS skipped_count"""


def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.settled(fx.versions_twice(spark, sf_dir))


def built_corpus(spark: SparkSession, sf_dir: str, *days: str) -> corpus.Corpus:
    """A corpus built as of the first day and updated to each of the others, from versions that lie in files, as a corpus reads them several times."""
    found, made = stored_versions(spark, sf_dir), corpus.Corpus(spark, files.scratch(spark))
    for k, day in enumerate(days):
        until = found.where(F.col("run_date") <= F.lit(day).cast("date"))
        made.update(until) if k else made.build(until)
    return made


def leaves_by_path(eav: DataFrame) -> DataFrame:
    return eav.groupBy("path").agg(F.count(F.lit(1)).alias("leaves"), F.count_distinct("version_key").alias("docs"), F.min("value").alias("least"), F.max("value").alias("most"))


def meta_counts(made: corpus.Corpus) -> DataFrame:
    return made.meta_row().select("version", "doc_count", "eav_count", "source_count", "skipped_count")


@query("corpus_built", PATHS_SQL, OF_OLD)
def _(spark, sf_dir):
    return leaves_by_path(built_corpus(spark, sf_dir, OLD_DAY).open()[1])


@query("corpus_built_meta", META_SQL.format(version=1), OF_OLD)
def _(spark, sf_dir):
    return meta_counts(built_corpus(spark, sf_dir, OLD_DAY))


@query("corpus_updated", PATHS_SQL, OF_NEW)
def _(spark, sf_dir):
    return leaves_by_path(built_corpus(spark, sf_dir, OLD_DAY, NEW_DAY).open()[1])


@query("corpus_updated_docs", "SELECT version_key, source, run_type, action, CAST(run_date AS VARCHAR) AS run_date FROM docs", OF_NEW)
def _(spark, sf_dir):
    docs = built_corpus(spark, sf_dir, OLD_DAY, NEW_DAY).open()[0]
    return docs.select("version_key", "source", "run_type", "action", F.col("run_date").cast("string"))


@query("corpus_updated_meta", META_SQL.format(version=2), OF_NEW)
def _(spark, sf_dir):
    return meta_counts(built_corpus(spark, sf_dir, OLD_DAY, NEW_DAY))


@query("corpus_keys_return", PATHS_SQL, OF_OLD)
def _(spark, sf_dir):
    """Keys that an update drops and a later one brings back have their leaves once."""
    return leaves_by_path(built_corpus(spark, sf_dir, OLD_DAY, NEW_DAY, OLD_DAY).open()[1])


@query("corpus_scope_report", "", OF_NEW.replace("docs AS (SELECT * FROM live WHERE", "docs AS (SELECT * FROM live WHERE source IN ('src1', 'src2') AND run_date >= DATE '2024-01-10' AND") + OVERVIEW_SQL)
def _(spark, sf_dir):
    """The report under a scope, asked for before the update and after it: the older one must not answer."""
    made = built_corpus(spark, sf_dir, OLD_DAY)
    made.field_usage_report(SCOPE)
    made.update(stored_versions(spark, sf_dir).where(F.col("run_date") <= F.lit(NEW_DAY).cast("date")))
    return made.field_usage_report(SCOPE)


@query("corpus_updated_report", "", OF_NEW + OVERVIEW_SQL)
def _(spark, sf_dir):
    """The whole corpus's report, added up from what the build and the update changed."""
    return built_corpus(spark, sf_dir, OLD_DAY, NEW_DAY).field_usage_report()


@query("corpus_returned_report", "", OF_OLD + OVERVIEW_SQL)
def _(spark, sf_dir):
    """The report after an update and one that takes it back."""
    return built_corpus(spark, sf_dir, OLD_DAY, NEW_DAY, OLD_DAY).field_usage_report()


# Run diff

DIFF_SQL = f"""{fx.VERSIONS_SQL},
    touched AS (
        SELECT record_id, action, run_record_offset AS run_offset, filename, payload FROM versions WHERE run_id = '{RUN}'
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY run_record_offset DESC, filename DESC) = 1),
    prior AS (
        SELECT record_id, run_id AS prev_run_id, run_record_offset AS prev_offset, CAST(run_date AS VARCHAR) AS prev_run_date, filename AS prev_filename, action, payload
        FROM versions WHERE record_id IN (SELECT record_id FROM touched) AND run_timestamp < (SELECT max(run_timestamp) FROM versions WHERE run_id = '{RUN}')
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY run_timestamp DESC, run_id DESC, run_record_offset DESC, filename DESC) = 1),
    new_side AS ({fx.leaves_sql("(SELECT * FROM touched WHERE action <> 'delete' AND payload IS NOT NULL)", "record_id")}),
    old_side AS ({fx.leaves_sql("(SELECT * FROM prior WHERE action <> 'delete' AND payload IS NOT NULL)", "record_id")}),
    leaves AS (
        SELECT record_id, coalesce(n.path, o.path) AS path, path_indexed,
               CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
                    WHEN n.value IS NOT DISTINCT FROM o.value AND n.value_type = o.value_type THEN 'same' ELSE 'changed' END AS change
        FROM new_side n FULL JOIN old_side o USING (record_id, path_indexed)),
    flags AS (
        SELECT record_id, bool_or(change <> 'removed') AS now, bool_or(change <> 'added') AS before, bool_or(change <> 'same') AS differs,
               list_sort(list(DISTINCT path) FILTER (change <> 'same')) AS paths FROM leaves GROUP BY 1),
    records AS (
        SELECT t.record_id, run_offset, prev_run_id, prev_run_date, prev_offset, coalesce(now, false) AS now, coalesce(before, false) AS before, paths,
               CASE WHEN t.action = 'delete' OR (coalesce(before, false) AND NOT coalesce(now, false)) THEN 'deleted'
                    WHEN coalesce(now, false) AND NOT coalesce(before, false) THEN 'added'
                    WHEN NOT coalesce(differs, false) THEN 'unchanged' ELSE 'modified' END AS status
        FROM touched t LEFT JOIN prior p USING (record_id) LEFT JOIN flags USING (record_id))"""


@query("run_prior_versions", "SELECT record_id, prev_run_id, prev_offset, prev_run_date, prev_filename FROM prior", DIFF_SQL)
def _(spark, sf_dir):
    return rundiff.prior_versions(fx.versions(spark, sf_dir), RUN)


@query(
    "run_diff_summary",
    """SELECT count(*) AS touched, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified,
              count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted, count(*) FILTER (now) AS run_version,
              count(*) FILTER (before) AS previous_version, count(*) FILTER (prev_run_id IS NULL) AS without_prior FROM records""",
    DIFF_SQL,
)
def _(spark, sf_dir):
    return rundiff.summary_row(rundiff.classified(fx.versions(spark, sf_dir), RUN, max_depth=fx.VERSION_DEPTH)[0])


@query(
    "run_diff_fields",
    """SELECT *, added_in + changed_in + removed_in AS records_affected
       FROM (SELECT path, count(DISTINCT record_id) FILTER (change = 'added') AS added_in, count(DISTINCT record_id) FILTER (change = 'changed') AS changed_in,
                    count(DISTINCT record_id) FILTER (change = 'removed') AS removed_in
             FROM leaves JOIN records USING (record_id) WHERE status = 'modified' AND change <> 'same' GROUP BY 1)""",
    DIFF_SQL,
)
def _(spark, sf_dir):
    return rundiff.field_rollup(*rundiff.classified(fx.versions(spark, sf_dir), RUN, max_depth=fx.VERSION_DEPTH))


DETAIL_SQL = """SELECT record_id, status, run_offset, prev_run_id, prev_run_date, prev_offset,
    CASE WHEN status = 'modified' THEN paths ELSE [] END AS changed_paths FROM records WHERE status <> 'unchanged'"""


@query("run_diff_detail", DETAIL_SQL, DIFF_SQL)
def _(spark, sf_dir):
    return rundiff.detail_rows(rundiff.classified(fx.versions(spark, sf_dir), RUN, max_depth=fx.VERSION_DEPTH)[0])


@query("run_diff_changed_at", f"SELECT * FROM ({DETAIL_SQL}) WHERE list_contains(changed_paths, 'orders[].count')", DIFF_SQL)
def _(spark, sf_dir):
    return rundiff.changed_at(rundiff.detail_rows(rundiff.classified(fx.versions(spark, sf_dir), RUN, max_depth=fx.VERSION_DEPTH)[0]), "orders[].count")


@query(
    "run_report",
    f"""SELECT h.run_id, h.record_count, h.index_count, h.delete_count, touched, added, modified, unchanged, deleted FROM ({RUNS_SQL}) h,
        (SELECT count(*) AS touched, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified,
                count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'deleted') AS deleted FROM records) WHERE h.run_id = '{RUN}'""",
    DIFF_SQL,
)
def _(spark, sf_dir):
    """Header and summary of the whole report; an unknown run is an error (tested)."""
    found = rundiff.diff_run(fx.versions(spark, sf_dir), RUN, max_depth=fx.VERSION_DEPTH)
    both = found.header.crossJoin(F.broadcast(found.summary))  # one row each
    return both.select("run_id", "record_count", "index_count", "delete_count", "touched", "added", "modified", "unchanged", "deleted")


@query("run_diff_examples", "SELECT status, record_id FROM records QUALIFY row_number() OVER (PARTITION BY status ORDER BY record_id) <= 10", DIFF_SQL)
def _(spark, sf_dir):
    return rundiff.example_ids(rundiff.classified(fx.versions(spark, sf_dir), RUN, max_depth=fx.VERSION_DEPTH)[0])


@query(
    "all_run_changes",
    """SELECT run_id, status, count(*) AS records FROM (
           SELECT run_id, CASE WHEN action = 'delete' OR (before IS NOT NULL AND now IS NULL) THEN 'deleted' WHEN before IS NULL AND now IS NOT NULL THEN 'added'
                               WHEN before IS NOT DISTINCT FROM now THEN 'unchanged' ELSE 'modified' END AS status FROM aged) GROUP BY ALL""",
    f"""{fx.VERSIONS_SQL},
    contents AS (
        SELECT record_id, run_id, list(path_indexed || ' ' || coalesce(value, '-') || ' ' || value_type ORDER BY path_indexed) AS content
        FROM ({fx.leaves_sql("(SELECT * FROM versions WHERE payload IS NOT NULL)", "record_id", "run_id")}) GROUP BY ALL),
    ends AS (SELECT run_id, max(run_timestamp) AS "end" FROM versions GROUP BY 1),
    history AS (SELECT v.record_id, v.run_id, v.action, v.run_timestamp, "end", content FROM versions v JOIN ends USING (run_id) LEFT JOIN contents USING (record_id, run_id)),
    aged AS (
        SELECT h.run_id, h.action, h.content AS now, o.content AS before
        FROM history h ASOF LEFT JOIN history o ON h.record_id = o.record_id AND h."end" > o.run_timestamp)""",
)
def _(spark, sf_dir):
    return rundiff.all_run_changes(fx.versions(spark, sf_dir), max_depth=fx.VERSION_DEPTH)


PAIR_SQL = f"""{fx.VERSIONS_SQL},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY run_timestamp) AS k FROM versions WHERE payload IS NOT NULL),
    a AS ({fx.leaves_sql("(SELECT * FROM ordered WHERE k = 1)", "record_id")}),
    b AS ({fx.leaves_sql("(SELECT * FROM ordered WHERE k = 2)", "record_id")})"""


@query(
    "version_leaf_diff",
    """SELECT record_id AS pair, coalesce(b.path, a.path) AS path, path_indexed,
              CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
              a.value AS old_value, a.value_type AS old_type, b.value AS new_value, b.value_type AS new_type
       FROM b FULL JOIN a USING (record_id, path_indexed)
       WHERE a.path IS NULL OR b.path IS NULL OR a.value IS DISTINCT FROM b.value OR a.value_type <> b.value_type""",
    PAIR_SQL,
)
def _(spark, sf_dir):
    """The first two versions with content of every record, compared leaf by leaf."""
    from pyspark.sql import Window

    found = fx.versions(spark, sf_dir)
    order = Window.partitionBy("record_id").orderBy("run_timestamp")
    ranked = found.where("payload is not null").select(F.struct("record_id", "run_id", "run_record_offset").alias("v"), F.row_number().over(order).alias("k"))
    pairs = ranked.where("k <= 2").groupBy(F.col("v.record_id").alias("pair")).agg(F.max(F.when(F.col("k") == 1, F.col("v"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias("b"))
    return rundiff.version_pair_diff(found, pairs, max_depth=fx.VERSION_DEPTH)


HISTORY_SQL = f"""{fx.VERSIONS_SQL},
    ordered AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY run_timestamp, run_id, run_record_offset, filename) AS k FROM versions WHERE payload IS NOT NULL),
    leaves AS ({fx.leaves_sql("ordered", "record_id", "k")}),
    a AS (SELECT record_id, k + 1 AS k, path, path_indexed, value, value_type FROM leaves WHERE k < (SELECT max(k) FROM ordered o WHERE o.record_id = leaves.record_id)),
    b AS (SELECT * FROM leaves WHERE k > 1)"""


@query(
    "version_leaf_history",
    """SELECT record_id, run_id, run_record_offset, filename, d.* EXCLUDE (record_id, k) FROM (
           SELECT record_id, k, coalesce(b.path, a.path) AS path, path_indexed,
                  CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change,
                  a.value AS old_value, a.value_type AS old_type, b.value AS new_value, b.value_type AS new_type
           FROM b FULL JOIN a USING (record_id, k, path_indexed)
           WHERE a.path IS NULL OR b.path IS NULL OR a.value IS DISTINCT FROM b.value OR a.value_type <> b.value_type) d
       JOIN ordered USING (record_id, k)""",
    HISTORY_SQL,
)
def _(spark, sf_dir):
    """Every version with content against the one before it, leaf by leaf."""
    found = fx.versions(spark, sf_dir)
    return rundiff.version_pair_diff(found, rundiff.consecutive_pairs(found), max_depth=fx.VERSION_DEPTH).select("pair.*", "*").drop("pair")
