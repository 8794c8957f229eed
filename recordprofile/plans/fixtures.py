"""Versioned records and JSON documents derived from the driver's tables, in Spark and as DuckDB SQL.

``versions``: one version for each (user, day) of events, with deletes, nested payloads,
empty containers and nulls.  ``order_docs``: one document for each order with its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordprofile.functions.values import version_key

#: How deep the payloads below are nested, as they are written here.
VERSION_DEPTH, ORDER_DEPTH = 4, 3
#: Lines of orders in one task.  A line becomes five leaves in the same stage, far more than the shuffled bytes by which Spark sizes partitions tell.
LINES_PER_TASK = 250_000


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    days = events.groupBy("user_id", F.to_date("ts").alias("run_date")).agg(
        F.max_by("event_type", "event_id").alias("last"),
        F.array_sort(F.collect_set("event_type")).alias("kinds"),
        F.count_if(F.col("event_type") == "purchase").alias("p"),
        F.bool_or(F.col("event_type") == "signup").alias("signup"),
    )
    quoted = F.transform("kinds", lambda k: F.concat(F.lit('"'), k, F.lit('"')))
    payload = F.concat(
        F.lit('{"title":"user '), F.col("user_id").cast("string"), F.lit('","kinds":['), F.array_join(quoted, ","), F.lit('],"orders":'),
        F.when(F.col("p") == 0, "[]").otherwise(F.concat(F.lit('[{"kind":"purchase","count":'), F.col("p").cast("string"), F.lit("}]"))),
        F.lit(',"profile":{"signup":'), F.col("signup").cast("string"), F.lit(',"note":null,"extra":'),
        F.when(F.col("p") > 1, "{}").otherwise("[null,{}]"), F.lit("}}"),
    )
    source = F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string"))
    run_id = F.concat(F.col("run_date").cast("string"), F.lit("-"), F.col("source"))
    rn = F.row_number().over(Window.partitionBy("run_id").orderBy("user_id")) - 1
    deleted = F.col("last") == "error"
    return (
        days.withColumn("source", source)
        .withColumn("run_id", run_id)
        .withColumn("rn", rn)
        .select(
            F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("record_id"), "source", "run_date",
            F.when(F.col("run_date") == F.lit("2024-01-01").cast("date"), "full").otherwise("daily").alias("run_type"),
            F.when(deleted, "delete").otherwise("index").alias("action"), "run_id", (F.col("rn") % 10).cast("long").alias("run_record_offset"),
            F.col("run_date").cast("timestamp").alias("run_timestamp"),
            F.concat("run_id", F.lit("/part-"), F.floor(F.col("rn") / 10).cast("string"), F.lit(".parquet")).alias("filename"),
            F.when(~deleted, payload).alias("payload"),
        )
    )


def versions_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``versions`` where every fifth user's rows stand once more, under another title, in a file that counts as older.

    Both rows have one version key: offsets start again in each file.
    """
    found = versions(spark, sf_dir)
    fifth = F.expr("cast(substring(record_id, 3) as long) % 5 = 0")
    again = found.where(fifth).withColumns({"filename": F.concat("run_id", F.lit("/a.parquet")), "payload": F.replace("payload", F.lit(":\"user"), F.lit(":\"once user"))})
    return found.unionByName(again)


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version_key, record_id, source, run_id, run_record_offset, payload) of every order that has lines, in tasks of a bounded number of lines."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("qty"), "l_returnflag")
    tasks = max(1, -(-items.count() // LINES_PER_TASK))
    orders, items = orders.repartition(tasks, "o_orderkey"), items.repartition(tasks, "l_orderkey")
    lines = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "qty", "l_returnflag"))).alias("lines"))
    shown = F.transform(
        "lines",
        lambda x: F.concat(
            F.lit('{"l_linenumber":'), x["l_linenumber"].cast("string"), F.lit(',"l_partkey":'), x["l_partkey"].cast("string"),
            F.lit(',"qty":'), x["qty"].cast("string"), F.lit(',"l_returnflag":"'), x["l_returnflag"], F.lit('"}'),
        ),
    )
    payload = F.concat(
        F.lit('{"o_orderstatus":"'), F.col("o_orderstatus"), F.lit('","o_orderpriority":"'), F.col("o_orderpriority"), F.lit('","cust":{"o_custkey":'),
        F.col("o_custkey").cast("string"), F.lit(',"total_cents":'), F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long").cast("string"), F.lit('},"lines":['),
        F.array_join(shown, ","), F.lit("]}"),
    )
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("record_id"), F.col("o_orderpriority").alias("source"),
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.lit(0).cast("long").alias("run_record_offset"), payload.alias("payload"),
    ).withColumn("version_key", version_key())


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_docs`` whose payload is one element of an array, so that lines are arrays within arrays."""
    return order_docs(spark, sf_dir).withColumn("payload", F.concat(F.lit('{"s":['), "payload", F.lit("]}")))


def deep_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version_key, payload) of every nation: its key, 8 levels deep for each number up to its own and one more, so 200 at most."""
    nations, levels = spark.read.parquet(f"{sf_dir}/nation.parquet"), ((F.col("n_nationkey") + 1) * 4).cast("int")
    payload = F.concat(F.repeat(F.lit('{"d":['), levels), F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('",{}'), F.repeat(F.lit("]}"), levels))
    return nations.select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("version_key"), payload.alias("payload"))


def broken_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``versions`` where every third user's payloads are cut, every fifth's nest without end and every seventh's are no objects."""
    user = F.expr("cast(substring(record_id, 3) as long)")
    broken = (
        F.when(user % 3 == 0, F.expr("substring(payload, 1, char_length(payload) - 3)")).when(user % 5 == 0, F.concat(F.repeat(F.lit("{"), 400), "payload"))
        .when(user % 7 == 0, F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.col("payload"))
    )
    return versions(spark, sf_dir).withColumn("payload", broken)


# The same as DuckDB common table expressions.

VERSIONS_SQL = """
    days AS (
        SELECT user_id, CAST(ts AS DATE) AS run_date, arg_max(event_type, event_id) AS last,
               list_sort(list(DISTINCT event_type)) AS kinds, count(*) FILTER (event_type = 'purchase') AS p,
               bool_or(event_type = 'signup') AS signup
        FROM events GROUP BY 1, 2),
    numbered AS (
        SELECT *, 'src' || (user_id % 4) AS source, run_date || '-' || ('src' || (user_id % 4)) AS run_id,
               row_number() OVER (PARTITION BY run_date, user_id % 4 ORDER BY user_id) - 1 AS rn
        FROM days),
    versions AS (
        SELECT 'u:' || user_id AS record_id, source, run_date,
               CASE WHEN run_date = DATE '2024-01-01' THEN 'full' ELSE 'daily' END AS run_type,
               CASE WHEN last = 'error' THEN 'delete' ELSE 'index' END AS action, run_id, rn % 10 AS run_record_offset,
               CAST(run_date AS TIMESTAMP) AS run_timestamp, run_id || '/part-' || (rn // 10) || '.parquet' AS filename,
               CASE WHEN last <> 'error' THEN
                   '{"title":"user ' || user_id || '","kinds":[' || array_to_string(list_transform(kinds, lambda k: '"' || k || '"'), ',') || '],"orders":'
                   || CASE WHEN p = 0 THEN '[]' ELSE '[{"kind":"purchase","count":' || p || '}]' END
                   || ',"profile":{"signup":' || CASE WHEN signup THEN 'true' ELSE 'false' END || ',"note":null,"extra":'
                   || CASE WHEN p > 1 THEN '{}' ELSE '[null,{}]' END || '}}' END AS payload
        FROM numbered),
    current AS (
        SELECT * FROM versions
        QUALIFY row_number() OVER (PARTITION BY source, record_id ORDER BY run_timestamp DESC NULLS LAST, run_id DESC, run_record_offset DESC,
                                   filename DESC NULLS LAST) = 1)"""

TWICE_SQL = f"""{VERSIONS_SQL},
    twice AS (
        SELECT * FROM versions
        UNION ALL SELECT * REPLACE (run_id || '/a.parquet' AS filename, replace(payload, ':"user', ':"once user') AS payload) FROM versions
                  WHERE CAST(substr(record_id, 3) AS BIGINT) % 5 = 0)"""

_LEAVES = """SELECT {keys}, regexp_replace(pi, '\\[[0-9]+\\]', '[]', 'g') AS path, pi AS path_indexed,
               CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE atom->>'$' END AS value,
               CASE type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string'
                         WHEN 'OBJECT' THEN 'object-empty' WHEN 'ARRAY' THEN 'array-empty' ELSE 'number' END AS value_type
        FROM (SELECT {from_keys}, substr(t.fullkey, 3) AS pi, t.type, t.atom, t.value FROM {table} d, json_tree(d.payload) t)
        WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('{{}}', '[]')"""


def leaves_sql(table: str, *keys: str) -> str:
    return _LEAVES.format(keys=", ".join(keys), from_keys=", ".join(f"d.{k}" for k in keys), table=table)


DOCS_SQL = f"""{VERSIONS_SQL},
    payloads AS (SELECT record_id || '|' || run_id || '|' || run_record_offset AS version_key, * FROM current WHERE payload IS NOT NULL),
    docs AS (SELECT version_key, record_id, source, run_id, run_record_offset, run_timestamp, run_date, run_type, action FROM payloads),
    eav AS ({leaves_sql("payloads", "version_key")})"""

ORDERS_SQL = f"""
    items AS (
        SELECT l_orderkey, list_sort(list({{'a': l_linenumber, 'b': l_partkey, 'c': CAST(trunc(l_quantity) AS INT), 'd': l_returnflag}})) AS lines
        FROM lineitem GROUP BY 1),
    payloads AS (
        SELECT 'o:' || o_orderkey AS record_id, o_orderpriority AS source, strftime(o_orderdate, '%Y-%m') AS run_id, 0 AS run_record_offset,
               'o:' || o_orderkey || '|' || strftime(o_orderdate, '%Y-%m') || '|0' AS version_key,
               '{{"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"' || o_orderpriority || '","cust":{{"o_custkey":' || o_custkey
               || ',"total_cents":' || CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) || '}},"lines":['
               || array_to_string(list_transform(lines, lambda x: '{{"l_linenumber":' || x.a || ',"l_partkey":' || x.b || ',"qty":' || x.c
                  || ',"l_returnflag":"' || x.d || '"}}'), ',') || ']}}' AS payload
        FROM orders JOIN items ON o_orderkey = l_orderkey),
    docs AS (SELECT version_key, record_id, source, run_id, run_record_offset FROM payloads),
    eav AS ({leaves_sql("payloads", "version_key")})"""

NESTED_SQL = f"""{ORDERS_SQL},
    nested AS (SELECT * REPLACE ('{{"s":[' || payload || ']}}' AS payload) FROM payloads),
    nested_eav AS ({leaves_sql("nested", "version_key")})"""

DEEP_SQL = """
    deep AS (
        SELECT 'n:' || n_nationkey AS version_key,
               repeat('{"d":[', 4 * (n_nationkey + 1)) || n_nationkey || ',"' || n_name || '",{}' || repeat(']}', 4 * (n_nationkey + 1)) AS payload
        FROM nation)"""

BROKEN_SQL = f"""{VERSIONS_SQL},
    sound AS (
        SELECT * FROM versions
        WHERE payload IS NOT NULL AND CAST(substr(record_id, 3) AS BIGINT) % 3 <> 0 AND CAST(substr(record_id, 3) AS BIGINT) % 5 <> 0
          AND CAST(substr(record_id, 3) AS BIGINT) % 7 <> 0)"""
