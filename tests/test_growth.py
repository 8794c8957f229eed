"""That leaves are made once, whoever reads them, and that tasks are bounded."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from recordprofile.operators import profile
from recordprofile.plans import fixtures as fx, queries

SF = "/root/testdata/sf0.001"
LEAVES = [
    (k, p.replace("#", ""), p.replace("#", str(i)), v, "string")
    for k in ("a|r|0", "b|r|0", "c|r|0")
    for i in range(3)
    for p, v in (("lines[#].x", f"{k}{i}"), ("lines[#].flag", "N" if i else "R"), ("lines[#].t[0]", "v"), ("lines[#].t[1]", None))
]


@pytest.fixture
def corpus(spark):
    """(docs, eav, how many leaves were made so far)"""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    eav = spark.createDataFrame(LEAVES, "version_key string, path string, path_indexed string, value string, value_type string")
    eav = eav.withColumn("path", F.regexp_replace("path", r"\[\d\]", "[]"))
    docs = spark.createDataFrame([(f"{c}|r|0", c, "s", "r", 0) for c in "abc"], "version_key string, record_id string, source string, run_id string, run_record_offset int")
    return docs, eav.mapInArrow(count, eav.schema), made


HIT = {"value_path": "lines[].flag", "value": "N"}


def test_object_rows_make_leaves_once(corpus):
    docs, eav, made = corpus
    found = profile.object_rows(docs, eav, "lines[]", ["lines[].x", "lines[].t[]"], by="c0", descending=True, start=1, length=3, term="v", **HIT)
    rows = [tuple(r)[-3:] for r in found.rows.collect()]
    assert (found.total, found.filtered) == (6, 6)
    assert rows == [("lines[1]", "c|r|01", "[v]"), ("lines[2]", "b|r|02", "[v]"), ("lines[1]", "b|r|01", "[v]")]
    assert made.value == len(LEAVES)


def test_object_table_makes_leaves_once(corpus):
    docs, eav, made = corpus
    rows = profile.object_table(docs, eav, "lines[]", ["lines[].x", "lines[].t[]"], **HIT).select("element", "c0", "c1").collect()
    assert sorted(map(tuple, rows)) == sorted((f"lines[{i}]", f"{k}|r|0{i}", "[v]") for k in "abc" for i in (1, 2))
    assert made.value == len(LEAVES)


def test_object_columns_make_leaves_once(corpus):
    _, eav, made = corpus
    assert [r[0] for r in profile.object_columns(eav, "lines[]", **HIT).collect()] == ["lines[].flag", "lines[].t[]", "lines[].x"]
    assert made.value == len(LEAVES)


def test_object_member_stats_make_leaves_once(corpus):
    _, eav, made = corpus
    rows = profile.object_member_stats(eav, "lines[]").select("path", "present", "count_max").collect()
    assert [tuple(r) for r in rows] == [("lines[].flag", 9, 1), ("lines[].t[]", 9, 2), ("lines[].x", 9, 1)]
    assert made.value == len(LEAVES)


def test_values_held_outside_the_objects(corpus):
    docs, eav, _ = corpus
    # No instance at this prefix has a leaf of that path, so none is left.
    assert profile.object_rows(docs, eav, "lines[].t[]", ["lines[].t[]"], **HIT).total == 0
    assert profile.object_table(docs, eav, "lines[].t[]", ["lines[].t[]"], **HIT).count() == 0


def test_schema_overview_makes_leaves_once(corpus):
    docs, eav, made = corpus
    assert [tuple(r) for r in profile.schema_overview(docs, eav).select("field", "doc_count", "count_max", "distinct_values").collect()] == [("lines", 3, 3, 9)]
    assert made.value == len(LEAVES)


def test_extremes_sort_no_leaves(spark, corpus):
    eav = spark.createDataFrame(LEAVES + [("d", "é", "é", None, "null"), ("d", "z", "z", "é", "string"), ("d", "z", "z", "\U0001f600", "string"), ("d", "z", "z", "￮", "string")], corpus[1].schema)
    found = profile.path_extremes(eav)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        found.explain()
    assert "Sort" not in plan.getvalue().split("MapInArrow")[1]
    plain = eav.groupBy("path", "value_type").agg(F.count(F.lit(1)).alias("leaves"), F.min("value").alias("least"), F.max("value").alias("most"))
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_order_tasks_are_bounded(spark, monkeypatch):
    whole = fx.order_docs(spark, SF)
    monkeypatch.setattr(fx, "LINES_PER_TASK", 1000)
    dealt = fx.order_docs(spark, SF)
    assert dealt.rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 1000) > 1
    assert sorted(dealt.collect()) == sorted(whole.collect())


def test_corpus_versions_are_made_once(spark, monkeypatch):
    whole, made = fx.versions_twice(spark, SF), spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(fx, "versions_twice", lambda *_: whole.mapInArrow(count, whole.schema))
    assert queries.built_corpus(spark, SF, queries.OLD_DAY, queries.NEW_DAY).meta()["version"] == 2
    assert made.value == whole.count()
