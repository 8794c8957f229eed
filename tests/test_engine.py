"""Scenarios over small version tables: current records, corpus, scopes, history, run diff, SQL, export."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from recordprofile.functions import paths, values
from recordprofile.operators import filters, history, profile, rundiff, sql
from recordprofile.operators.scope import EMPTY, Scope, scoped, scoped_total
from recordprofile.sources import export, versions as vs
from recordprofile.sources.corpus import Corpus
from recordprofile.streaming.incremental import follow_versions

SCHEMA = "record_id string, source string, run_id string, run_record_offset long, run_timestamp timestamp, run_date date, run_type string, action string, filename string, payload string"


def version(record_id, run_id="run1", offset=0, *, source="alma", day=1, action="index", filename="f1", payload=..., title=None):
    when = dt.datetime(2026, 6, day)
    if payload is ...:
        payload = None if action == "delete" else json.dumps({"title": title or f"{record_id} title", "id": record_id})
    return (record_id, source, run_id, offset, when, when.date(), "daily", action, filename, payload)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "corpus")


def keys(docs):
    return {r["version_key"] for r in docs.collect()}


def test_current_records(spark):
    rows = table(
        spark, version("a", "r1", day=1), version("a", "r2", day=2, action="delete"), version("a", "r2", day=2, source="other"),
        version("b", "r1", 3, day=1), version("b", "r1", 5, day=1), version("c", "r1", 1, filename="f1"), version("c", "r1", 1, filename="f2"),
    )
    got = {(r["source"], r["record_id"]): (r["run_id"], r["run_record_offset"], r["action"], r["filename"]) for r in vs.current_records(rows).collect()}
    assert got == {("alma", "a"): ("r2", 0, "delete", "f1"), ("other", "a"): ("r2", 0, "index", "f1"), ("alma", "b"): ("r1", 5, "index", "f1"), ("alma", "c"): ("r1", 1, "index", "f2")}
    assert vs.current_key(rows, "b").collect()[0].asDict() == {"record_id": "b", "run_id": "r1", "run_record_offset": 5}
    assert [r["run_record_offset"] for r in vs.record_history(rows, "b").collect()] == [5, 3]
    assert vs.record_version(rows, "b", "r1", 3).count() == 1 and vs.record_version(rows, "b").first()["run_record_offset"] == 5
    assert vs.sample_parsed(rows, 2, source="alma", run_id=["r1"]).count() == 2
    assert vs.of_runs(rows, ["r2"]).count() == 2


def test_read_versions_prunes_payloads(spark, tmp_path):
    path = str(tmp_path / "versions")
    table(spark, version("a")).drop("filename").write.parquet(path)
    found = vs.read_versions(spark, path)
    assert found.first()["filename"].endswith(".parquet")
    plan = vs.metadata_only(found).select("record_id")._jdf.queryExecution().executedPlan().toString()
    assert "record_id:string" in plan.split("ReadSchema:")[1] and "payload" not in plan.split("ReadSchema:")[1]


def test_update_reconciles(spark, root):
    corpus = Corpus(spark, root)
    first = corpus.build(table(spark, version("A"), version("B", offset=1), version("C", offset=2), version("Z", offset=3, payload=None)), location="here")
    assert (first.doc_count, first.eav_count, first.skipped_count, first.source_count) == (3, 6, 1, 1)
    changed = [version("A"), version("B", offset=1), version("C", offset=2), version("B", "run2", 0, day=2, title="B v2"), version("D", "run2", 1, day=2), version("E", "run2", 2, day=2, action="delete")]
    found = corpus.update(table(spark, *[v for v in changed if v[0] != "C"]))
    docs, eav = corpus.open()
    assert keys(docs) == {"A|run1|0", "B|run2|0", "D|run2|1"} == keys(eav.select("version_key").distinct())
    assert eav.where("version_key = 'B|run2|0' and path = 'title'").first()["value"] == "B v2"
    assert (found.doc_count, found.eav_count, found.version, found.skipped_count, found.created_at) == (3, 6, 2, 1, first.created_at)
    again = corpus.update(table(spark, *[v for v in changed if v[0] != "C"]))
    assert (again.version, again.doc_count, again.eav_count) == (3, 3, 6) and keys(corpus.open()[0]) == keys(docs)
    # A key that left and comes back has its leaves once.
    gone = corpus.update(table(spark, *[v for v in changed if v[0] in "AB"]))
    assert gone.doc_count == 2
    back = corpus.update(table(spark, *[v for v in changed if v[0] != "C"]))
    assert (back.doc_count, back.eav_count) == (3, 6)
    small = corpus.compact()
    assert len(small.parts) == 1 and corpus.open()[1].count() == 6


def test_update_reads_the_rows_that_become_documents(spark, root, tmp_path):
    corpus = Corpus(spark, root)
    first = [version("A"), version("B", offset=1)]
    corpus.build(table(spark, *first))
    twice = [version("A", "run2", day=2, filename="a", title="old"), version("A", "run2", day=2, filename="b", title="new"), version("B", "run2", day=2, filename="a", title="other B")]
    found = corpus.update(table(spark, *first, *twice))
    docs, eav = corpus.open()
    assert sorted((r["version_key"], r["value"]) for r in eav.where("path = 'title'").collect()) == [("A|run2|0", "new"), ("B|run2|0", "other B")]
    assert (found.doc_count, found.eav_count, eav.count(), docs.count()) == (2, 4, 4, 2)
    # A path is listed anew; what no snapshot uses can go.
    path = str(tmp_path / "landing")
    columns = [c for c in SCHEMA.replace(",", "").split()[::2] if c != "filename"]
    table(spark, *first).select(columns).write.parquet(path)
    other = Corpus(spark, f"{root}-files")
    other.build(vs.read_versions(spark, path, table(spark).select(columns).schema))
    table(spark, version("C", offset=2)).select(columns).write.mode("append").parquet(path)
    assert other.update(vs.read_versions(spark, path, table(spark).select(columns).schema)).doc_count == 3
    other.compact()
    other.vacuum()
    import os

    assert os.listdir(f"{root}-files/docs") == [other.manifest().snapshot] and other.manifest().version == 3 and other.open()[1].count() == 6


def test_all_runs_agree_with_one_run(spark):
    rows = diff_table(spark).unionByName(
        table(spark, version("R9", "old1", 9, day=1, payload='{"a": 1, "b": 2}'), version("R9", "X", 9, day=3, payload='{"b": 2, "a": 1}'), version("R9", "X", 10, day=3, payload='{"b": 2, "a": 1.0}'))
    )
    everything = {(r["run_id"], r["status"]): r["records"] for r in rundiff.all_run_changes(rows).collect()}
    for run in ("old1", "old2", "X", "later"):
        one = rundiff.diff_run(rows, run).summary.first()
        assert {s: n for s in rundiff.STATUSES if (n := one[s])} == {s: everything[run, s] for s in rundiff.STATUSES if (run, s) in everything}


def test_scope_and_reports(spark, root):
    corpus = Corpus(spark, root)
    rows = [version("A", source="dspace"), version("B", offset=1), version("C", offset=2, source="dspace"), version("D", offset=3)]
    corpus.build(table(spark, *rows))
    inside = Scope({"source": ["dspace"], "nonsense": ["x"]})
    whole = {r["field"]: r["doc_count"] for r in corpus.field_usage_report().collect()}
    part = {r["field"]: r["doc_count"] for r in corpus.field_usage_report(inside).collect()}
    assert whole["title"] == 4 and part["title"] == 2
    docs, eav = corpus.open()
    assert {r["value"] for r in profile.path_values(scoped(docs, eav, inside)[1], "title").rows.collect()} == {"A title", "C title"}
    assert scoped_total(docs, inside) == 2 and scoped_total(docs) == 4
    assert inside.key() == Scope({"source": ("dspace",)}).key() != "" and EMPTY.key() == "" == Scope({"nonsense": ["x"]}).key()
    reports = f"{root}/reports"
    import os

    assert sorted(os.listdir(reports)) == ["1"] and len(os.listdir(f"{reports}/1")) == 2
    corpus.update(table(spark, *rows))
    assert len(os.listdir(f"{reports}/2")) == 1
    assert corpus.meta()["doc_count"] == 4 and corpus.meta_row().count() == 1 and not corpus.is_large()


def test_failed_build_publishes_nothing(spark, root):
    corpus = Corpus(spark, root)
    rows = [version(f"r{i}", offset=i, payload="{not valid json" if i == 30 else ...) for i in range(60)]
    assert corpus.meta() == {}
    with pytest.raises(Exception, match="MALFORMED"):
        corpus.build(table(spark, *rows))
    assert not corpus.exists()
    good = corpus.build(table(spark, *[r for i, r in enumerate(rows) if i != 30]))
    with pytest.raises(Exception, match="MALFORMED"):
        corpus.update(table(spark, *rows))
    assert corpus.manifest() == good and corpus.open()[0].count() == 59


def test_corpus_excludes_fields_and_follows_files(spark, root, tmp_path):
    path = str(tmp_path / "landing")
    columns = [c for c in SCHEMA.replace(",", "").split()[::2] if c != "filename"]
    table(spark, version("A"), version("B", offset=1)).select(columns).write.parquet(path)
    schema = spark.read.parquet(path).schema
    follow = lambda: follow_versions(spark, path, root, checkpoint=str(tmp_path / "cp"), schema=schema).awaitTermination()
    follow()
    assert Corpus(spark, root).meta()["doc_count"] == 2
    table(spark, version("A", "run2", day=2, title="new"), version("C", "run2", 1, day=2)).select(columns).write.mode("append").parquet(path)
    follow()
    docs, eav = Corpus(spark, root).open()
    assert docs.count() == 3 and eav.where("value = 'new'").count() == 1
    other = Corpus(spark, root + "2")
    other.build(table(spark, version("A")), excluded_fields=("title",))
    assert {r["path"] for r in other.open()[1].collect()} == {"id"}


def diff_table(spark):
    p = lambda **k: json.dumps(k)
    return table(
        spark,
        version("R1", "old1", 1, day=1, payload=p(title="a", same=1)), version("R2", "old1", 2, day=1, payload=p(title="b", note="n")),
        version("R2", "old2", 2, day=2, payload=p(title="b2", note="n")), version("R4", "old1", 4, day=1, payload=p(title="d")),
        version("R5", "old1", 5, day=1, payload=p(title="e")), version("R6", "old2", 6, day=2, payload=p(title="f")), version("R8", "old2", 8, day=2, action="delete"),
        version("R1", "X", 1, day=3, payload=p(title="A", same=1)), version("R2", "X", 2, day=3, payload=p(title="b2")), version("R3", "X", 3, day=3, payload=p(title="c")),
        version("R4", "X", 4, day=3, action="delete"), version("R5", "X", 5, day=3, payload=p(title="e")), version("R6", "X", 6, day=3, payload=p(title="f", extra=[1, 2])),
        version("R7", "X", 7, day=3, payload=None), version("R8", "X", 8, day=3, payload=p(title="h")), version("R1", "later", 1, day=4, payload=p(title="z")),
    )


def test_run_diff(spark):
    found = rundiff.diff_run(diff_table(spark), "X", examples=1)
    assert found.header.first()["record_count"] == 8 and found.header.first()["delete_count"] == 1
    s = found.summary.first()
    assert (s["touched"], s["added"], s["modified"], s["unchanged"], s["deleted"], s["without_prior"]) == (8, 2, 3, 2, 1, 2)
    assert (s["run_version"], s["previous_version"]) == (6, 5)
    fields = {r["path"]: (r["added_in"], r["changed_in"], r["removed_in"], r["records_affected"]) for r in found.fields.collect()}
    assert fields == {"title": (0, 1, 0, 1), "note": (0, 0, 1, 1), "extra[]": (1, 0, 0, 1)}
    detail = {r["record_id"]: (r["status"], r["prev_run_id"], r["changed_paths"]) for r in found.detail.collect()}
    assert detail["R2"] == ("modified", "old2", ["note"]) and detail["R8"] == ("added", "old2", []) and detail["R4"] == ("deleted", "old1", []) and "R5" not in detail
    assert {r["record_id"] for r in found.examples.collect()} == {"R3", "R1", "R5", "R4"}
    assert [r["record_id"] for r in rundiff.changed_at(found.detail, "extra[]").collect()] == ["R6"]
    with pytest.raises(ValueError):
        rundiff.diff_run(diff_table(spark), "nope")


def test_prior_files_with_equal_offsets(spark):
    rows = table(
        spark, version("R7", "old1", 10, day=1, filename="a", title="seven"), version("R8", "old1", 10, day=1, filename="b", title="eight"),
        version("R7", "X", 1, day=2, title="7"), version("R8", "X", 2, day=2, title="8"),
    )
    records, leaves = rundiff.classified(rows, "X")
    assert {r["status"] for r in records.collect()} == {"modified"}
    assert {(r["record_id"], r["old_value"]) for r in leaves.where("change = 'changed'").collect()} == {("R7", "seven"), ("R8", "eight")}


def test_version_pairs(spark):
    rows = diff_table(spark)
    pairs = spark.createDataFrame([("p", ("R2", "old1", 2), ("R2", "X", 2))], "pair string, a struct<record_id:string,run_id:string,run_record_offset:long>, b struct<record_id:string,run_id:string,run_record_offset:long>")
    got = {(r["path_indexed"], r["change"], r["old_value"], r["new_value"]) for r in rundiff.version_pair_diff(rows, pairs).collect()}
    assert got == {("title", "changed", "b", "b2"), ("note", "removed", "n", None)}


def test_consecutive_pairs_cover_whole_histories(spark):
    rows = table(
        spark, *[version("R1", f"run{d}", 1, day=d, title=f"t{d}") for d in (1, 2, 3, 4)],
        version("R2", "run1", 5, day=1, filename="a", title="x"), version("R2", "run1", 5, day=1, filename="b", title="y"), version("R3", "run1", 7, day=1, title="lone"),
    )
    found = rundiff.version_pair_diff(rows, rundiff.consecutive_pairs(rows)).collect()
    got = sorted((r["pair"]["record_id"], r["pair"]["run_id"], r["path_indexed"], r["old_value"], r["new_value"]) for r in found)
    assert got == [("R1", "run2", "title", "t1", "t2"), ("R1", "run3", "title", "t2", "t3"), ("R1", "run4", "title", "t3", "t4"), ("R2", "run1", "title", "x", "y")]


def test_history(spark):
    rows = diff_table(spark)
    s = history.source_overview(rows).first()
    assert (s["record_count"], s["version_count"], s["run_count"], s["first_run_date"], s["last_run_date"]) == (7, 16, 4, "2026-06-01", "2026-06-04")
    assert [r["run_id"] for r in history.recent_runs(rows, limit=2).collect()] == ["later", "X"]
    assert history.run_page(rows, term="OLD", by="record_count").filtered == 2 and history.run_page(rows).total == 4
    assert history.one_source(rows, "alma")[1].count() == 4
    with pytest.raises(ValueError):
        history.one_source(rows, "none")
    assert history.run_header(rows, "none").isEmpty()


def test_metadata_rebuild_guard(spark, root):
    full, empty = lambda: table(spark, version("A")), lambda: table(spark)
    done = vs.rebuild_metadata(spark, {"records": full, "embeddings": empty, "other": lambda: None}, root)
    assert {k: (v["status"], v["rows"]) for k, v in done.items()} == {"records": ("built", 1), "embeddings": ("built", 0), "other": ("skipped", 0)}
    for lost in (empty, lambda: None):
        with pytest.raises(vs.RegressionError, match="records"):
            vs.rebuild_metadata(spark, {"records": lost, "embeddings": lambda: None}, root)
    seen = []
    vs.rebuild_metadata(spark, {"records": full}, root, lambda name, d: seen.append((name, d["rows"])))
    assert seen == [("records", 1)]


def test_filters_and_pages(spark):
    rows = diff_table(spark)
    assert rows.where(filters.version_filter({"run_id": ["X"], "bad": [1]}, term="r1")).count() == 1
    assert rows.where(filters.search("R_")).count() == 16 and rows.where(filters.search("\\")).count() == 0 and rows.where(filters.search("")).count() == 16
    assert rows.where(filters.on_day("run_timestamp", "2026-06-04")).count() == 1
    found = filters.browse_versions(rows, by="run_id", descending=False, start=2, length=3, cap=4, values={"source": ["alma"]})
    assert (found.total, found.filtered) == (16, 4) and found.rows.count() == 2
    assert found.rows.first()["run_timestamp"].startswith("2026-06-0")
    with pytest.raises(ValueError):
        filters.browse_versions(rows, by="payload")


def test_read_only_sql(spark, root):
    corpus, other = Corpus(spark, root), f"{root}-other"
    spark.range(3).write.parquet(other)
    corpus.build(table(spark, *[version(f"r{i}", offset=i) for i in range(30)]))
    docs, eav = corpus.open()
    ask = lambda q, **k: sql.run_sql(q, docs, eav, corpus.meta_row(), **k)
    assert ask("SELECT count(*) n FROM eav").rows == [(60,)] and ask("SELECT doc_count FROM corpus_meta;").rows == [(30,)]
    cut = ask("WITH d AS (SELECT * FROM docs) SELECT version_key FROM d ORDER BY 1", limit=10)
    assert len(cut.rows) == 10 and cut.truncated and not cut.error
    assert ask("SELECT '{x}' AS braces").rows == [("{x}",)]
    assert ask("SELECT count(*) FROM docs", scope=Scope(where="run_record_offset < 5")).rows == [(5,)]
    for bad in ("DROP TABLE docs", "SET x = 1", "SELECT nothing FROM docs", "SELECT reflect('java.lang.System', 'exit')", "SHOW TABLES", f"SELECT * FROM parquet.`{other}`"):
        assert ask(bad).error
    # Text is text; what the session holds besides, also in memory, behind names that the query defines elsewhere, is out of reach.
    assert ask("SELECT count(*) FROM eav WHERE value LIKE '%reflect%' OR value = 'java_method('").rows == [(0,)]
    assert ask("WITH t AS (SELECT explode(sequence(1, 3)) AS x) SELECT sum(x) FROM t JOIN (VALUES (1), (2)) AS v (y) ON x = y").rows == [(3,)]
    assert ask("SELECT (SELECT max(doc_count) FROM corpus_meta) + count(*) FROM docs WHERE version_key IN (SELECT version_key FROM eav)").rows == [(60,)]
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("other_view")
    spark.range(3).createOrReplaceTempView("other_range")
    path = f"{root}/docs/{corpus.manifest().snapshot}"
    for bad in (
        "SELECT * FROM other_view", "SELECT * FROM other_range", "SELECT count(*) FROM docs WHERE 1 IN (SELECT x FROM other_view)", f"SELECT * FROM parquet.`{path}`",
        "SELECT * FROM other_view WHERE 1 IN (WITH other_view AS (SELECT 1 AS x) SELECT x FROM other_view)", "SELECT try_reflect('java.lang.System', 'exit')",
        "SELECT * FROM docs WHERE version_key = (SELECT java_method('java.util.UUID', 'randomUUID'))", "SELECT * FROM docs LEFT JOIN LATERAL (SELECT * FROM other_view)",
    ):
        assert ask(bad, scope=Scope(where="run_record_offset < 5")).error
    assert not any(t.name.startswith(("docs_", "eav_")) for t in spark.catalog.listTables())


def test_values(spark):
    df = spark.createDataFrame([("gis", bytearray(b'{"title": "x", "n": 1, "e": ""}'), "2026-06-01T10:00"), ("z", bytearray(b"\xff{"), "none"), (None, None, None)], "source string, p binary, d string")
    got = df.select(
        values.raw_format("source", {"gis": "json"}).alias("f"), values.decoded("p").alias("t"), *[values.headline(values.decoded("p"), c).alias(c) for c in ("title", "n", "e")],
        values.run_day("d").alias("day"),
    ).collect()
    assert [r["f"] for r in got] == ["json", "xml", "xml"]
    assert [(r["title"], r["n"], r["e"]) for r in got] == [("x", None, None), (None, None, None), (None, None, None)]
    assert got[1]["t"] == "�{" and got[2]["t"] is None and got[0]["day"] == dt.date(2026, 6, 1) and got[1]["day"] is None
    t = spark.sql("select timestamp '2026-06-11T19:01:47Z' t").select(values.naive_utc("t").alias("t")).first()["t"]
    assert t == dt.datetime(2026, 6, 11, 19, 1, 47)


def test_objects(spark):
    from recordprofile.operators.flatten import flatten_leaves

    payloads = [
        {"s": [{"v": ["b", "a"], "k": 1}, {"k": 2, "v": None}], "t": [{"only": 1}]}, {"s": [{"k": 1, "v": ["b", "a", "a"]}] * 11}, {"s": []}, {"s": "plain"},
    ]
    docs = spark.createDataFrame([(f"k{i}", f"r{i}", "x", "run", i, json.dumps(p)) for i, p in enumerate(payloads)], "version_key string, record_id string, source string, run_id string, run_record_offset long, payload string")
    eav = flatten_leaves(docs)
    assert [r["path"] for r in profile.object_field_paths(eav).orderBy("path").collect()] == ["s[].k", "s[].v"]
    assert [r["path"] for r in profile.object_columns(eav, "s[]").collect()] == ["s[].k", "s[].v", "s[].v[]"]
    assert [r["path"] for r in profile.object_columns(eav, "s[]", value_path="s[].k", value="2").collect()] == ["s[].k", "s[].v"]
    page = profile.object_rows(docs, eav, "s[]", ["s[].k", "s[].v[]", "s[].v"], length=20)
    rows = page.rows.collect()
    assert page.total == 13 and [(r["c0"], r["c1"], r["c2"]) for r in rows[:3]] == [("1", "[b, a]", None), ("2", None, None), ("1", "[b, a, a]", None)]
    assert [r["element"] for r in rows[2:]] == [f"s[{i}]" for i in range(11)]
    hit = profile.object_rows(docs, eav, "s[]", ["s[].k"], term="2", by="c0", descending=True)
    assert hit.filtered == 1 and hit.rows.first()["c0"] == "2"
    assert profile.object_rows(docs, eav, "s[]", ["s[].k"], by="c99", length=1).rows.first()["record_id"] == "r0"
    assert profile.distinct_object_count(eav, "s[]").first()[0] == 2
    shape = {r["record_id"]: (r["objects"], r["total_values"], r["max_per_object"]) for r in profile.object_record_shape(docs, eav, "s[]").collect()}
    assert shape == {"r0": (2, 4, 3), "r1": (11, 44, 4)}
    stats = {r["path"]: (r["present"], r["presence_pct"], r["type"], r["count_avg"], r["label"]) for r in profile.object_member_stats(eav, "s[]").collect()}
    deep = flatten_leaves(spark.createDataFrame([("a", '{"s": [{"v": [{"k": 1, "w": [1, 2]}], "e": [{}]}]}')], "version_key string, payload string"))
    assert {r["label"]: (r["is_array"], r["type"]) for r in profile.object_member_stats(deep, "s[]").collect()} == {
        "v[].k": (False, "number"), "v[].w[]": (True, "array[number]"), "e[]": (True, "array[object]"),
    }
    assert stats["s[].k"] == (13, 100.0, "number", 1.0, "k") and stats["s[].v[]"] == (12, 92.3, "array[string]", 2.92, "v[]")
    fields = {r["field"]: r for r in profile.schema_overview(docs, eav).collect()}
    assert (fields["s"]["doc_count"], fields["s"]["coverage_pct"], fields["s"]["count_max"], fields["s"]["count_min"]) == (4, 100.0, 11, 1)
    assert fields["s"]["members"] == ["s[].k", "s[].v", "s[].v[]"] and fields["s"]["sample_value"] == "k, v, v[]" and fields["s"]["distinct_values"] == 2
    assert profile.is_scalar_array(eav, "s[].v[]") and not profile.is_scalar_array(eav, "s[]")
    counts = {r["record_id"]: r["value_count"] for r in profile.path_record_counts(docs, eav, "s[].v").collect()}
    assert counts == {"r0": 0} and profile.records_with_value(docs, eav, "s[].v[]", "a").count() == 23
    assert profile.record_page(profile.path_record_counts(docs, eav, "s[].k"), term="R1", by="value_count").filtered == 1


def test_paths(spark):
    df = spark.createDataFrame([("a.b[].c\nd", "a.b[3].c\nd"), ("a", "a"), ("ab", "ab"), ("a[][]", "a[0][1]")], "p string, i string")
    got = df.select(
        paths.element_prefix("p"), paths.object_prefix("p"), paths.instance_key("i", 1), paths.instance_key("i", 0), paths.top_field("p"), paths.top_element("i"), paths.under("a", "p"), paths.under_column("p", F.lit("a"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("a.b[]", "a.b[]", "a.b[3]", "", "a", "a", True, True), ("a", "", "a", "", "a", "a", True, True), ("ab", "", "ab", "", "ab", "ab", False, False),
        ("a[][]", "a[][]", "a[0]", "", "a", "a[0]", True, True),
    ]
    assert paths.object_prefix_of("a[].b[].c") == "a[].b[]" and paths.object_prefix_of("a") == ""


def test_export(spark, tmp_path):
    df = spark.sql("select 1.50BD as amount, date '2026-06-01' as d, timestamp '2026-06-01 10:00:00' as t, cast(null as string) as n, array(1, 2) as a, 'x' as s")
    export.write_json(df, str(tmp_path / "j"))
    row = json.loads(spark.read.text(str(tmp_path / "j")).first()[0])
    assert row == {"amount": 1.5, "d": "2026-06-01", "t": "2026-06-01T10:00:00", "n": None, "a": [1, 2], "s": "x"}
    export.write_csv(df, str(tmp_path / "c"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "c")).collect()] == ["amount,d,t,n,a,s", '1.5,2026-06-01,2026-06-01T10:00:00,,"[1,2]",x']
