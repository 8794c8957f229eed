"""Commit protocol of the corpus, and reads that touch no more files than they need."""

import glob
import json
import os
import re
from dataclasses import asdict
from random import Random

import pytest
from pyspark.sql import functions as F

from recordprofile.operators import profile, rundiff, sketches, tallies
from recordprofile.operators.scope import EMPTY
from recordprofile.sources import corpus as corpus_module, files, versions as vs
from recordprofile.sources.corpus import Conflict, Corpus
from recordprofile.streaming.incremental import follow_versions
from tests.test_engine import SCHEMA, table, version

COLUMNS = [c for c in SCHEMA.replace(",", "").split()[::2] if c != "filename"]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "corpus")


def land(spark, path, *rows):
    table(spark, *rows).select(COLUMNS).coalesce(1).write.mode("append").parquet(path)
    return table(spark).select(COLUMNS).schema


def ids(corpus):
    return sorted(r["version_key"] for r in corpus.open()[0].collect())


def test_put_if_absent(spark, tmp_path):
    path = str(tmp_path / "m" / "1.json")
    assert files.put_if_absent(spark, path, "one") and not files.put_if_absent(spark, path, "two")
    assert files.read_text(spark, path) == "one"
    files.write_text(spark, path, "three")
    assert files.read_text(spark, path) == "three" and [n for n in os.listdir(tmp_path / "m") if not n.startswith(".")] == ["1.json"]


def test_update_after_one_that_died(spark, root, monkeypatch):
    corpus = Corpus(spark, root)
    first = corpus.build(table(spark, version("A")))
    more = table(spark, version("A"), version("B", offset=1))

    def dies(*_):
        raise KeyboardInterrupt

    # After the documents and before the manifest.
    with monkeypatch.context() as m:
        m.setattr(corpus_module.files, "put_if_absent", dies)
        with pytest.raises(KeyboardInterrupt):
            corpus.update(more)
    assert corpus.manifest() == first and ids(corpus) == ["A|run1|0"] and len(os.listdir(f"{root}/docs")) == 2
    found = corpus.update(more)
    assert found.version == 2 and ids(corpus) == ["A|run1|0", "B|run1|1"] and corpus.open()[1].count() == 4
    corpus.vacuum()
    assert len(os.listdir(f"{root}/docs")) == 1 and len([n for n in os.listdir(f"{root}/eav") if n.startswith("part=")]) == 2 and ids(corpus) == ["A|run1|0", "B|run1|1"]


def test_one_of_two_updaters_wins(spark, root, monkeypatch):
    corpus = Corpus(spark, root)
    corpus.build(table(spark, version("A")))
    counted = Corpus._counted

    def meanwhile(self, manifest):
        found = counted(self, manifest)
        with monkeypatch.context() as m:
            m.setattr(Corpus, "_counted", counted)
            Corpus(spark, root).update(table(spark, version("A"), version("C", offset=2)))
        return found

    with monkeypatch.context() as m:
        m.setattr(Corpus, "_counted", meanwhile)
        with pytest.raises(Conflict):
            corpus.update(table(spark, version("A"), version("B", offset=1)))
    assert corpus.manifest().version == 2 and ids(corpus) == ["A|run1|0", "C|run1|2"]
    assert corpus.update(table(spark, version("A"), version("B", offset=1))).version == 3 and ids(corpus) == ["A|run1|0", "B|run1|1"]


def test_report_is_kept_where_it_can_be(spark, root, monkeypatch):
    corpus = Corpus(spark, root)

    def fails(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m, pytest.warns(UserWarning, match="not kept"):
        m.setattr(corpus_module.files, "move_if_absent", fails)
        corpus.build(table(spark, version("A")))
        assert corpus.update(table(spark, version("A"), version("B", offset=1))).version == 2
        assert {r["field"]: r["doc_count"] for r in corpus.field_usage_report().collect()} == {"title": 2, "id": 2}
    assert corpus.field_usage_report().count() == 2 and "whole" in os.listdir(f"{root}/reports/2")


def test_stream_goes_on_after_a_failed_batch(spark, root, tmp_path, monkeypatch):
    path, checkpoint = str(tmp_path / "landing"), str(tmp_path / "cp")
    schema = land(spark, path, version("A"))
    follow = lambda: follow_versions(spark, path, root, checkpoint=checkpoint, schema=schema).awaitTermination()
    follow()
    land(spark, path, version("B", offset=1))
    with monkeypatch.context() as m:
        m.setattr(corpus_module.files, "put_if_absent", lambda *_: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(Exception, match="gone"):
            follow()
    follow()
    assert ids(Corpus(spark, root)) == ["A|run1|0", "B|run1|1"]


def spoil(path, keep):
    """Overwrite all files that hold no version of these runs with rubbish: whoever reads one fails."""
    import pyarrow.parquet as pq

    spoiled = 0
    for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
        if not set(pq.ParquetFile(f).read(columns=["run_id"]).column("run_id").to_pylist()) & set(keep):
            size, spoiled = os.path.getsize(f), spoiled + 1
            with open(f, "wb") as out:
                out.write(b"x" * size)
    return spoiled


@pytest.mark.parametrize("layout", ["files", "folders"])
def test_run_diff_reads_payloads_of_prior_files_only(spark, tmp_path, layout, monkeypatch):
    path = str(tmp_path / "versions")
    rows = [[version(f"R{k}", f"old{d}", k, day=d) for k in range(d * 3, d * 3 + 3)] for d in (1, 2, 3, 4)]
    new = [version("R3", "X", 0, day=9, title="other"), version("R13", "X", 1, day=9)]
    later = [version("R3", "later", 0, day=12)]
    for part in (*rows, new, later):
        if layout == "files":
            land(spark, path, *part)
        else:
            vs.write_versions(table(spark, *part).select(COLUMNS), path)
    versions = vs.read_versions(spark, path, table(spark).select(COLUMNS).schema)
    want = rundiff.summary_row(rundiff.classified(versions, "X")[0]).first()
    assert (want["touched"], want["modified"], want["unchanged"]) == (2, 1, 1)
    keys = rundiff.run_keys(versions, "X")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = rundiff.needles(versions, keys)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in (line.split("\n")[0] for line in plan.split("FileScan")[1:]) if "payload#" in x.split("Batched")[0])
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "file_path" in scan and {"X", "old1", "old4"} <= set(re.search(r"run_id#\d+ IN \(([^)]*)\)", scan)[1].split(","))
    assert layout == "files" or "In(source" in scan.replace(" ", "") or "source#" in scan.split("PartitionFilters:")[1].split("]")[0]
    # Metadata is read everywhere, payloads of three files: the others may be rubbish from now on.
    assert spoil(path, ("X", "old1", "old4")) == 3
    assert rundiff.summary_row(_classified(monkeypatch, keys, versions)).first() == want
    # With more files than are named one by one, the join alone says what counts.
    few = rundiff.needles(vs.read_versions(spark, path, table(spark).select(COLUMNS).schema).where("run_id in ('X', 'old1', 'old4')"), keys)
    monkeypatch.setattr(rundiff, "pruned", lambda v, k: vs.pruned(v, k, most=1))
    assert few.count() == 4


def _classified(monkeypatch, keys, versions):
    with monkeypatch.context() as m:
        m.setattr(rundiff, "run_keys", lambda *_: keys)
        return rundiff.classified(versions, "X")[0]


@pytest.mark.parametrize("layout", ["files", "folders"])
def test_update_reads_payloads_of_new_runs_only(spark, root, tmp_path, layout, monkeypatch):
    path, schema = str(tmp_path / "versions"), table(spark).select(COLUMNS).schema
    add = (lambda *rows: land(spark, path, *rows)) if layout == "files" else (lambda *rows: vs.write_versions(table(spark, *rows).select(COLUMNS), path))
    for day in (1, 2, 3):
        add(*[version(f"R{day}{k}", f"run{day}", k, day=day) for k in range(4)])
    corpus = Corpus(spark, root)
    corpus.build(vs.read_versions(spark, path, schema))
    add(version("R11", "run4", 0, day=4, title="new"), version("R99", "run4", 1, day=4))
    versions = vs.read_versions(spark, path, schema)
    live = files.settled(corpus_module.live_keys(versions))
    assert spoil(path, ("run4",)) == 3
    monkeypatch.setattr(corpus_module, "live_keys", lambda _: live)
    assert corpus.update(versions).doc_count == 13
    eav = corpus.open()[1]
    assert eav.where("value = 'new'").count() == 1 and eav.count() == 26


def test_pruned_keeps_rows_without_names(spark):
    rows = table(spark, version("A"), version("B", "run2", filename=None), version("C", "run3", day=2))
    keys = rows.where("record_id <> 'C'").select("run_id", "run_date", "filename")
    for most in (1, 10):
        left = {r["record_id"] for r in vs.pruned(rows, keys, most=most).collect()}
        assert {"A", "B"} <= left and ("C" in left) == (most == 1)
    assert vs.pruned(rows, keys.limit(0)).count() == 0


def test_documents_keep_a_print_of_their_leaves(spark, root):
    corpus = Corpus(spark, root)
    rows = [version("A", payload='{"a": 1, "b": 2}'), version("B", offset=1, payload='{"b": 2, "a": 1.0}'), version("C", offset=2, payload='{"a": 1, "b": "2"}')]
    corpus.build(table(spark, *rows))
    docs = spark.read.parquet(f"{root}/docs/{corpus.manifest().snapshot}")
    prints = {r["record_id"]: tuple(r["leaf_print"]) for r in docs.collect()}
    assert prints["A"] == prints["B"] != prints["C"]
    again = {r["record_id"]: tuple(r["leaf_print"]) for r in rundiff.version_prints(table(spark, *rows)).collect()}
    assert again == prints and profile.field_usage(corpus.open()[1]).count() == 2
    assert rundiff.version_prints(table(spark, version("D", action="delete"))).where(F.col("leaf_print").isNull()).count() == 1


def scanned(df):
    """Rows that the scans of a collected plan gave out."""
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            open_.append(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            open_.append(node.plan())
        elif "FileSourceScan" in node.getClass().getSimpleName():
            total += node.metrics().apply("numOutputRows").value()
        open_ += [node.children().apply(k) for k in range(node.children().length())]
    return total


@pytest.fixture
def many(spark):
    return spark.range(200_000).selectExpr(
        "concat('r', lpad(id % 20000, 6, '0')) AS record_id", "concat('s', id % 3) AS source", "date '2026-01-01' + cast(id / 20000 AS int) AS run_date", "'daily' AS run_type",
        "'index' AS action", "concat('run', id div 20000) AS run_id", "id % 20000 AS run_record_offset", "if(id % 1000 = 0, null, timestamp_seconds(1767225600 + id * 60)) AS run_timestamp",
        "'f' AS filename", "repeat('x', 100) AS payload",
    )


def test_lookup_reads_a_group_of_rows(spark, tmp_path, many):
    path = str(tmp_path / "lookup")
    vs.write_lookup(many, path, group_bytes=64 << 10)
    found = vs.read_lookup(spark, path)
    history = vs.record_history(found, "r000777")
    assert [r["run_id"] for r in history.collect()] == [f"run{k}" for k in range(9, -1, -1)]
    assert "EqualTo(record_id,r000777)" in history._jdf.queryExecution().executedPlan().toString() and scanned(history) < 20_000
    assert [tuple(r) for r in vs.current_key(found, "r000777").collect()] == [("r000777", "run9", 777), ("r000777", "run8", 777), ("r000777", "run7", 777)] or vs.current_key(found, "r000777").count() == 3
    # Between two ids that are there: statistics can't tell, the filter can.
    absent = vs.record_history(found, "r000777x")
    assert absent.collect() == [] and scanned(absent) == 0


@pytest.mark.parametrize(("by", "descending"), [("run_timestamp", True), ("run_timestamp", False), ("source", True)])
def test_seek_shows_the_pages_of_offsets(spark, by, descending):
    from recordprofile.operators import filters

    times = [None, 3, 3, 1, None, 2, 2, 2]
    frame = spark.createDataFrame([(f"r{k % 3}", f"run{k}", k, t, None if k % 4 == 0 else "s") for k, t in enumerate(times)], "record_id string, run_id string, run_record_offset long, run_timestamp long, source string")
    order = {"by": by, "ties": ("record_id", "run_id", "run_record_offset")}
    whole = [r["run_id"] for r in filters.ordered(frame, **order, descending=descending).collect()]
    seen, after = [], None
    while rows := filters.seek_rows(frame, **order, descending=descending, after=after, length=3).collect():
        seen += [r["run_id"] for r in rows]
        after = filters.continuation(rows[-1], **order)
    assert seen == whole


def test_a_page_far_behind_reads_less(spark, tmp_path, many):
    from recordprofile.operators import filters

    path = str(tmp_path / "sorted")
    many.orderBy("run_record_offset").write.option("parquet.block.size", 64 << 10).parquet(path)
    frame = spark.read.parquet(path).drop("payload")
    order = {"by": "run_record_offset", "ties": ("record_id", "run_id")}
    first, far = filters.seek_rows(frame, **order), filters.seek_rows(frame, **order, after=(19_900, "r019900", "run4"))
    assert [r["run_id"] for r in far.collect()][:6] == ["run5", "run6", "run7", "run8", "run9", "run0"] and first.count() == 50
    first = filters.seek_rows(frame, **order)
    first.collect()
    assert scanned(far) < scanned(first) / 4


def test_report_adds_up_over_updates(spark, root, monkeypatch):
    corpus, random = Corpus(spark, root), Random(7)
    payload = lambda k: json.dumps({"id": k, "tags": [{"t": str(random.randrange(4))} for _ in range(random.randrange(4))], "some": random.choice([1, "1", None, True, [], {}, [1, 2], ["x"]])})
    live = {f"R{k}": version(f"R{k}", offset=k, payload=payload(k)) for k in range(12)}
    corpus.build(table(spark, *live.values()))
    kept = Corpus._report
    monkeypatch.setattr(Corpus, "_report", lambda *_: None)  # nobody reads the reports in between
    for step in range(10):
        run = f"run{step + 2}"
        for key in random.sample(sorted(live), 3):
            live[key] = version(key, run, random.randrange(99), payload=payload(step))
        live[f"N{step}"] = version(f"N{step}", run, 100, payload=payload(step))
        del live[random.choice(sorted(live))]
        found = corpus.update(table(spark, *live.values()))
        if step == 4:
            corpus.vacuum()
    monkeypatch.setattr(Corpus, "_report", kept)
    report = corpus.field_usage_report()
    assert len(found.tallies) == 11 and report.collect() == profile.schema_overview(*corpus.open()).collect()
    assert corpus._report(found, EMPTY).schema == report.schema and found.doc_count == len(live)
    summed = tallies.merged(corpus._tallies(found.tallies))
    assert all("/tallies/" in f for f in tallies.report(summed, found.doc_count).inputFiles()) and summed.where("times < 0").isEmpty()
    small = corpus.compact()
    assert len(small.tallies) == 1 and corpus.field_usage_report().collect() == report.collect()
    corpus.update(table(spark))
    assert corpus.field_usage_report().count() == 0 and corpus.update(table(spark, *live.values())).doc_count == len(live)
    assert corpus.field_usage_report().collect() == report.collect()


def test_many_tallies_become_one(spark, root, monkeypatch):
    corpus = Corpus(spark, root)
    monkeypatch.setattr(corpus_module, "MOST_PARTS", 2)
    rows = [version(c, offset=k) for k, c in enumerate("ABCDE")]
    corpus.build(table(spark, rows[0]))
    sizes = [len(corpus.update(table(spark, *rows[: k + 2])).tallies) for k in range(4)]
    assert max(sizes) <= 2 and {r["field"]: r["doc_count"] for r in corpus.field_usage_report().collect()} == {"title": 5, "id": 5}


def test_a_version_without_tallies_still_reports(spark, root):
    corpus = Corpus(spark, root)
    first = corpus.build(table(spark, version("A")))
    files.write_text(spark, f"{root}/manifests/1.json", json.dumps({k: v for k, v in asdict(first).items() if k != "tallies"}))
    assert corpus.update(table(spark, version("A"), version("B", offset=1))).tallies == []
    assert {r["field"]: r["doc_count"] for r in corpus.field_usage_report().collect()} == {"title": 2, "id": 2}
    assert len(corpus.compact().tallies) == 1 and corpus.field_usage_report().count() == 2


def test_sketches_are_near_and_merge(spark):
    n = 20_000
    eav = spark.range(n).selectExpr(
        "concat('d', id) AS version_key", "'x' AS path", "'x' AS path_indexed", "CAST(id % 5000 AS string) AS value", "'number' AS value_type", "id % 7 AS day",
    )
    text = eav.limit(0).union(spark.sql("SELECT 'd1', 't', 't', CAST(NULL AS string), 'null', 1L"))
    parts = sketches.path_sketches(eav.union(text), "day")
    found = {r["path"]: r for r in sketches.estimates(sketches.merge_sketches(parts), (0.1, 0.5, 0.9)).collect()}
    x = found["x"]
    assert x["leaves"] == n and abs(x["documents"] - n) < 0.065 * n and abs(x["different_values"] - 5000) < 0.065 * 5000
    assert all(abs(v - q * 5000) < 0.03 * 5000 for v, q in zip(x["quantiles"], (0.1, 0.5, 0.9), strict=True))
    assert (found["t"]["leaves"], found["t"]["documents"], found["t"]["different_values"], found["t"]["quantiles"]) == (1, 1, 0, None)
    assert sketches.estimates(sketches.merge_sketches(sketches.path_sketches(eav.limit(0)))).count() == 0
