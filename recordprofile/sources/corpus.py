"""The corpus: documents and their leaves as Parquet, kept in step with the record versions.

    docs/<id>            one row per document, with the part, number and fingerprint of its leaves; rewritten by each update (narrow)
    eav/part=<id>        leaves; each build or update only adds the part it flattened
    tallies/<id>         what a build or update changed in the counts of the whole corpus's report
    manifests/<n>.json   version n: what is published; the highest number counts
    reports/<n>/...      field reports of version n by scope, kept where they can be written

A document names the part that holds its leaves, so the live leaves are those whose
(version key, part) is a document's: deletes cost nothing in eav, and a key that
comes back does not meet its old leaves.  The whole corpus's report adds up the tallies
of what came and what went, so an update profiles the part it flattened and the leaves
of the documents that go, and no others.

Folders have ids of their own, so a writer that fails or dies leaves nothing that
another one could meet.  Version n + 1 is published by creating its manifest, which
succeeds for one writer only: of several that started from version n, one wins and the
others raise ``Conflict`` and publish nothing.  Readers of an older version keep their
snapshot until ``vacuum``.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import warnings
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordprofile.functions.values import naive_utc, run_day, version_key
from recordprofile.operators import profile, tallies
from recordprofile.operators.flatten import flatten_leaves, leaf_print
from recordprofile.operators.scope import EMPTY, Scope, scoped
from recordprofile.sources import files
from recordprofile.sources.versions import current_records, metadata_only, pruned, read_versions

LEAF_SCHEMA = "version_key string, path string, path_indexed string, value string, value_type string, part string"
#: Parts whose leaves are read together at most; past that an update compacts.
MOST_PARTS = 64
DOC_COLUMNS = ("version_key", "record_id", "source", "run_id", "run_record_offset", "run_timestamp", "run_date", "run_type", "action")
#: What a document says of its leaves, besides.
KEPT = ("leaves", "leaf_print", "part")
#: From so many documents on, an uncached report of the whole corpus is worth a warning.
LARGE_CORPUS = 100_000


@dataclass(frozen=True)
class Manifest:
    version: int
    snapshot: str
    parts: list[str]
    created_at: str
    updated_at: str
    location: str
    doc_count: int
    eav_count: int
    skipped_count: int
    source_count: int
    dead: bool = False
    stale: bool = False
    excluded_fields: list[str] = field(default_factory=list)
    tallies: list[str] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime())


class Corpus:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Reading

    def _newest(self) -> int:
        numbers = (n.removesuffix(".json") for n in files.names(self.spark, f"{self.root}/manifests"))
        return max((int(n) for n in numbers if n.isdigit()), default=0)

    def exists(self) -> bool:
        return self._newest() > 0

    def manifest(self, version: int | None = None) -> Manifest | None:
        """Of a version, the newest one unless it is given; None if there is no corpus."""
        number = version or self._newest()
        return Manifest(**json.loads(files.read_text(self.spark, f"{self.root}/manifests/{number}.json"))) if number else None

    def meta(self) -> dict:
        """The published counts and times; empty if there is no corpus."""
        found = self.manifest()
        return {k: v for k, v in asdict(found).items() if k not in ("parts", "dead", "snapshot", "tallies")} if found else {}

    def meta_row(self) -> DataFrame:
        """``meta`` as a one-row DataFrame, for SQL."""
        meta = self.meta()
        if not meta:
            raise FileNotFoundError(f"no corpus at {self.root}")
        return self.spark.createDataFrame([{k: v for k, v in meta.items() if k != "excluded_fields"}])

    def open(self) -> tuple[DataFrame, DataFrame]:
        """(docs, eav) of the published snapshot."""
        found = self.manifest()
        if found is None:
            raise FileNotFoundError(f"no corpus at {self.root}")
        return self._docs(found).drop(*KEPT), self._live(found)

    def _docs(self, found: Manifest) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/docs/{found.snapshot}")

    def _live(self, found: Manifest) -> DataFrame:
        # One scan; the partition filter leaves out parts that no document names.
        eav = self.spark.read.schema(LEAF_SCHEMA).parquet(f"{self.root}/eav").where(F.col("part").isin(found.parts))
        if found.dead:
            eav = eav.join(self._docs(found).select("version_key", "part"), ["version_key", "part"], "left_semi")
        return eav.drop("part")

    # Writing

    def _add(self, records: DataFrame, excluded: list[str]) -> tuple[str, DataFrame]:
        """Flatten records into a new part, sorted by path within files so that scans skip row groups; (part, its documents).

        The leaves are of exactly the rows that become documents.
        """
        part = uuid.uuid4().hex
        keyed = records.select(version_key().alias("version_key"), "payload")
        flatten_leaves(keyed, excluded_fields=excluded).sortWithinPartitions("path").write.parquet(f"{self.root}/eav/part={part}")
        counts = self._part(part).groupBy("version_key").agg(F.count(F.lit(1)).alias("leaves"), leaf_print().alias("leaf_print"))
        return part, self.documents(records).join(counts, "version_key", "left").withColumn("part", F.lit(part))

    def _part(self, part: str) -> DataFrame:
        return self.spark.read.schema(LEAF_SCHEMA).parquet(f"{self.root}/eav").where(F.col("part") == part)

    def _tally(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/tallies/{name}")
        return name

    def _tallies(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(tallies.TALLY_SCHEMA).parquet(*[f"{self.root}/tallies/{n}" for n in names])

    def _change(self, old: Manifest, part: str, written: DataFrame, gone: int) -> list[str]:
        """The tallies after an update: the old ones and that of what came in a part and what is no longer written; merged past MOST_PARTS.

        None where the old version kept none; then the report profiles all leaves until a build or compaction.
        """
        if not old.tallies:
            return []
        changed = tallies.tally(self._part(part))
        if gone:
            left = self._docs(old).select("version_key", "part").join(written.select("version_key", "part"), ["version_key", "part"], "left_anti")
            leaves = self.spark.read.schema(LEAF_SCHEMA).parquet(f"{self.root}/eav").where(F.col("part").isin(old.parts))
            changed = changed.unionByName(tallies.taken_off(tallies.tally(leaves.join(left, ["version_key", "part"], "left_semi"))))
        found = [*old.tallies, self._tally(changed)]
        return found if len(found) <= MOST_PARTS else [self._tally(tallies.merged(self._tallies(found)))]

    def _counted(self, manifest: dict) -> Manifest:
        """The manifest with the counts of its documents, which know the number of their leaves."""
        docs = self.spark.read.parquet(f"{self.root}/docs/{manifest['snapshot']}")
        counts = docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"), F.count_distinct("source").alias("sources")).first()
        parts = [r[0] for r in docs.select("part").distinct().collect()]  # MOST_PARTS and one more at most
        return Manifest(**manifest | {"parts": sorted(parts), "doc_count": counts["docs"], "eav_count": counts["leaves"], "source_count": counts["sources"]})

    def _publish(self, manifest: Manifest) -> Manifest:
        """The manifest first, by which all or nothing is published; then the whole corpus's report, if it can be written."""
        if not files.put_if_absent(self.spark, f"{self.root}/manifests/{manifest.version}.json", json.dumps(asdict(manifest))):
            raise Conflict(f"version {manifest.version} of {self.root} was published meanwhile")
        self._report(manifest, EMPTY)
        return manifest

    @staticmethod
    def documents(versions: DataFrame) -> DataFrame:
        return versions.select(
            version_key().alias("version_key"), "record_id", "source", "run_id", "run_record_offset",
            naive_utc("run_timestamp").alias("run_timestamp"), run_day("run_date").alias("run_date"), "run_type", "action",
        )

    def build(self, versions: DataFrame, *, location: str = "", excluded_fields: tuple[str, ...] = ()) -> Manifest:
        """Flatten every current record that has a payload. Malformed JSON fails the build and publishes nothing."""
        old, excluded = self.manifest(), list(excluded_fields)
        current = current_records(versions)
        has = F.coalesce((F.col("payload").isNotNull() & (F.col("payload") != "")), F.lit(False))
        snapshot, seen = uuid.uuid4().hex, Observation()
        current = current.observe(seen, F.count_if(~has).alias("skipped"))
        part, docs = self._add(current.where(has), excluded)
        docs.write.parquet(f"{self.root}/docs/{snapshot}")
        now, number, tallied = _now(), old.version + 1 if old else 1, self._tally(tallies.tally(self._part(part)))
        return self._publish(self._counted(asdict(Manifest(number, snapshot, [], now, now, location, 0, 0, seen.get["skipped"], 0, excluded_fields=excluded, tallies=[tallied]))))

    def update(self, versions: DataFrame | str) -> Manifest:
        """Bring the corpus in step with the current records, reading payloads only of current records with new keys.

        ``versions`` may be a path, whose files are then listed anew; of a DataFrame's
        files those count that it lists.  Counts of documents, leaves and sources and
        the version are refreshed, also if nothing changed; the skipped count and
        creation time stay as they were.
        """
        old = self.manifest()
        if old is None:
            raise FileNotFoundError(f"no corpus at {self.root}")
        if isinstance(versions, str):
            versions = read_versions(self.spark, versions)
        docs, snapshot = self._docs(old), uuid.uuid4().hex
        live = live_keys(versions)
        # The payloads are read of the rows that these keys and their files name, so that a key repeated in the versions counts once.
        fresh = files.settled(insert_set(live, docs).select("record_id", "source", "run_date", "run_id", "run_record_offset", "filename"))
        named = F.col("v.filename").eqNullSafe(F.col("k.filename")) & F.col("v.run_date").eqNullSafe(F.col("k.run_date"))
        for c in ("record_id", "source", "run_id", "run_record_offset"):
            named = named & (F.col(f"v.{c}") == F.col(f"k.{c}"))
        has = F.col("payload").isNotNull() & (F.col("payload") != "")
        wanted = current_records(pruned(versions, fresh).alias("v").join(fresh.alias("k"), named, "left_semi")).where(has)
        part, new = self._add(wanted, old.excluded_fields)
        kept = docs.join(live.select("version_key"), "version_key", "left_semi")
        kept.select(*DOC_COLUMNS, *KEPT).unionByName(new).write.parquet(f"{self.root}/docs/{snapshot}")
        written = self.spark.read.parquet(f"{self.root}/docs/{snapshot}")
        gone = old.doc_count - written.where(F.col("part") != part).count()
        changes = {"version": old.version + 1, "snapshot": snapshot, "updated_at": _now(), "dead": old.dead or gone > 0, "stale": False}
        found = self._counted(asdict(old) | changes | {"tallies": self._change(old, part, written, gone)})
        return self._compacted(found, found.version) if len(found.parts) > MOST_PARTS else self._publish(found)

    def compact(self) -> Manifest:
        """Rewrite the live leaves as one part."""
        old = self.manifest()
        return self._compacted(old, old.version + 1)

    def _compacted(self, old: Manifest, number: int) -> Manifest:
        part, snapshot = uuid.uuid4().hex, uuid.uuid4().hex
        self._live(old).sortWithinPartitions("path").write.parquet(f"{self.root}/eav/part={part}")
        self._docs(old).withColumn("part", F.lit(part)).write.parquet(f"{self.root}/docs/{snapshot}")
        summed = tallies.merged(self._tallies(old.tallies)) if old.tallies else tallies.tally(self._part(part))
        return self._publish(Manifest(**asdict(old) | {"version": number, "snapshot": snapshot, "parts": [part], "updated_at": _now(), "dead": False, "tallies": [self._tally(summed)]}))

    def vacuum(self) -> None:
        """Remove what the published version does not use, also what dead writers left; readers of an older one lose it.

        To be called while nobody writes: a writer's folders are in no manifest yet.
        """
        found = self.manifest()
        keep = {"docs": {found.snapshot}, "reports": {str(found.version)}, "eav": {f"part={p}" for p in found.parts}, "tallies": set(found.tallies), "manifests": {f"{found.version}.json"}}
        for folder, names in keep.items():
            for name in set(files.names(self.spark, f"{self.root}/{folder}")) - names:
                files.remove(self.spark, f"{self.root}/{folder}/{name}")

    # Reports

    def field_usage_report(self, scope: Scope = EMPTY) -> DataFrame:
        """The schema overview under a scope, kept by (corpus version, scope).

        A new version has a folder of its own, so older reports never answer for it.  One
        that can't be kept is answered all the same.
        """
        return self._report(self.manifest(), scope)

    def _report(self, found: Manifest, scope: Scope) -> DataFrame:
        name = hashlib.sha256(scope.key().encode()).hexdigest() if scope.key() else "whole"
        path = f"{self.root}/reports/{found.version}/{name}"
        if found.tallies and not scope.key():
            report = tallies.report(tallies.merged(self._tallies(found.tallies)), found.doc_count)
        else:
            report = profile.schema_overview(*scoped(self._docs(found).drop(*KEPT), self._live(found), scope))
        try:
            if not files.exists(self.spark, f"{path}/_SUCCESS"):
                aside = f"{self.root}/reports/{found.version}/.{uuid.uuid4().hex}"
                report.write.parquet(aside)
                files.move_if_absent(self.spark, aside, path)
            report = self.spark.read.parquet(path)
        except (PySparkException, Py4JJavaError, OSError) as e:
            warnings.warn(f"the report {path} was not kept: {e}", stacklevel=2)
        return report.orderBy(F.desc("doc_count"), "field")

    def is_large(self) -> bool:
        return self.meta().get("doc_count", 0) >= LARGE_CORPUS


def live_keys(versions: DataFrame) -> DataFrame:
    """(version_key, action and what names its row) of the current records, without payloads."""
    return current_records(metadata_only(versions)).select(version_key().alias("version_key"), "action", "record_id", "source", "run_date", "run_id", "run_record_offset", "filename")


def insert_set(live: DataFrame, docs: DataFrame) -> DataFrame:
    """Live keys that aren't deletes (nor without action) and have no document."""
    return live.where("action <> 'delete'").join(docs.select("version_key"), "version_key", "left_anti")


def delete_set(live: DataFrame, docs: DataFrame) -> DataFrame:
    """Keys of documents that are no longer live."""
    return docs.select("version_key").join(live.select("version_key"), "version_key", "left_anti")
