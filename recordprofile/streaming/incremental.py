"""A corpus kept in step with version files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from recordprofile.sources.corpus import Corpus
from recordprofile.sources.versions import VERSION_SCHEMA, read_versions


def follow_versions(spark: SparkSession, path: str, root: str, *, checkpoint: str, schema=VERSION_SCHEMA, trigger: dict | None = None) -> StreamingQuery:
    """Update the corpus at ``root`` for every batch of new files under ``path``, building it for the first.

    The batch only says that something came; the update compares the keys of all
    current versions with the corpus, so a batch that runs twice after a failure
    changes nothing the second time.
    """

    def step(batch: DataFrame, _number: int) -> None:
        if batch.isEmpty():
            return
        session = batch.sparkSession
        corpus, versions = Corpus(session, root), read_versions(session, path, schema)
        if corpus.exists():
            corpus.update(versions)
        else:
            corpus.build(versions, location=path)

    return (
        spark.readStream.schema(schema)
        .parquet(path)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
