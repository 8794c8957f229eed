"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  All stages but the last return
the columns of documents.

* toxicity: scores every document, keeps those under 0.5.
* line dedup: drops lines that an earlier line equals or is within one edit of;
  documents that lose all their text go.
* jaccard join: of each group of near duplicates the smallest id stays.  Documents
  link by what line dedup left of them and by their texts before it, as a near copy
  whose common lines are gone looks like nothing any more.
* mixing: documents as often as their source's target takes them, cut at its budget.
* packing: the pieces of all documents, laid out in sequences of 1024 ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from recordprofile.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from recordprofile.llm.common import discard, shared_dir, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, earlier=table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither training, nor MinHash, nor tokenising; the tests hold the chain from line dedup on to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the table of a stage goes once the next one is written.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
    columns have the results that each stage's operator states; a document that loses
    all its text goes, one that had none stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
