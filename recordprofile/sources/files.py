"""Small control files in whatever file system Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _open(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    _, p, fs = _open(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    _, p, fs = _open(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the folder that all executors share, ``spark.checkpoint.dir``; in local mode without one, in a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to a new folder that all executors share and read again: computed once, whoever asks for it how often."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def _written_aside(spark: SparkSession, path: str, text: str):
    """(file context, where the text was written beside the path, the path), both qualified."""
    jvm, p, fs = _open(spark, path)
    aside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return context, fs.makeQualified(aside), fs.makeQualified(p)


def _rename(spark: SparkSession, context, source, target, how: str) -> None:
    kinds = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = getattr(kinds, how)
    context.rename(source, target, options)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file: written beside it under another name, then renamed."""
    context, aside, p = _written_aside(spark, path, text)
    _rename(spark, context, aside, p, "OVERWRITE")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file with all its text by one rename; False, and nothing written, if there is one already."""
    context, aside, p = _written_aside(spark, path, text)
    try:
        _rename(spark, context, aside, p, "NONE")
    except Py4JJavaError as e:
        context.delete(aside, False)
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def move_if_absent(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder; if the target exists, the source goes."""
    jvm, p, fs = _open(spark, source)
    to = jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(to) or not fs.rename(p, to):
        fs.delete(p, True)
