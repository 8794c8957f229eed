"""Line deduplication within one edit by a deletion-neighbourhood join.

A line is dropped when an earlier line (by document id, then place) equals it or is
within one inserted, deleted or replaced character, however short it is.  Equal
lines first fold into one.  Then every line emits its variants with one character deleted, as hashes with
the place of the deletion, and itself as the variant with nothing deleted:

* two lines with one variant deleted at one place differ in that one character;
* a line that is another's variant lacks one character.

So within equal variants the earliest line that fits is the partner, and no pairs
are listed: distinct lines with a common variant can only differ in one character,
so the join's groups stay small however common a line is.  Partners are verified by
edit distance on the texts.

Variants cost a row per character.  A line within one edit of another shares its
first or its last half with it, so only lines that share a half (of the length in
question) with a different line emit variants; no link is lost by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import durable, free_name, join_groups

VARIANTS_PER_BATCH = 16_384
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = " \t\r\f\x0b"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variant_hashes(line: str) -> np.ndarray:
    """Hash of the line, then of the line without its i-th character, for each i; equal strings hash equally."""
    chars = _mixed(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(chars), _BASE)]), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(chars * powers[:-1], dtype=np.uint64)])
    without = sums[:-1] + _INVERSE * (sums[-1] - sums[1:])
    return _mixed(np.concatenate([sums[-1:], without])).view(np.int64)


def text_lines(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, t, no, line, h, g, n): every line without white space at its ends, its two hashes and its length.

    t is the hash of the whole text: it tells rows apart that share an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("no", "line"))
    trimmed = split.withColumn("line", F.btrim("line", F.lit(_SPACE)))
    return trimmed.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line"), "n": F.char_length("line")})


def _halves(line: Column, n: Column) -> Column:
    """Hashed keys: first and last half of the line, for partners of its own length and of one more or less."""
    keys = []
    for more in (0, 1):
        c = n + more
        half = F.floor((c - 1) / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), c, F.left(line, half)), F.xxhash64(F.lit(1), c, F.right(line, half))]
    return F.array(*keys)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line's hashes with the places of their deletions, in batches of bounded size however long a line is."""
    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("id", "t", "no", "h", "g", "line")}

        def rows(parts: list[tuple[int, int, np.ndarray]], column=column) -> pa.RecordBatch:
            take = pa.array(np.repeat([k for k, _, _ in parts], [len(x) for _, _, x in parts]))
            out = {c: column[c].take(take) for c in ("id", "t", "no", "h", "g")}
            out["v"] = pa.array(np.concatenate([x for _, _, x in parts]))
            out["at"] = pa.array(np.concatenate([np.arange(a - 1, a - 1 + len(x), dtype=np.int32) for _, a, x in parts]))
            return pa.RecordBatch.from_pydict(out)

        parts, waiting = [], 0
        for k, line in enumerate(column["line"]):
            hashes = variant_hashes(line.as_py())
            for a in range(0, len(hashes), VARIANTS_PER_BATCH):
                parts.append((k, a, hashes[a : a + VARIANTS_PER_BATCH]))
                waiting += len(parts[-1][2])
                if waiting >= VARIANTS_PER_BATCH:
                    yield rows(parts)
                    parts, waiting = [], 0
        if parts:
            yield rows(parts)


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h, g, keep, times), durable: of each different line that a row other than its own first one stands for, the earliest line's place.

    keep is a struct of id, t and no.  Only lines that repeat or have a partner are listed.
    """
    lines = text_lines(docs, id_col=id_col, text_col=text_col).where("n > 0")
    first = F.min(F.struct("id", "t", "no")).alias("first")
    different = durable(
        lines.withColumn("halves", _halves(F.col("line"), F.col("n")))
        .groupBy("h", "g")
        .agg(first, F.count(F.lit(1)).alias("times"), F.first("halves").alias("halves"))
    )
    keys = different.select("h", "g", F.explode("halves").alias("key"))
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("g").alias("c"), F.max("g").alias("d"))
    shared = shared.where("a <> b or c <> d").select("key")
    suspects = keys.join(shared, "key", "left_semi").select("h", "g").distinct()
    places = different.join(suspects, ["h", "g"], "left_semi").select("h", "g", F.col("first.id").alias("id"), F.col("first.t").alias("t"), F.col("first.no").alias("no"))
    same = places["id"].eqNullSafe(F.col("l.id")) & (places["t"] == F.col("l.t")) & (places["no"] == F.col("l.no"))
    texts = durable(
        text_lines(docs, id_col=id_col, text_col=text_col)
        .select("id", "t", "no", "line")
        .alias("l")
        .join(places, same)
        .select(places["id"], places["t"], places["no"], "h", "g", "line")
        .distinct()
    )
    kind = texts.schema["id"].dataType.simpleString()
    variants = texts.mapInArrow(_variants, f"id {kind}, t long, no int, h long, g long, v long, at int")
    own = F.struct("id", "t", "no")
    alike, equal = Window.partitionBy("v", "at"), Window.partitionBy("v")
    met = variants.select(
        "h", "g", own.alias("own"),
        F.when(F.col("at") >= 0, F.min(own).over(alike)).alias("replaced"),
        F.when(F.col("at") >= 0, F.min(F.when(F.col("at") < 0, own)).over(equal)).otherwise(F.min(F.when(F.col("at") >= 0, own)).over(equal)).alias("lacking"),
    )
    pairs = (
        met.select("h", "g", "own", F.explode(F.array("replaced", "lacking")).alias("to"))
        .where(F.col("to").isNotNull() & (F.col("to") < F.col("own")))
        .distinct()
    )
    near = (
        pairs.join(texts.select("h", "g", "line"), ["h", "g"])
        .join(texts.select(F.struct("id", "t", "no").alias("to"), F.col("line").alias("other")), "to")
        .where(F.levenshtein("line", "other", 1) >= 0)
        .groupBy("h", "g")
        .agg(F.min("to").alias("near"))
    )
    return durable(
        different.join(near, ["h", "g"], "left")
        .where("times > 1 or near is not null")
        .select("h", "g", F.least("first", F.coalesce("near", "first")).alias("keep"), "times")
    )


def _decided(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, t, no, keep, kept) of every line; blank ones meet nothing in the join."""
    lines = text_lines(docs, id_col=id_col, text_col=text_col)
    lines = lines.select("id", "t", "no", F.when(F.col("n") > 0, F.col("h")).alias("h"), "g")
    met = join_groups(lines, line_classes(docs, id_col=id_col, text_col=text_col), ["h", "g"], "times", ["id", "t", "no"])
    own = F.struct("id", "t", "no")
    keep = F.coalesce("keep", own)
    return met.select("id", "t", "no", keep.alias("keep"), keep.eqNullSafe(own).alias("kept"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line_no (from 0), keep_id, keep_no and kept.

    A line goes if an earlier one equals it (white space at the ends aside) or is
    within one edit, and keep_* names the earliest such line; that one may itself go
    for a still earlier one.  Blank lines always stay.  A null or empty text is one
    blank line; a null id comes first; an empty table has no rows.  Of rows with one
    id and different texts each is a document, in the order of a hash of the text;
    rows with one id and one text are one document, whose lines all rows keep.
    """
    found = _decided(docs, id_col=id_col, text_col=text_col)
    return found.select(F.col("id").alias(id_col), F.col("no").alias("line_no"), F.col("keep.id").alias("keep_id"), F.col("keep.no").alias("keep_no"), "kept")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, lost: pd.Series) -> pd.Series:
    """Each text without the lines of these numbers; null stays null."""
    out = []
    for text, numbers in zip(texts, lost, strict=True):
        gone = set() if text is None else set(numbers)
        out.append(None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone))
    return pd.Series(out, dtype=object)


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the lines that go; documents of which no text is left go too.

    Documents that had no text stay, and so does a line that ``dedup_lines`` keeps for
    any row of its id and text.  ``length_col`` is counted anew where lines went.
    """
    gone = _decided(docs, id_col=id_col, text_col=text_col).where(~F.col("kept"))
    lost, key, row, split = (free_name(docs, n) for n in ("__lost", "__key", "__row", "__split"))
    per_doc = gone.groupBy(F.col("id").alias(key), F.col("t").alias(row)).agg(F.collect_set("no").alias(lost))
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(row))
    joined = docs.join(per_doc, same, "left")
    # Else the filter and the text would each evaluate it, with a worker of its own for each task.
    rest = _without.asNondeterministic()(F.when(F.col(lost).isNotNull(), F.col(text_col)), F.col(lost))
    out = joined.withColumn(split, rest)
    out = out.where(F.col(lost).isNull() | (F.btrim(split, F.lit(_SPACE + "\n")) != ""))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.col(split))
    columns = {text_col: text}
    if length_col:
        columns[length_col] = F.when(F.col(lost).isNull(), F.col(length_col)).otherwise(F.char_length(split).cast(docs.schema[length_col].dataType))
    return out.withColumns(columns).select(docs.columns)
