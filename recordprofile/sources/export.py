"""Results as CSV or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as ISO text."""
    changed = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            changed[f.name] = F.col(f"`{f.name}`").cast("double")
        elif isinstance(f.dataType, T.DateType):
            changed[f.name] = F.col(f"`{f.name}`").cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            changed[f.name] = F.date_format(f"`{f.name}`", "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumns(changed) if changed else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nulls are empty, and nested columns are JSON text."""
    nested = {f.name: F.to_json(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    out = df.withColumns(nested) if nested else df
    plain(out).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, null members included."""
    plain(df).write.option("ignoreNullFields", False).json(path)
