"""Column functions over versions, payloads and leaf values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

def version_key(record_id: Column | str = "record_id", run_id: Column | str = "run_id", offset: Column | str = "run_record_offset") -> Column:
    """The identity of a version. Record ids may hold colons, so a pipe joins the parts."""
    return F.concat_ws("|", record_id, run_id, offset)


def leaf_type(v: Column) -> Column:
    """string, number, boolean, null, object-empty or array-empty, of a variant that is a leaf."""
    kind = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("OBJECT"), "object-empty")
        .when(kind.startswith("ARRAY"), "array-empty")
        .otherwise("number")
    )


def leaf_text(v: Column) -> Column:
    """The leaf's value as text; nulls and empty containers have none."""
    kind = F.schema_of_variant(v)
    return F.when(~F.is_variant_null(v) & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), v.cast("string"))


def naive_utc(c: Column | str) -> Column:
    """A timestamp as UTC wall-clock time without zone. The session's time zone says what the instant is shown in."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")


def run_day(c: Column | str) -> Column:
    """A date from a date, timestamp or ISO text (its first ten characters); null where that is no date."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_to_date(F.substring(F.trim(c.cast("string")), 1, 10), "yyyy-MM-dd")


def decoded(payload: Column | str) -> Column:
    """Text of a payload kept as bytes or text; bytes that aren't UTF-8 are replaced."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    return F.make_valid_utf8(payload.cast("string"))


def headline(payload: Column | str, field: str) -> Column:
    """A top-level member if it is a non-empty string, else null; payloads that aren't JSON have none."""
    member = F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant")
    text = F.when(F.schema_of_variant(member) == "STRING", member.cast("string"))
    return F.nullif(text, F.lit(""))


def raw_format(source: Column | str, formats: Mapping[str, str], default: str = "xml") -> Column:
    """The raw payload's format by source; ``formats`` names it for sources that differ from the default."""
    source = F.col(source) if isinstance(source, str) else source
    if not formats:
        return F.lit(default)
    known = F.create_map(*[F.lit(x) for pair in formats.items() for x in pair])
    return F.coalesce(F.try_element_at(known, source), F.lit(default))
