"""Dotted paths and text conversion over VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_kind(v: Column) -> Column:
    """``object``, ``array``, ``string``, ``boolean``, ``null`` or ``number``; null when missing."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def is_object(v: Column) -> Column:
    """Whether a VARIANT holds a JSON object; missing values do not."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _step(v: Column, key: str) -> Column:
    quote = '"' if "'" in key else "'"
    return F.try_variant_get(v, f"$[{quote}{key}{quote}]", "variant")


def json_path(v: Column, path: str) -> Column:
    """Follow ``a.0.b``: a segment is a key on objects and an index on arrays.

    Missing, blank and negative segments give null; a JSON null stays a VARIANT null.
    """
    current = v
    for raw in path.split("."):
        segment = raw.strip()
        if not segment:
            return F.lit(None).cast("variant")
        by_key = _step(current, segment)
        if segment.isdigit():
            by_index = F.try_variant_get(current, f"$[{int(segment)}]", "variant")
            current = F.coalesce(by_index, by_key)
        else:
            current = by_key
    return current


def json_text(v: Column) -> Column:
    """Sorted JSON with a space after commas and colons."""
    tokens = F.regexp_extract_all(
        F.to_json(v), F.lit(r'"(?:[^"\\]|\\.)*+"|[\[\]{}:,]|[^"\[\]{}:,]+'), F.lit(0)
    )
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), ""
    )


def to_text(v: Column) -> Column:
    """Text of a JSON value: null is empty, strings as they are, containers as sorted JSON."""
    kind = variant_kind(v)
    scalar = F.try_variant_get(v, "$", "string")
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(kind == "null", "")
        .when(kind.isin("object", "array"), json_text(v))
        .when(kind == "boolean", F.initcap(scalar))
        .otherwise(scalar)
    )
