"""Object identity, content fingerprint and serialisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rillflow.functions.text import strip

SEP = "\x1f"
KEEP_NULLS = {"ignoreNullFields": "false"}


def stable_id(source: Column, external_id: Column, kind: Column, instance: Column) -> Column:
    """``sig_`` and 24 hex digits of the hashed source identity."""
    raw = F.concat_ws(
        SEP, F.lower(strip(source)), F.lower(strip(instance)), kind, strip(external_id)
    )
    return F.concat(F.lit("sig_"), F.substring(F.sha2(raw, 256), 1, 24))


def source_key(source: Column, instance: Column) -> Column:
    return F.concat_ws(":", source, instance)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset; the fraction appears only when it is not zero."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def canonical_text(prefix: str = "") -> Column:
    """Compact JSON of the source-visible columns with sorted keys.

    ``id`` and ``collected_at`` stay out, so polling the same object again changes nothing.
    ``metadata_json`` is already canonical and is spliced in as it is.
    """
    def c(name: str) -> Column:
        return F.col(prefix + name)

    head = F.to_json(
        F.struct(
            c("author").alias("author"),
            c("content").alias("content"),
            iso_utc(c("created_at")).alias("created_at"),
            c("kind").alias("kind"),
        ),
        KEEP_NULLS,
    )
    tail = F.to_json(
        F.struct(
            c("schema_version").alias("schema_version"),
            c("source").alias("source"),
            c("source_instance").alias("source_instance"),
            c("title").alias("title"),
            iso_utc(c("updated_at")).alias("updated_at"),
            c("url").alias("url"),
        ),
        KEEP_NULLS,
    )
    return F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"metadata":'),
        c("metadata_json"),
        F.lit(","),
        F.substring(tail, F.lit(2), F.length(tail) - 1),
    )


def fingerprint(prefix: str = "") -> Column:
    return F.sha2(canonical_text(prefix), 256)


def idempotency_key(sink: Column, event_id: Column, event_hash: Column, prefix: str = "rillflow") -> Column:
    """Stable for retries of one version, different for the next version."""
    raw = F.concat_ws(SEP, sink, event_id, event_hash)
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(raw, 256), 1, 32))


def query_instance(query: Column) -> Column:
    """Instance name for a search: ``search-`` and 12 hex digits of the hashed query."""
    return F.concat(F.lit("search-"), F.substring(F.sha2(strip(query), 256), 1, 12))


def event_json() -> Column:
    """One JSON object with all thirteen event fields; nulls are kept."""
    head = F.to_json(
        F.struct(
            "id", "source", "kind", "content", "url",
            iso_utc(F.col("created_at")).alias("created_at"),
            iso_utc(F.col("collected_at")).alias("collected_at"),
            "title", "author",
        ),
        KEEP_NULLS,
    )
    tail = F.to_json(
        F.struct(
            "source_instance",
            iso_utc(F.col("updated_at")).alias("updated_at"),
            "schema_version",
        ),
        KEEP_NULLS,
    )
    return F.concat(
        F.substring(head, F.lit(1), F.length(head) - 1),
        F.lit(',"metadata":'),
        F.col("metadata_json"),
        F.lit(","),
        F.substring(tail, F.lit(2), F.length(tail) - 1),
    )


def cursor_json(source_key_col: Column, state_json: Column, version: Column | None = None) -> Column:
    """Versioned checkpoint text with sorted keys; the state is canonicalised as well."""
    state = F.to_json(F.parse_json(F.coalesce(state_json, F.lit("{}"))))
    quoted = F.to_json(F.array(source_key_col))
    return F.concat(
        F.lit('{"source_key":'),
        F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        F.lit(',"state":'),
        state,
        F.lit(',"version":'),
        F.coalesce(version, F.lit(1)).cast("string") if version is not None else F.lit("1"),
        F.lit("}"),
    )


def parse_cursor(text: Column) -> Column:
    """``struct<source_key, state_json, version, valid>``; only an object with a key is valid."""
    v = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    key = F.try_variant_get(v, "$.source_key", "string")
    version = F.coalesce(F.try_variant_get(v, "$.version", "int"), F.lit(1))
    state = F.coalesce(F.to_json(F.try_variant_get(v, "$.state", "variant")), F.lit("{}"))
    valid = is_object & F.coalesce(strip(key) != "", F.lit(False)) & (version >= 1)
    return F.struct(
        key.alias("source_key"), state.alias("state_json"), version.alias("version"), valid.alias("valid")
    )
