"""Column functions: identity, hashing, text, time and JSON access."""

from rillflow.functions.identity import (
    canonical_text,
    cursor_json,
    event_json,
    fingerprint,
    idempotency_key,
    iso_utc,
    parse_cursor,
    query_instance,
    source_key,
    stable_id,
)
from rillflow.functions.jsonpath import is_object, json_path, json_text, to_text, variant_kind
from rillflow.functions.markup import html_to_text
from rillflow.functions.text import (
    age_text,
    ascii_lower,
    collapse,
    forum_url,
    initials,
    join_authors,
    optional_text,
    prom_escape,
    strip,
    truncate,
)
from rillflow.functions.times import feed_time, parse_epoch, parse_iso, parse_mail_date, to_utc

__all__ = [
    "age_text", "ascii_lower", "canonical_text", "collapse", "cursor_json", "event_json",
    "feed_time", "fingerprint", "forum_url", "html_to_text", "idempotency_key", "initials",
    "is_object", "iso_utc", "join_authors", "json_path", "json_text", "optional_text", "parse_cursor",
    "parse_epoch", "parse_iso", "parse_mail_date", "prom_escape", "query_instance", "source_key",
    "stable_id", "strip", "to_text", "to_utc", "truncate", "variant_kind",
]
