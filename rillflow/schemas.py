"""Fixed, versioned table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# The event schema version and the table layout version.
EVENT_SCHEMA_VERSION = 1
LAYOUT_VERSION = 1

# The kinds an event may have, and the delivery and health states.
KINDS = ("article", "comment", "issue", "post", "pull_request", "story", "other")
DELIVERY_STATUSES = ("pending", "failed", "dead", "delivered")
HEALTH_STATUSES = ("healthy", "degraded", "circuit_open")

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def columns(text: str, **nested: T.DataType) -> T.StructType:
    """``"name type, name type"`` as a schema; it needs no session. ``nested`` adds other types."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(n, nested.get(n) or _TYPES[t]) for n, t in pairs])


SIGNALS = columns(
    "id string, schema_version int, source string, source_instance string, kind string, "
    "title string, content string, author string, url string, created_at timestamp, "
    "updated_at timestamp, collected_at timestamp, metadata_json string, event_hash string"
)
CHECKPOINTS = columns(
    "source_key string, cursor_json string, updated_at timestamp, last_success_at timestamp, "
    "last_error string"
)
SOURCE_HEALTH = columns(
    "source_key string, status string, updated_at timestamp, last_attempt_at timestamp, "
    "last_success_at timestamp, last_error string, consecutive_failures int, "
    "total_runs bigint, total_events bigint"
)
DELIVERY_SINKS = columns(
    "sink_key string, enabled boolean, created_at timestamp, updated_at timestamp"
)
DELIVERIES = columns(
    "sink_key string, event_id string, status string, attempts int, next_attempt_at timestamp, "
    "last_error string, delivered_at timestamp, updated_at timestamp"
)
RAW_PAYLOADS = columns(
    "payload_id bigint, batch_id bigint, source_type string, source string, "
    "source_instance string, url string, http_status int, headers map, body string, "
    "fetched_at timestamp, page_no int",
    headers=T.MapType(T.StringType(), T.StringType()),
)
RATE_LIMIT = columns(
    "limit bigint, remaining bigint, reset_at timestamp, retry_after double"
)
RUN_LOG = columns(
    "run_id bigint, source_key string, attempted_at timestamp, finished_at timestamp, "
    "success boolean, error_kind string, error string, event_count bigint, rate_limit struct",
    rate_limit=RATE_LIMIT,
)
DELIVERY_ATTEMPTS = columns(
    "seq bigint, sink_key string, event_id string, sent_hash string, attempted_at timestamp, "
    "outcome string, retry_after double, error string"
)
COMMITS = columns(
    "stream_id string, batch_id bigint, version bigint, committed_at timestamp"
)

TABLES: dict[str, T.StructType] = {
    "signals": SIGNALS,
    "checkpoints": CHECKPOINTS,
    "source_health": SOURCE_HEALTH,
    "delivery_sinks": DELIVERY_SINKS,
    "deliveries": DELIVERIES,
}

# Columns that must never be null, and the primary key of each table.
REQUIRED: dict[str, tuple[str, ...]] = {
    "signals": (
        "id", "schema_version", "source", "source_instance", "kind", "content", "url",
        "created_at", "collected_at", "metadata_json", "event_hash",
    ),
    "checkpoints": ("source_key", "cursor_json", "updated_at"),
    "source_health": (
        "source_key", "status", "updated_at", "consecutive_failures", "total_runs", "total_events",
    ),
    "delivery_sinks": ("sink_key", "enabled", "created_at", "updated_at"),
    "deliveries": ("sink_key", "event_id", "status", "attempts", "updated_at"),
}
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "signals": ("id",),
    "checkpoints": ("source_key",),
    "source_health": ("source_key",),
    "delivery_sinks": ("sink_key",),
    "deliveries": ("sink_key", "event_id"),
}
# Tables that ingestion keeps for itself: what a comment needs of its issue, and the comments that wait for one.
ISSUE_LINKS = columns(
    "source string, source_instance string, repository_url string, issue_number bigint, "
    "parent_event_id string, issue_url string, collected_at timestamp"
)
PARKED_COMMENTS = columns(
    "source string, source_instance string, repository_url string, issue_number bigint, "
    "id string, waits boolean"
)
LINK_KEYS = ("source", "source_instance", "repository_url", "issue_number")
SIDE_TABLES = {"issue_links": ISSUE_LINKS, "parked_comments": PARKED_COMMENTS}
SIDE_KEYS = {"issue_links": LINK_KEYS, "parked_comments": (*LINK_KEYS, "id")}
SIGNAL_COLUMNS = tuple(SIGNALS.fieldNames())
