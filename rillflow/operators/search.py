"""Lists, literal search, detail rows and short text views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.functions import ascii_lower, collapse, iso_utc, source_key, is_object
from rillflow.functions.text import strip

# Page bounds and the length of a content preview.
MAX_LIMIT = 200
MAX_OFFSET = 1_000_000
DEFAULT_LIMIT = 30
PREVIEW = 600
SEARCHED = ("title", "content", "author", "url")


def list_recent(
    signals: DataFrame,
    source: str | None = None,
    kind: str | None = None,
    instance: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Newest rows by creation, then collection; ``id`` settles ties."""
    rows = signals
    for column, value in (("source", source), ("kind", kind), ("source_instance", instance)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), F.desc("collected_at"), F.desc("id")).limit(max(0, limit))


def matches(query: str) -> Column:
    """Literal substring over the searched columns; A-Z match a-z and nothing else folds."""
    needle = ascii_lower(F.lit(query.strip()))
    hit = F.lit(False)
    for name in SEARCHED:
        hit = hit | F.coalesce(F.contains(ascii_lower(F.col(name)), needle), F.lit(False))
    return hit


def filtered(
    signals: DataFrame, query: str | None = None, source: str | None = None, kind: str | None = None
) -> DataFrame:
    rows = signals
    if source:
        rows = rows.filter(F.col("source") == source)
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if query and query.strip():
        rows = rows.filter(matches(query))
    return rows


def search(
    signals: DataFrame,
    query: str | None = None,
    source: str | None = None,
    kind: str | None = None,
    limit: int = DEFAULT_LIMIT,
    offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """One page, and its totals ``(total, limit, offset, has_more)``.

    The order is found on ids and times; only the rows of the page are then read whole. The totals read
    only the searched columns. A limit or offset out of bounds is an error.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit {limit} is not between 1 and {MAX_LIMIT}")
    if not 0 <= offset <= MAX_OFFSET:
        raise ValueError(f"offset {offset} is not between 0 and {MAX_OFFSET}")
    rows = filtered(signals, query, source, kind)
    newest = [F.desc("collected_at"), F.desc("created_at"), F.desc("id")]
    ids = rows.select("id", "collected_at", "created_at").orderBy(*newest).offset(offset).limit(limit)
    page = rows.join(ids.select("id"), "id", "left_semi").orderBy(*newest).limit(limit)
    total = F.count("*")
    totals = rows.agg(total.alias("total")).select(
        "total",
        F.lit(limit).alias("limit"),
        F.lit(offset).alias("offset"),
        (F.least(F.col("total"), F.lit(offset + limit)) < F.col("total")).alias("has_more"),
    )
    return page, totals


def _blank_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")).alias(name)


def _row(content: Column, truncated: Column) -> list[Column]:
    return [
        F.col("id"), F.col("schema_version"), F.col("source"), F.col("source_instance"),
        source_key(F.col("source"), F.col("source_instance")).alias("source_key"),
        F.col("kind"), _blank_null("title"), content.alias("content"),
        truncated.alias("content_truncated"), _blank_null("author"), F.col("url"),
        iso_utc(F.col("created_at")).alias("created_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"),
        iso_utc(F.col("collected_at")).alias("collected_at"),
    ]


def search_view(rows: DataFrame) -> DataFrame:
    """Result rows with a content preview."""
    content = F.coalesce("content", F.lit(""))
    return rows.select(*_row(F.substring(content, 1, PREVIEW), F.length(content) > PREVIEW))


def event_detail(signals: DataFrame, ids: DataFrame) -> DataFrame:
    """Full rows of the asked ids with their metadata as an object."""
    raw = F.coalesce(F.nullif(F.col("metadata_json"), F.lit("")), F.lit("{}"))
    v = F.try_parse_json(raw)
    wrapped = (
        F.when(v.isNull(), '{"_error":"stored metadata is not valid JSON"}')
        .when(is_object(v), F.to_json(v))
        .otherwise(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}")))
    )
    rows = signals.join(ids.select("id").distinct(), "id", "left_semi")
    content = F.coalesce("content", F.lit(""))
    return rows.select(*_row(content, F.lit(False)), wrapped.alias("metadata"))


def preview(rows: DataFrame) -> DataFrame:
    """One fixed-width line per event: source, kind, author and a short text."""
    text = collapse(F.coalesce(F.nullif("title", F.lit("")), F.nullif("content", F.lit("")), F.lit("")))
    short = F.when(F.length(text) > 48, F.concat(F.substring(text, 1, 45), F.lit("..."))).otherwise(text)
    key = source_key(F.col("source"), F.col("source_instance"))
    author = F.coalesce(F.nullif("author", F.lit("")), F.lit("-"))
    line = F.concat_ws(
        " ", F.rpad(key, 22, " "), F.rpad(F.col("kind"), 14, " "), F.rpad(author, 18, " "), short
    )
    return rows.select("id", short.alias("preview"), line.alias("line"))


def health_class(status: Column) -> Column:
    value = F.lower(F.coalesce(status, F.lit("")))
    return (
        F.when(value.isin("healthy", "success", "current", "enabled"), "healthy")
        .when(value.isin("failed", "error", "dead", "unhealthy", "disabled"), "danger")
        .otherwise("warning")
    )


def safe_link(url: Column) -> Column:
    """The URL if its scheme is http or https, else null."""
    return F.when(strip(url).rlike(r"(?i)^https?://[^\s/]"), strip(url))


def banner(
    health: DataFrame, sink_snapshot: DataFrame, schema_status: str = "current"
) -> DataFrame:
    """One row: the overall level and the counts behind it."""
    bad = health_class(F.col("status")) != "healthy"
    sources = health.agg(
        F.count("*").alias("sources"),
        F.count_if(bad).alias("unhealthy"),
        F.count_if(health_class(F.col("status")) == "danger").alias("danger"),
    )
    backlog = sink_snapshot.agg(F.coalesce(F.sum(F.col("failed") + F.col("dead")), F.lit(0)).alias("x"))
    current = schema_status == "current"
    waiting = F.col("delivery_attention")
    level = (
        F.when(F.lit(not current) | (F.col("danger") > 0), "danger")
        .when((waiting > 0) | (F.col("unhealthy") > 0) | (F.col("sources") == 0), "warning")
        .otherwise("healthy")
    )
    return sources.withColumn("delivery_attention", backlog.scalar()).select(
        level.alias("level"),
        (F.col("sources") - F.col("unhealthy")).alias("healthy_sources"),
        "sources", "delivery_attention",
    )


def attention(
    health: DataFrame, sink_snapshot: DataFrame, schema_status: str = "current"
) -> DataFrame:
    """Open issues in order: layout, the first three unhealthy sources, delivery backlog; one row that says so if none."""
    cls = health_class(F.col("status"))
    sources = (
        health.filter(cls != "healthy").orderBy("source_key").limit(3)
        .select(
            F.lit(2).alias("position"),
            F.col("source_key").alias("title"),
            F.coalesce("last_error", F.concat(F.lit("Last seen as "), "status", F.lit("."))).alias("detail"),
            cls.alias("level"),
        )
    )
    total = sink_snapshot.agg(F.coalesce(F.sum(F.col("failed") + F.col("dead")), F.lit(0)).alias("n"))
    layout = total.select(
        F.lit(1).alias("position"), F.lit("Table layout").alias("title"),
        F.lit(f"The tables are {schema_status}; check them before the next run").alias("detail"),
        F.lit("danger").alias("level"),
    ).filter(F.lit(schema_status != "current"))
    backlog = total.filter("n > 0").select(
        F.lit(3).alias("position"), F.lit("Undelivered events").alias("title"),
        F.concat(F.col("n").cast("string"), F.lit(" deliveries failed or were given up")).alias("detail"),
        F.lit("danger").alias("level"),
    )
    issues = layout.unionByName(sources).unionByName(backlog)
    none = issues.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit(0).alias("position"), F.lit("Nothing open").alias("title"),
        F.lit("Tables, sources and deliveries are as they should be").alias("detail"), F.lit("healthy").alias("level"),
    )
    return issues.unionByName(none)
