"""The provided tables seen as signals, logs, polls and payloads.

Each view here has a twin in :mod:`rillflow.catalog.twins`, the same rows in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import fingerprint, source_key, stable_id
from rillflow.schemas import KINDS, SIGNAL_COLUMNS, SIGNALS

EPOCH = "2024-01-01 00:00:00"
PAGE = 20
POLL = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def plus(base: str, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts(base)) + seconds)


def doc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 without identity: documents as the fields of signals."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.lit(1).alias("schema_version"),
        F.col("source"),
        F.col("lang").alias("source_instance"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), (d % 7 + 1).cast("int")).alias("kind"),
        d.cast("string").alias("external_id"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("content"),
        F.when(d % 5 != 0, F.concat(F.lit("author-"), (d % 97).cast("string"))).alias("author"),
        F.concat_ws("/", F.lit("https://docs.example.org"), "source", d.cast("string")).alias("url"),
        plus(EPOCH, d * 37).alias("created_at"),
        F.when(d % 3 != 0, plus(EPOCH, d * 37 + 86400)).alias("updated_at"),
        plus("2024-02-01 00:00:00", d).alias("collected_at"),
        F.to_json(F.struct("lang", "n_chars")).alias("metadata_json"),
    )


def doc_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: documents as signals, with ``doc_id`` as the arrival order."""
    return doc_fields(spark, sf_dir).select(
        stable_id(F.col("source"), F.col("external_id"), F.col("kind"), F.col("source_instance")).alias("id"),
        *[c for c in SIGNAL_COLUMNS if c not in ("id", "event_hash")],
        fingerprint().alias("event_hash"),
        F.col("doc_id").alias("seq"),
    )


def stored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as already stored; those of low quality with an older text."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality")
    old = F.col("quality") == 0
    rows = doc_signals(spark, sf_dir).join(labels, "seq")
    return rows.select(
        *[
            F.when(old, F.lit("older text")).otherwise(F.col("content")).alias("content")
            if c == "content"
            else F.when(old, F.sha2(F.concat(F.lit("older "), "id"), 256)).otherwise(F.col(c)).alias(c)
            if c == "event_hash"
            else (F.col(c) - F.expr("INTERVAL 7 DAYS")).alias(c)
            if c == "collected_at"
            else F.col(c)
            for c in SIGNAL_COLUMNS
        ]
    )


def doc_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sink per region; the one in Asia is disabled."""
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("sink-"), F.lower("r_name")).alias("sink_key"),
        (F.col("r_name") != "ASIA").alias("enabled"),
        ts(EPOCH).alias("created_at"), ts(EPOCH).alias("updated_at"),
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: every event as a write to the object of its type and user; repeats occur."""
    fields = table(spark, sf_dir, "events").select(
        F.lit(1).alias("schema_version"),
        F.lit("events").alias("source"),
        F.col("event_type").alias("source_instance"),
        F.lit("other").alias("kind"),
        F.col("user_id").cast("string").alias("external_id"),
        F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("bucket "), F.floor(F.col("value") / 10).cast("string")).alias("content"),
        F.lit(None).cast("string").alias("author"),
        F.concat(F.lit("https://events.example.org/"), F.col("user_id").cast("string")).alias("url"),
        ts(EPOCH).alias("created_at"),
        F.lit(None).cast("timestamp").alias("updated_at"),
        F.col("ts").cast("timestamp").alias("collected_at"),
        F.lit("{}").alias("metadata_json"),
        F.col("event_id").alias("seq"),
    )
    return fields.select(
        stable_id(F.col("source"), F.col("external_id"), F.col("kind"), F.col("source_instance")).alias("id"),
        *[c for c in SIGNAL_COLUMNS if c not in ("id", "event_hash")],
        fingerprint().alias("event_hash"),
        "seq",
    )


def no_signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SIGNALS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: events as source runs; errors are failed runs."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    failed = F.col("event_type") == "error"
    done = F.col("ts").cast("timestamp") + F.expr("INTERVAL 2 SECONDS")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source_key"),
        F.col("ts").cast("timestamp").alias("attempted_at"),
        done.alias("finished_at"),
        (~failed).alias("success"),
        F.when(failed, F.when(F.col("user_id") % 3 == 0, "rate_limit").otherwise("http")).alias("error_kind"),
        F.when(failed, F.concat(F.lit("failed run "), F.col("event_id").cast("string"))).alias("error"),
        k.alias("event_count"),
        F.struct(
            F.lit(100).cast("bigint").alias("limit"),
            (k % 3).alias("remaining"),
            (done + F.make_dt_interval(secs=k)).alias("reset_at"),
            F.when(k % 5 == 0, (k * 2).cast("double")).alias("retry_after"),
        ).alias("rate_limit"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: turns as children of their conversation."""
    return table(spark, sf_dir, "conversations").select(
        F.lit("chat:default").alias("source_key"),
        F.col("conv_id").alias("parent_id"),
        F.col("turn").alias("pos"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("child_id"),
        plus(EPOCH, F.col("conv_id") * 60 + F.col("turn")).alias("created_at"),
        "role", "text",
    )


def attempt_seq() -> Column:
    """Unique per order and flag: day of shipping, part, line."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("bigint")
    return days * 100_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: line items as delivery attempts of an order at the sink of their flag."""
    q = F.col("l_quantity")
    good = F.col("l_linestatus") == "O"
    outcome = F.when(good, "success").when(q < 5, "permanent").when(q < 10, "missing").otherwise("retryable")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sink-"), "l_returnflag").alias("sink_key"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("event_id"),
        attempt_seq().alias("seq"),
        outcome.alias("outcome"),
        F.when(F.col("l_discount") < 0.02, "v0").otherwise("v1").alias("sent_hash"),
        F.when(F.col("l_linenumber") == 3, q).alias("retry_after"),
        F.when(~good, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).alias("error"),
        F.col("l_shipdate").cast("timestamp").alias("attempted_at"),
    )


def queue_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order of a flag is queued at first; a line with a 0.05 discount queues it again."""
    again = F.col("l_discount") == 0.05
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sink-"), "l_returnflag").alias("sink_key"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("event_id"),
        F.lit("v1").alias("event_hash"),
        F.when(again, attempt_seq()).otherwise(0).alias("seq"),
        F.when(again, F.col("l_shipdate").cast("timestamp")).otherwise(ts("1995-01-01 00:00:00")).alias("at"),
    )


def _sink_of_priority() -> Column:
    return F.concat(F.lit("sink-"), F.substring("o_orderpriority", 1, 1))


def _order_id() -> Column:
    return F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))


def _prior() -> Column:
    """Attempts before the pass: none for pending rows."""
    return F.when(F.col("o_orderstatus") == "O", 0).otherwise((F.col("o_orderkey") % 9).cast("int"))


def pass_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the delivery rows a pass starts from, one sink per priority.

    Open orders are pending, processed ones failed, filled ones dead or delivered.
    """
    s, at = F.col("o_orderstatus"), F.col("o_orderdate").cast("timestamp")
    done = F.when(F.col("o_custkey") % 2 == 0, "dead").otherwise("delivered")
    status = F.when(s == "O", "pending").when(s == "P", "failed").otherwise(done)
    bad = F.concat(F.lit("HTTP "), (500 + F.col("o_orderkey") % 5).cast("string"))
    return table(spark, sf_dir, "orders").withColumn("s", status).select(
        _sink_of_priority().alias("sink_key"),
        _order_id().alias("event_id"),
        F.col("s").alias("status"),
        _prior().alias("attempts"),
        F.when(F.col("s") == "failed", at + F.expr("INTERVAL 30 DAYS")).alias("next_attempt_at"),
        F.when(F.col("s").isin("failed", "dead"), bad).alias("last_error"),
        F.when(F.col("s") == "delivered", at).alias("delivered_at"),
        at.alias("updated_at"),
    )


def _is_gone() -> Column:
    return (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")


def order_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current versions of the orders; processed low-priority ones are gone, some have changed."""
    return table(spark, sf_dir, "orders").filter(~_is_gone()).select(
        _order_id().alias("id"),
        F.when(F.col("o_orderkey") % 11 == 0, "v2").otherwise("v1").alias("event_hash"),
    )


def pass_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One send per pending or failed order."""
    c = F.col("o_custkey") % 5
    outcome = F.when(c < 2, "success").when(c == 2, "permanent").otherwise("retryable")
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P")).select(
        _sink_of_priority().alias("sink_key"),
        _order_id().alias("event_id"),
        F.when(_is_gone(), "missing").otherwise(outcome).alias("outcome"),
        F.lit("v1").alias("sent_hash"),
        _prior().alias("prior_attempts"),
        F.when(F.col("o_orderkey") % 6 == 0, (F.col("o_orderkey") % 5000).cast("double")).alias("retry_after"),
        F.concat(F.lit("send "), "o_orderpriority").alias("error"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 60 DAYS")).alias("attempted_at"),
    )


# Response statuses the request log cycles through.
STATUSES = (200, 204, 304, 401, 403, 404, 408, 425, 429, 500, 503, 599)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: orders as logged requests with the headers a server may send."""
    o = F.col("o_orderkey")

    def header(when: Column, name: str, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("k"), value.cast("string").alias("v")))

    pairs = F.array_compact(
        F.array(
            header(o % 2 == 0, "X-RateLimit-Limit", F.lit(60)),
            header(o % 3 == 0, "X-RateLimit-Remaining", o % 4),
            header(o % 4 == 0, "X-RateLimit-Reset", 1_700_000_000 + o % 1000),
            header(o % 5 == 0, "RateLimit-Reset", o % 120),
            header(o % 6 == 0, "ratelimit-remaining", o % 2),
            header(o % 7 == 0, "retry-after", o % 15 - 2),
        )
    )
    failure = F.when(o % 13 == 0, "timeout").when(o % 17 == 0, "network")
    return table(spark, sf_dir, "orders").select(
        o.alias("request_id"),
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("source_key"),
        F.concat(F.lit("https://api.example.org/"), o.cast("string")).alias("url"),
        F.when(failure.isNull(), F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (o % 12 + 1).cast("int"))).alias("status"),
        F.map_from_entries(pairs).alias("headers"),
        failure.alias("failure"),
        (o % 5 + 1).cast("int").alias("attempt"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.repeat(F.concat("o_orderpriority", F.lit(" ")), 40).alias("body"),
    )


def poll_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: documents as poll items of their source, in polls of up to 500 ids."""
    return table(spark, sf_dir, "documents").select(
        source_key(F.col("source"), F.col("lang")).alias("source_key"),
        F.floor(F.col("doc_id") / POLL).alias("poll_id"),
        (F.col("doc_id") % POLL).alias("pos"),
        F.col("doc_id").cast("string").alias("external_id"),
        plus(EPOCH, F.col("doc_id") * 37).alias("created_at"),
        F.when(F.col("doc_id") % 3 != 0, plus(EPOCH, F.col("doc_id") * 37 + 86400)).alias("updated_at"),
    )


def seen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as ids seen before, the lowest id being the newest."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select(
        source_key(F.col("source"), F.col("lang")).alias("source_key"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.col("doc_id").alias("rank"), "quality", "toxic",
    )


def paged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of a run: ten pages per run, the user decides how full a page is."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.lit("events:paged").alias("source_key"),
        F.floor(e / 10).alias("run_id"),
        (e % 10 + 1).alias("page_no"),
        F.when(k < 3, 0).otherwise(k).alias("primary_count"),
        ((F.col("event_type") != "signup") & (e % 10 != 9)).alias("has_more"),
        F.concat(F.lit("c"), F.when(k % 11 == 0, F.lit(0)).otherwise(e).cast("string")).alias("cursor_json"),
        F.lit("c0").alias("start_cursor"),
    )
