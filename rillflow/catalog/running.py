"""Queries on delivery, health and request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.catalog import views as v
from rillflow.catalog.twins import EVENT_JSON, iso, iso_micros, with_parts
from rillflow.functions import age_text, iso_utc
from rillflow.operators import delivery as dl
from rillflow.operators import health as he
from rillflow.operators import outbox as ob
from rillflow.operators import reports as rp
from rillflow.operators import requests as rq
from rillflow.operators import search as se
from rillflow.operators import sinks as sk
from rillflow.operators.changes import classify_changes

NOW = "1998-06-01 00:00:00"
PROM_NOW = "2024-02-01 00:00:00"


def _view(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        "sink_key", "event_id", "status", "attempts",
        iso_utc(F.col("next_attempt_at")).alias("next_attempt_at"), "last_error",
        iso_utc(F.col("delivered_at")).alias("delivered_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"), *extra,
    )


_VIEW = (
    "sink_key, event_id, status, attempts, " + iso("next_attempt_at") + " AS next_attempt_at, last_error, "
    + iso("delivered_at") + " AS delivered_at, " + iso("updated_at") + " AS updated_at"
)


def folded(spark, sf) -> DataFrame:
    return dl.fold_deliveries(v.queue_log(spark, sf), v.attempts(spark, sf))


def outcomes(spark, sf) -> DataFrame:
    return dl.apply_outcomes(v.pass_deliveries(spark, sf), v.pass_attempts(spark, sf), v.order_signals(spark, sf))


def fold_sinks(spark, sf) -> DataFrame:
    """A sink per flag found in the data and one that never got anything."""
    flags = v.table(spark, sf, "lineitem").select(F.concat(F.lit("sink-"), "l_returnflag").alias("sink_key")).distinct()
    empty = v.table(spark, sf, "region").select(F.lit("sink-empty").alias("sink_key")).distinct()
    return flags.unionByName(empty).select("sink_key", (F.col("sink_key") != "sink-R").alias("enabled"))


def snapshot(spark, sf) -> DataFrame:
    return rp.sink_snapshot(fold_sinks(spark, sf), folded(spark, sf))


def replayed(spark, sf):
    table, _ = ob.replay_dead(v.pass_deliveries(spark, sf), v.ts(NOW))
    return _view(table)


def replay_counts(spark, sf):
    return ob.replay_dead(folded(spark, sf), v.ts(NOW))[1]


def ready(spark, sf):
    rows = dl.ready(v.pass_deliveries(spark, sf), v.ts(NOW), 100)
    return rows.select("sink_key", "event_id", F.col("position").cast("int").alias("position"))


def gone_events(spark, sf):
    rows = dl.ready(v.pass_deliveries(spark, sf), v.ts(NOW), 1000)
    matched = dl.match_events(rows, v.order_signals(spark, sf))
    return matched.groupBy("sink_key").agg(
        F.count("*").alias("read_rows"), F.count_if(F.col("event_hash").isNull()).alias("gone")
    )


def responses(spark, sf) -> DataFrame:
    r = v.requests(spark, sf).withColumn("retry_after_text", F.col("headers")["retry-after"])
    return sk.classify_responses(r).select("request_id", "outcome", "retry_after", "error")


def webhooks(spark, sf):
    reqs = sk.webhook_requests(v.doc_signals(spark, sf), "brain", token="t")
    h = F.col("headers")
    return reqs.select(
        "event_id", "sent_hash", h["Idempotency-Key"].alias("idem"), h["Authorization"].alias("auth"),
        h["Content-Type"].alias("kind"), h["X-Event-Hash"].alias("hash_header"), "body",
    )


def run_states(spark, sf):
    out = he.run_outcomes(v.runs(spark, sf))
    return out.select("run_id", "source_key", F.col("failures").cast("bigint").alias("failures"), "status",
                      F.round("delay", 6).alias("delay"))


def health(spark, sf) -> DataFrame:
    return he.fold_health(v.runs(spark, sf))


def health_view(spark, sf):
    return health(spark, sf).select(
        "source_key", "status", iso_utc(F.col("updated_at")).alias("updated_at"),
        iso_utc(F.col("last_attempt_at")).alias("last_attempt_at"),
        iso_utc(F.col("last_success_at")).alias("last_success_at"),
        "last_error", "consecutive_failures", "total_runs", "total_events",
    )


def health_resumed(spark, sf):
    """The log cut at the middle of the month and folded in two steps ends like one fold."""
    log = v.runs(spark, sf)
    early = he.fold_health(log.filter(F.col("attempted_at") < v.ts("2024-01-15 00:00:00")))
    late = he.fold_health(log.filter(F.col("attempted_at") >= v.ts("2024-01-15 00:00:00")), early)
    return he.apply_health(early, late).select(
        "source_key", "status", "consecutive_failures", "total_runs", "total_events", "last_error",
        iso_utc(F.col("last_success_at")).alias("last_success_at"),
    )


def cycle_success(spark, sf):
    return he.run_success(v.runs(spark, sf), dl.pass_summary(outcomes(spark, sf)))


def judged(spark, sf):
    return rq.judge_requests(v.requests(spark, sf)).select(
        "request_id", "error_kind", "retryable", "gives_up", "retry_delay"
    )


def limits(spark, sf):
    r = rq.add_rate_limit(v.requests(spark, sf)).withColumnRenamed("rate_limit", "rl")
    return r.select(
        "request_id", F.col("rl").isNotNull().alias("has_limit"),
        F.col("rl.limit").alias("limit_n"), F.col("rl.remaining").alias("remaining"),
        iso_utc(F.col("rl.reset_at")).alias("reset_at"), F.col("rl.retry_after").alias("retry_after"),
    )


def forum_limits(spark, sf):
    r = rq.add_rate_limit(v.requests(spark, sf), forum=True).withColumnRenamed("rate_limit", "rl")
    return r.select(
        "request_id", F.col("rl.limit").alias("limit_n"), F.col("rl.remaining").alias("remaining"),
        F.unix_timestamp("rl.reset_at").alias("reset_epoch"), F.col("rl.retry_after").alias("retry_after"),
    )


def deadlines(spark, sf):
    j = rq.judge_requests(v.requests(spark, sf)).filter("retry_delay IS NOT NULL")
    fits = rq.has_time_left(F.col("at"), F.col("at") + F.make_dt_interval(secs=F.col("request_id") % 3), F.col("retry_delay"))
    return j.select("request_id", fits.alias("fits"))


def records(spark, sf):
    e = rq.error_records(rq.judge_requests(v.requests(spark, sf)))
    return e.select(
        "request_id", "message", "kind", "retryable", "status_code",
        F.length(F.get_json_object("details", "$.response_preview")).alias("preview_chars"),
    )


def counts_by_status(spark, sf):
    return rp.delivery_counts(folded(spark, sf))


def counts_of_sink(spark, sf):
    return rp.delivery_counts(folded(spark, sf), "sink-A")


def last_failures(spark, sf):
    return rp.last_failures(folded(spark, sf)).select(
        "sink_key", iso_utc(F.col("last_failure_at")).alias("last_failure_at"), "last_error"
    )


def snapshot_view(spark, sf):
    return snapshot(spark, sf).select(
        "sink_key", "enabled", "pending", "failed", "dead", "delivered", "attempts",
        iso_utc(F.col("last_failure_at")).alias("last_failure_at"), "last_error",
    )


def prom(spark, sf):
    return rp.prometheus_lines(v.doc_signals(spark, sf), health(spark, sf), snapshot(spark, sf))


def overview(spark, sf):
    return rp.overview(
        v.doc_signals(spark, sf), health(spark, sf), fold_sinks(spark, sf), folded(spark, sf), v.ts("2024-02-01 00:10:00")
    )


def banner(spark, sf):
    return se.banner(health(spark, sf), snapshot(spark, sf))


def attention(spark, sf):
    return se.attention(health(spark, sf), snapshot(spark, sf), "migration_required")


def summary(spark, sf):
    pages = v.paged_events(spark, sf).withColumn("warnings", F.col("has_more").cast("int")).withColumn(
        "rate_limit", F.when(F.col("primary_count") % 2 == 0, F.struct(F.col("primary_count").alias("remaining")))
    )
    changes = classify_changes(v.mutations(spark, sf), v.no_signals(spark)).select(
        F.lit("events:paged").alias("source_key"), F.floor(F.col("seq") / 10).alias("run_id"), "change"
    )
    return rp.collection_summary(pages, changes).select(
        "source_key", "run_id", "pages", "primary_count", "events", "inserted", "updated", "unchanged",
        "warnings", F.col("rate_limit.remaining").alias("remaining"),
    )


_LAST_FAIL = """last_fail AS (SELECT sink_key, updated_at, last_error FROM (SELECT *, row_number() OVER
  (PARTITION BY sink_key ORDER BY updated_at DESC, event_id DESC) AS rn FROM deliveries
  WHERE status IN ('failed', 'dead') AND last_error IS NOT NULL) WHERE rn = 1)"""
_SNAP = """snap AS (SELECT s.sink_key, s.enabled,
  count(*) FILTER (WHERE d.status = 'pending') AS pending, count(*) FILTER (WHERE d.status = 'failed') AS failed,
  count(*) FILTER (WHERE d.status = 'dead') AS dead, count(*) FILTER (WHERE d.status = 'delivered') AS delivered,
  CAST(coalesce(sum(d.attempts), 0) AS BIGINT) AS attempts
  FROM fold_sinks s LEFT JOIN deliveries d USING (sink_key) GROUP BY 1, 2)"""


def _prom_sql() -> str:
    def family(section: int, start: int, rows: list[tuple[str, str, str]]) -> str:
        lines = []
        for name, text, kind in rows:
            lines += [f"# HELP rillflow_{name} {text}", f"# TYPE rillflow_{name} {kind}"]
        return ", ".join(f"({section}, '', {start + i}, '{x}')" for i, x in enumerate(lines))

    head = [
        (0, "'# HELP rillflow_signals_total Events held in the current state of the store.'"),
        (1, "'# TYPE rillflow_signals_total gauge'"),
        (2, "'rillflow_signals_total ' || (SELECT count(*) FROM documents)"),
        (3, "'# HELP rillflow_database_schema_version Layout number that the stored tables carry.'"),
        (4, "'# TYPE rillflow_database_schema_version gauge'"),
        (5, "'rillflow_database_schema_version 1'"),
        (6, "'# HELP rillflow_database_schema_supported_version Highest layout number this code can read.'"),
        (7, "'# TYPE rillflow_database_schema_supported_version gauge'"),
        (8, "'rillflow_database_schema_supported_version 1'"),
        (9, "'# HELP rillflow_database_schema_current 1 if the tables have the layout this code writes, else 0.'"),
        (10, "'# TYPE rillflow_database_schema_current gauge'"),
        (11, "'rillflow_database_schema_current 1'"),
    ]
    first = " UNION ALL ".join(f"SELECT 0 AS section, '' AS key, {i} AS item, {x} AS line" for i, x in head)
    rest = family(0, 12, [
        ("source_status", "1 for the state a source is in.", "gauge"),
        ("source_consecutive_failures", "Failed runs of a source since its last good one.", "gauge"),
        ("source_runs_total", "Runs of a source on record.", "counter"),
        ("source_events_total", "Events that the runs of a source brought.", "counter"),
    ])
    middle = family(2, 0, [
        ("sink_enabled", "1 while a sink takes events, else 0.", "gauge"),
        ("deliveries", "Rows of the delivery table, by sink and state.", "gauge"),
        ("delivery_attempts_total", "Sends tried for a sink on record.", "counter"),
    ])
    src = [
        "'rillflow_source_status{source=\"' || source_key || '\",status=\"' || status || '\"} 1'",
        "'rillflow_source_consecutive_failures{source=\"' || source_key || '\"} ' || consecutive_failures",
        "'rillflow_source_runs_total{source=\"' || source_key || '\"} ' || total_runs",
        "'rillflow_source_events_total{source=\"' || source_key || '\"} ' || total_events",
    ]
    snk = ["'rillflow_sink_enabled{sink=\"' || sink_key || '\"} ' || CAST(enabled AS INTEGER)"]
    snk += [
        f"'rillflow_deliveries{{sink=\"' || sink_key || '\",status=\"{s}\"}} ' || {s}"
        for s in ("pending", "failed", "dead", "delivered")
    ]
    snk += ["'rillflow_delivery_attempts_total{sink=\"' || sink_key || '\"} ' || attempts"]
    parts = [first, f"SELECT * FROM (VALUES {rest}) a(section, key, item, line)"]
    parts += [f"SELECT * FROM (VALUES {middle}) b(section, key, item, line)"]
    parts += [f"SELECT 1, source_key, {i}, {x} FROM health" for i, x in enumerate(src)]
    parts += [f"SELECT 3, sink_key, {i}, {x} FROM snap" for i, x in enumerate(snk)]
    return with_parts("health deliveries fold_sinks", f", {_SNAP} " + " UNION ALL ".join(parts))


_OUT_VIEW = f"""SELECT sink_key, event_id,
  CASE WHEN moved THEN result ELSE status END AS status, CAST(attempts + CASE WHEN moved THEN 1 ELSE 0 END AS INTEGER) AS attempts,
  CASE WHEN NOT moved THEN {iso('next_attempt_at')} WHEN result = 'failed' THEN {iso('due')} END AS next_attempt_at,
  CASE WHEN NOT moved THEN last_error WHEN result <> 'delivered' THEN
    CASE WHEN outcome = 'missing' THEN 'event no longer exists' ELSE error END END AS last_error,
  CASE WHEN moved AND result = 'delivered' THEN {iso('attempted_at')} ELSE {iso('delivered_at')} END AS delivered_at,
  CASE WHEN moved THEN {iso('attempted_at')} ELSE {iso('updated_at')} END AS updated_at, result
  FROM (SELECT *, coalesce(result IN ('delivered', 'dead', 'failed'), false) AS moved,
    attempted_at + to_seconds(CAST(CASE WHEN retry_after IS NOT NULL THEN least(greatest(retry_after, 0), 3600) ELSE least(5 * pow(2, prior), 3600) END AS BIGINT)) AS due
    FROM outcomes)"""

QUERIES = {
    "ready_deliveries": (
        ready,
        with_parts("pass", f"""SELECT sink_key, event_id, CAST(rn AS INTEGER) AS position FROM (
          SELECT *, row_number() OVER (PARTITION BY sink_key ORDER BY updated_at, event_id) AS rn FROM pass_deliveries
          WHERE status IN ('pending', 'failed') AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}')) WHERE rn <= 100"""),
    ),
    "ready_without_event": (
        gone_events,
        with_parts("pass", f"""SELECT sink_key, count(*) AS read_rows, count(*) FILTER (WHERE s.id IS NULL) AS gone FROM (
          SELECT *, row_number() OVER (PARTITION BY sink_key ORDER BY updated_at, event_id) AS rn FROM pass_deliveries
          WHERE status IN ('pending', 'failed') AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '{NOW}')) d
          LEFT JOIN order_signals s ON s.id = d.event_id WHERE rn <= 1000 GROUP BY 1"""),
    ),
    "delivery_outcomes": (lambda s, d: _view(outcomes(s, d), "result"), with_parts("pass", _OUT_VIEW)),
    "delivery_pass_summary": (
        lambda s, d: dl.pass_summary(outcomes(s, d)),
        with_parts("pass", """SELECT sink_key, count(*) AS attempted, count(*) FILTER (WHERE result = 'delivered') AS delivered,
          count(*) FILTER (WHERE result = 'failed') AS failed, count(*) FILTER (WHERE result = 'dead') AS dead,
          count(*) FILTER (WHERE result = 'superseded') AS superseded FROM outcomes WHERE result IS NOT NULL GROUP BY 1"""),
    ),
    "delivery_fold": (lambda s, d: _view(folded(s, d)), with_parts("deliveries", f"SELECT {_VIEW} FROM deliveries")),
    "delivery_lookup": (
        lambda s, d: _view(dl.get_delivery(folded(s, d), "sink-A", "order-1")),
        with_parts("deliveries", f"SELECT {_VIEW} FROM deliveries WHERE sink_key = 'sink-A' AND event_id = 'order-1'"),
    ),
    "dead_replay": (
        replayed,
        with_parts("pass", f"""SELECT sink_key, event_id, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status,
          CASE WHEN status = 'dead' THEN 0 ELSE attempts END AS attempts,
          CASE WHEN status <> 'dead' THEN {iso('next_attempt_at')} END AS next_attempt_at,
          CASE WHEN status <> 'dead' THEN last_error END AS last_error,
          CASE WHEN status <> 'dead' THEN {iso('delivered_at')} END AS delivered_at,
          CASE WHEN status = 'dead' THEN '1998-06-01T00:00:00+00:00' ELSE {iso('updated_at')} END AS updated_at
          FROM pass_deliveries"""),
    ),
    "dead_replay_counts": (
        replay_counts,
        with_parts("deliveries", "SELECT sink_key, count(*) FILTER (WHERE status = 'dead') AS replayed FROM deliveries GROUP BY 1"),
    ),
    "response_classes": (
        responses,
        with_parts("requests", """SELECT request_id,
          CASE WHEN failure IS NOT NULL THEN 'retryable' WHEN status BETWEEN 200 AND 299 THEN 'success'
            WHEN status IN (408,425,429,500,502,503,504) THEN 'retryable' ELSE 'permanent' END AS outcome,
          CASE WHEN failure IS NULL AND NOT status BETWEEN 200 AND 299 THEN wait END AS retry_after,
          CASE WHEN failure IS NOT NULL THEN 'webhook network error: ' || failure
            WHEN NOT status BETWEEN 200 AND 299 THEN 'webhook HTTP ' || status END AS error FROM requests"""),
    ),
    "webhook_requests": (
        webhooks,
        with_parts("sig", f"""SELECT id AS event_id, event_hash AS sent_hash,
          'rillflow:' || substr(sha256('brain' || chr(31) || id || chr(31) || event_hash), 1, 32) AS idem,
          'Bearer t' AS auth, 'application/json' AS kind, event_hash AS hash_header, {EVENT_JSON} AS body FROM sig"""),
    ),
    "run_outcomes": (
        run_states,
        with_parts("runs", "SELECT run_id, source_key, failures, status, round(delay, 6) AS delay FROM run_outcomes"),
    ),
    "source_health": (
        health_view,
        with_parts("health", f"""SELECT source_key, status, {iso_micros('updated_at')} AS updated_at,
          {iso_micros('last_attempt_at')} AS last_attempt_at, {iso_micros('last_success_at')} AS last_success_at,
          last_error, CAST(consecutive_failures AS INTEGER) AS consecutive_failures, total_runs, total_events FROM health"""),
    ),
    "source_health_resumed": (
        health_resumed,
        with_parts("health", f"""SELECT source_key, status, CAST(consecutive_failures AS INTEGER) AS consecutive_failures,
          total_runs, total_events, last_error, {iso_micros('last_success_at')} AS last_success_at FROM health"""),
    ),
    "cycle_success": (
        cycle_success,
        with_parts("pass", """SELECT (SELECT bool_and(event_type <> 'error') FROM events)
          AND (SELECT coalesce(bool_and(result NOT IN ('failed', 'dead')), true) FROM outcomes WHERE result IS NOT NULL) AS success"""),
    ),
    "request_verdicts": (
        judged,
        with_parts("requests", "SELECT request_id, kind AS error_kind, retryable, gives_up, retry_delay FROM judged"),
    ),
    "rate_limit_headers": (
        limits,
        with_parts("requests", f"""SELECT request_id,
          x_limit IS NOT NULL OR r IS NOT NULL OR x_reset IS NOT NULL OR rel_reset IS NOT NULL OR wait IS NOT NULL AS has_limit,
          CAST(x_limit AS BIGINT) AS limit_n, CAST(r AS BIGINT) AS remaining,
          {iso('coalesce(make_timestamp(x_reset * 1000000), asked_at + to_seconds(rel_reset))')} AS reset_at,
          coalesce(wait, CASE WHEN r = 0 THEN CAST(rel_reset AS DOUBLE) END) AS retry_after
          FROM (SELECT *, coalesce(x_remaining, remaining2) AS r FROM requests)"""),
    ),
    "forum_rate_limit": (
        forum_limits,
        with_parts("requests", """SELECT request_id, CAST(x_limit AS BIGINT) AS limit_n, CAST(x_remaining AS BIGINT) AS remaining,
          CAST(epoch(asked_at) AS BIGINT) + x_reset AS reset_epoch,
          coalesce(wait, CASE WHEN x_remaining = 0 THEN CAST(x_reset AS DOUBLE) END) AS retry_after FROM requests"""),
    ),
    "retry_deadlines": (
        deadlines,
        with_parts("requests", """SELECT request_id, request_id % 3 > 0 AND retry_delay < request_id % 3 AS fits
          FROM judged WHERE retry_delay IS NOT NULL"""),
    ),
    "error_records": (
        records,
        with_parts("requests", """SELECT request_id,
          CASE WHEN failure = 'timeout' THEN 'request timed out after ' || attempt || ' attempts: ' || url
            WHEN failure = 'network' THEN 'network request failed after ' || attempt || ' attempts: ' || url
            ELSE 'HTTP ' || status || ' for ' || url END AS message,
          kind, retryable, status AS status_code,
          CASE WHEN failure IS NULL THEN CAST(length(substr(body, 1, 300)) AS INTEGER) END AS preview_chars FROM judged WHERE gives_up"""),
    ),
    "delivery_counts": (
        counts_by_status,
        with_parts("deliveries", """SELECT status, count(*) AS total FROM deliveries GROUP BY 1
          UNION ALL SELECT 'total', count(*) FROM deliveries"""),
    ),
    "delivery_counts_sink": (
        counts_of_sink,
        with_parts("deliveries", """SELECT status, count(*) AS total FROM deliveries WHERE sink_key = 'sink-A' GROUP BY 1
          UNION ALL SELECT 'total', count(*) FROM deliveries WHERE sink_key = 'sink-A'"""),
    ),
    "sink_last_failures": (
        last_failures,
        with_parts("deliveries", f", {_LAST_FAIL} SELECT sink_key, {iso('updated_at')} AS last_failure_at, last_error FROM last_fail"),
    ),
    "sink_snapshot": (
        snapshot_view,
        with_parts("deliveries fold_sinks", f", {_LAST_FAIL}, {_SNAP} SELECT s.*, {iso('f.updated_at')} AS last_failure_at, f.last_error "
          "FROM snap s LEFT JOIN last_fail f USING (sink_key)"),
    ),
    "sink_status_lines": (
        lambda s, d: rp.sink_lines(snapshot(s, d)),
        with_parts("deliveries fold_sinks", f""", {_SNAP} SELECT sink_key, rpad(sink_key, 24, ' ') || ' ' || rpad(CAST(enabled AS VARCHAR), 8, ' ')
          || ' ' || rpad(CAST(pending AS VARCHAR), 8, ' ') || ' ' || rpad(CAST(failed AS VARCHAR), 8, ' ')
          || ' ' || rpad(CAST(dead AS VARCHAR), 8, ' ') || ' ' || rpad(CAST(delivered AS VARCHAR), 10, ' ')
          || ' ' || rpad(CAST(attempts AS VARCHAR), 8, ' ') AS line FROM snap"""),
    ),
    "sink_status_json": (
        lambda s, d: rp.sink_json(snapshot(s, d)),
        with_parts("deliveries fold_sinks", f""", {_LAST_FAIL}, {_SNAP} SELECT sink_key, '{{"sink_key":"' || sink_key || '","enabled":' || enabled
          || ',"pending":' || pending || ',"failed":' || failed || ',"dead":' || dead || ',"delivered":' || delivered
          || ',"attempts":' || attempts || ',"last_failure_at":' || coalesce('"' || {iso('f.updated_at')} || '"', 'null')
          || ',"last_error":' || coalesce('"' || f.last_error || '"', 'null') || '}}' AS json
          FROM snap s LEFT JOIN last_fail f USING (sink_key)"""),
    ),
    "source_status_lines": (
        lambda s, d: rp.source_lines(health(s, d)),
        with_parts("health", f"""SELECT source_key, rpad(source_key, 32, ' ') || ' ' || rpad(status, 14, ' ')
          || ' ' || rpad(CAST(consecutive_failures AS VARCHAR), 7, ' ') || ' ' || rpad(CAST(total_runs AS VARCHAR), 7, ' ')
          || ' ' || rpad(CAST(total_events AS VARCHAR), 8, ' ') || ' ' || coalesce({iso_micros('last_success_at')}, '-') AS line FROM health"""),
    ),
    "source_snapshot": (
        lambda s, d: rp.source_snapshot(he.list_health(health(s, d))).select(
            "source_key", "status", "consecutive_failures", "total_runs", "total_events", "last_error",
            se.health_class(F.col("status")).alias("class"),
            age_text(F.col("last_success_at"), v.ts(PROM_NOW)).alias("last_success_age"),
        ),
        with_parts("health", f"""SELECT source_key, status, CAST(consecutive_failures AS INTEGER) AS consecutive_failures, total_runs,
          total_events, last_error, CASE status WHEN 'healthy' THEN 'healthy' ELSE 'warning' END AS class,
          CASE WHEN last_success_at IS NULL THEN 'Never'
            WHEN s < 60 THEN s || ' second' || CASE s WHEN 1 THEN '' ELSE 's' END || ' ago'
            WHEN m < 60 THEN m || ' minute' || CASE m WHEN 1 THEN '' ELSE 's' END || ' ago'
            WHEN h < 24 THEN h || ' hour' || CASE h WHEN 1 THEN '' ELSE 's' END || ' ago'
            WHEN d < 30 THEN d || ' day' || CASE d WHEN 1 THEN '' ELSE 's' END || ' ago'
            ELSE strftime(last_success_at, '%Y-%m-%d %H:%M:%S') END AS last_success_age
          FROM (SELECT *, CAST(round(h / 24.0) AS BIGINT) AS d FROM (SELECT *, CAST(round(m / 60.0) AS BIGINT) AS h FROM
          (SELECT *, CAST(round(s / 60.0) AS BIGINT) AS m FROM (SELECT *,
            CAST(round((epoch_us(TIMESTAMP '{PROM_NOW}') - epoch_us(last_success_at)) / 1e6) AS BIGINT) AS s FROM health))))"""),
    ),
    "source_status_counts": (
        lambda s, d: rp.source_status_counts(health(s, d)),
        with_parts("health", "SELECT status, count(*) AS total FROM health GROUP BY 1"),
    ),
    "delivery_attention": (
        lambda s, d: rp.delivery_attention(snapshot(s, d)),
        with_parts("deliveries", "SELECT count(*) AS delivery_attention FROM deliveries WHERE status IN ('failed', 'dead')"),
    ),
    "metrics_lines": (prom, _prom_sql()),
    "overview": (
        overview,
        with_parts("sig health deliveries", """SELECT count(*) AS sources, count(*) FILTER (WHERE status = 'healthy') AS healthy_sources,
          (SELECT count(*) FROM sig) AS signals_total,
          (SELECT count(*) FROM sig WHERE collected_at >= TIMESTAMP '2024-01-31 23:10:00') AS last_hour,
          (SELECT count(*) FROM sig WHERE collected_at >= TIMESTAMP '2024-01-31 00:10:00') AS last_24h,
          (SELECT count(*) FROM deliveries WHERE status IN ('failed', 'dead')) AS delivery_attention,
          (SELECT count(DISTINCT source) FROM sig) AS source_facets, (SELECT count(DISTINCT kind) FROM sig) AS kind_facets FROM health"""),
    ),
    "overall_banner": (
        banner,
        with_parts("health deliveries", """SELECT CASE WHEN n > 0 OR bad > 0 OR total = 0 THEN 'warning' ELSE 'healthy' END AS level,
          total - bad AS healthy_sources, total AS sources, n AS delivery_attention FROM
          (SELECT count(*) AS total, count(*) FILTER (WHERE status <> 'healthy') AS bad,
            (SELECT count(*) FROM deliveries WHERE status IN ('failed', 'dead')) AS n FROM health)"""),
    ),
    "attention_list": (
        attention,
        with_parts("health deliveries", """SELECT 1 AS position, 'Table layout' AS title,
          'The tables are migration_required; check them before the next run' AS detail, 'danger' AS level
          UNION ALL SELECT * FROM (SELECT 2, source_key, coalesce(last_error, 'Last seen as ' || status || '.'), 'warning'
            FROM health WHERE status <> 'healthy' ORDER BY source_key LIMIT 3)
          UNION ALL SELECT 3, 'Undelivered events', n || ' deliveries failed or were given up', 'danger'
            FROM (SELECT count(*) AS n FROM deliveries WHERE status IN ('failed', 'dead')) WHERE n > 0"""),
    ),
    "collection_summary": (
        summary,
        with_parts("event_pages mut", """SELECT p.*, c.events, c.inserted, c.updated, c.unchanged FROM (
          SELECT source_key, run_id, count(*) AS pages, CAST(sum(primary_count) AS BIGINT) AS primary_count,
            CAST(sum(CAST(has_more AS INTEGER)) AS BIGINT) AS warnings,
            arg_max(CASE WHEN primary_count % 2 = 0 THEN primary_count END, CASE WHEN primary_count % 2 = 0 THEN page_no END) AS remaining
          FROM event_pages GROUP BY 1, 2) p LEFT JOIN (SELECT seq // 10 AS run_id, count(*) AS events,
            count(*) FILTER (WHERE change = 'inserted') AS inserted, count(*) FILTER (WHERE change = 'updated') AS updated,
            count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM mut_changes GROUP BY 1) c USING (run_id)"""),
    ),
}
