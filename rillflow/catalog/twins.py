"""The views of :mod:`rillflow.catalog.views` in ANSI SQL, as named common table expressions."""

from __future__ import annotations

def iso(column: str) -> str:
    return f"(strftime({column}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


def iso_micros(column: str) -> str:
    return (
        f"(strftime({column}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({column}) % 1000000 <> 0 "
        f"THEN strftime({column}, '.%f') ELSE '' END || '+00:00')"
    )


def sid(source: str, external: str, kind: str, instance: str) -> str:
    return (
        f"('sig_' || substr(sha256(lower(trim({source})) || chr(31) || lower(trim({instance})) || chr(31) || "
        f"{kind} || chr(31) || trim({external})), 1, 24))"
    )


def js(column: str) -> str:
    """A string column as JSON text."""
    return f"coalesce(CAST(to_json({column}) AS VARCHAR), 'null')"


CANON = (
    "'{\"author\":' || " + js("author") + " || ',\"content\":' || " + js("content")
    + " || ',\"created_at\":\"' || " + iso("created_at") + " || '\",\"kind\":\"' || kind"
    + " || '\",\"metadata\":' || metadata_json || ',\"schema_version\":' || schema_version"
    + " || ',\"source\":' || " + js("source") + " || ',\"source_instance\":' || " + js("source_instance")
    + " || ',\"title\":' || " + js("title") + " || ',\"updated_at\":' || coalesce('\"' || "
    + iso("updated_at") + " || '\"', 'null') || ',\"url\":' || " + js("url") + " || '}'"
)

EVENT_JSON = (
    "'{\"id\":\"' || id || '\",\"source\":' || " + js("source") + " || ',\"kind\":\"' || kind || '\",\"content\":' || "
    + js("content") + " || ',\"url\":' || " + js("url") + " || ',\"created_at\":\"' || " + iso("created_at")
    + " || '\",\"collected_at\":\"' || " + iso("collected_at") + " || '\",\"title\":' || " + js("title")
    + " || ',\"author\":' || " + js("author") + " || ',\"metadata\":' || metadata_json || ',\"source_instance\":' || "
    + js("source_instance") + " || ',\"updated_at\":' || coalesce('\"' || " + iso("updated_at")
    + " || '\"', 'null') || ',\"schema_version\":' || schema_version || '}'"
)

KINDS = "['article','comment','issue','post','pull_request','story','other']"
EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def after(seconds: str, base: str = EPOCH) -> str:
    return f"({base} + to_seconds(CAST({seconds} AS BIGINT)))"


_DOC_FIELDS = f"""doc_fields AS (
  SELECT doc_id, 1 AS schema_version, source, lang AS source_instance,
    {KINDS}[CAST(doc_id % 7 + 1 AS INTEGER)] AS kind, CAST(doc_id AS VARCHAR) AS external_id,
    substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content,
    CASE WHEN doc_id % 5 <> 0 THEN 'author-' || (doc_id % 97) END AS author,
    'https://docs.example.org/' || source || '/' || doc_id AS url,
    {after('doc_id * 37')} AS created_at,
    CASE WHEN doc_id % 3 <> 0 THEN {after('doc_id * 37 + 86400')} END AS updated_at,
    {after('doc_id', "TIMESTAMP '2024-02-01 00:00:00'")} AS collected_at,
    '{{"lang":' || {js('lang')} || ',"n_chars":' || n_chars || '}}' AS metadata_json
  FROM documents)"""

_SIG = f"""sig AS (
  SELECT *, {sid('source', 'external_id', 'kind', 'source_instance')} AS id, sha256({CANON}) AS event_hash,
    doc_id AS seq FROM doc_fields)"""

_STORED = """stored AS (
  SELECT s.* EXCLUDE (content, event_hash, collected_at),
    CASE WHEN quality = 0 THEN 'older text' ELSE content END AS content,
    CASE WHEN quality = 0 THEN sha256('older ' || id) ELSE event_hash END AS event_hash,
    collected_at - INTERVAL 7 DAY AS collected_at
  FROM sig s JOIN labels l ON l.doc_id = s.doc_id)"""

_DOC_CHANGES = """doc_changes AS (
  SELECT s.*, CASE WHEN t.id IS NULL THEN 'inserted' WHEN t.event_hash = s.event_hash THEN 'unchanged'
    ELSE 'updated' END AS change
  FROM sig s LEFT JOIN stored t ON t.id = s.id)"""

_SINKS = """sinks AS (
  SELECT 'sink-' || lower(r_name) AS sink_key, r_name <> 'ASIA' AS enabled FROM region)"""

_MUTATIONS = f"""mut_fields AS (
  SELECT 1 AS schema_version, 'events' AS source, event_type AS source_instance, 'other' AS kind,
    CAST(user_id AS VARCHAR) AS external_id, CAST(NULL AS VARCHAR) AS title,
    'bucket ' || CAST(floor(value / 10) AS BIGINT) AS content, CAST(NULL AS VARCHAR) AS author,
    'https://events.example.org/' || user_id AS url, {EPOCH} AS created_at,
    CAST(NULL AS TIMESTAMP) AS updated_at, ts AS collected_at, '{{}}' AS metadata_json, event_id AS seq
  FROM events),
mut AS (
  SELECT *, {sid('source', 'external_id', 'kind', 'source_instance')} AS id, sha256({CANON}) AS event_hash
  FROM mut_fields),
mut_changes AS (
  SELECT *, CASE WHEN prev IS NULL THEN 'inserted' WHEN prev = event_hash THEN 'unchanged' ELSE 'updated' END AS change
  FROM (SELECT *, lag(event_hash) OVER (PARTITION BY id ORDER BY seq) AS prev FROM mut))"""

_RUNS = """runs AS (
  SELECT event_id AS run_id, 'user:' || user_id AS source_key, ts AS attempted_at,
    ts + INTERVAL 2 SECOND AS finished_at, event_type <> 'error' AS success,
    CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'rate_limit' ELSE 'http' END END AS error_kind,
    CASE WHEN event_type = 'error' THEN 'failed run ' || event_id END AS error,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k
  FROM events),
run_islands AS (
  SELECT *, count(*) FILTER (WHERE success) OVER (PARTITION BY source_key ORDER BY run_id) AS island FROM runs),
run_states AS (
  SELECT *, count(*) FILTER (WHERE NOT success) OVER (PARTITION BY source_key, island ORDER BY run_id) AS failures,
    CASE WHEN k % 5 = 0 THEN k * 2.0 WHEN k % 3 = 0 THEN CAST(k AS DOUBLE) ELSE 0.0 END AS limited
  FROM run_islands),
run_outcomes AS (
  SELECT *, CASE WHEN success THEN 'healthy' WHEN failures >= 5 THEN 'circuit_open' ELSE 'degraded' END AS status,
    CASE WHEN success THEN greatest(60.0, limited) WHEN failures >= 5 THEN 300.0
      WHEN error_kind = 'rate_limit' AND limited > 0 THEN limited
      ELSE least(60.0, 5.0 * pow(2.0, failures - 1)) END AS delay
  FROM run_states)"""

_HEALTH = """health AS (
  SELECT source_key,
    arg_max(status, run_id) AS status, max(finished_at) AS updated_at, arg_max(attempted_at, run_id) AS last_attempt_at,
    max(CASE WHEN success THEN finished_at END) AS last_success_at,
    CASE WHEN NOT arg_max(success, run_id) THEN arg_max(error, run_id) END AS last_error,
    arg_max(failures, run_id) AS consecutive_failures, count(*) AS total_runs,
    CAST(sum(CASE WHEN success THEN k ELSE 0 END) AS BIGINT) AS total_events
  FROM run_outcomes GROUP BY source_key)"""

_TURNS = f"""turns AS (
  SELECT 'chat:default' AS source_key, conv_id AS parent_id, turn AS pos, conv_id * 100 + turn AS child_id,
    {after('conv_id * 60 + turn')} AS created_at, role, text FROM conversations)"""

_ATTEMPTS = """attempts AS (
  SELECT 'sink-' || l_returnflag AS sink_key, 'order-' || l_orderkey AS event_id,
    CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 100000000 + l_partkey * 10 + l_linenumber AS seq,
    CASE WHEN l_linestatus = 'O' THEN 'success' WHEN l_quantity < 5 THEN 'permanent'
      WHEN l_quantity < 10 THEN 'missing' ELSE 'retryable' END AS outcome,
    CASE WHEN l_discount < 0.02 THEN 'v0' ELSE 'v1' END AS sent_hash,
    CASE WHEN l_linenumber = 3 THEN l_quantity END AS retry_after,
    CASE WHEN l_linestatus <> 'O' THEN 'line ' || l_linenumber END AS error,
    l_shipdate AS attempted_at, l_discount
  FROM lineitem),
queue_log AS (
  SELECT DISTINCT sink_key, event_id, CAST(0 AS BIGINT) AS seq, TIMESTAMP '1995-01-01 00:00:00' AS queued_at FROM attempts
  UNION ALL SELECT sink_key, event_id, seq, attempted_at FROM attempts WHERE l_discount = 0.05),
queue_last AS (
  SELECT sink_key, event_id, max(seq) AS qseq, arg_max(queued_at, seq) AS qat FROM queue_log GROUP BY 1, 2),
live AS (
  SELECT a.* FROM attempts a JOIN queue_last q USING (sink_key, event_id)
  WHERE a.seq > q.qseq AND (a.outcome <> 'success' OR a.sent_hash = 'v1')),
live_last AS (
  SELECT sink_key, event_id, count(*) AS n, arg_max(outcome, seq) AS outcome,
    max(seq) AS lseq, max(CASE WHEN outcome = 'success' THEN seq END) AS okseq FROM live GROUP BY 1, 2),
deliveries AS (
  SELECT q.sink_key, q.event_id,
    CASE WHEN l.outcome IS NULL THEN 'pending' WHEN l.outcome = 'success' THEN 'delivered'
      WHEN l.outcome IN ('permanent', 'missing') OR l.n >= 8 THEN 'dead' ELSE 'failed' END AS status,
    CAST(coalesce(l.n, 0) AS INTEGER) AS attempts,
    CASE WHEN l.outcome = 'retryable' AND l.n < 8 THEN t.attempted_at + to_seconds(CAST(
      CASE WHEN t.retry_after IS NOT NULL THEN least(greatest(t.retry_after, 0), 3600) ELSE least(5 * pow(2, l.n - 1), 3600) END AS BIGINT)) END AS next_attempt_at,
    CASE WHEN l.outcome <> 'success' THEN t.error END AS last_error,
    ok.attempted_at AS delivered_at, coalesce(t.attempted_at, q.qat) AS updated_at
  FROM queue_last q LEFT JOIN live_last l USING (sink_key, event_id)
  LEFT JOIN live t ON t.sink_key = l.sink_key AND t.event_id = l.event_id AND t.seq = l.lseq
  LEFT JOIN live ok ON ok.sink_key = l.sink_key AND ok.event_id = l.event_id AND ok.seq = l.okseq)"""

_FOLD_SINKS = "fold_sinks AS (SELECT * FROM (VALUES ('sink-A', true), ('sink-N', true), ('sink-R', false), ('sink-empty', true)) v(sink_key, enabled))"

_PASS = """pass_deliveries AS (
  SELECT 'sink-' || substr(o_orderpriority, 1, 1) AS sink_key, 'order-' || o_orderkey AS event_id, s AS status,
    CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(o_orderkey % 9 AS INTEGER) END AS attempts,
    CASE WHEN s = 'failed' THEN o_orderdate + INTERVAL 30 DAY END AS next_attempt_at,
    CASE WHEN s IN ('failed', 'dead') THEN 'HTTP ' || (500 + o_orderkey % 5) END AS last_error,
    CASE WHEN s = 'delivered' THEN o_orderdate END AS delivered_at, o_orderdate AS updated_at
  FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'failed'
    WHEN o_custkey % 2 = 0 THEN 'dead' ELSE 'delivered' END AS s FROM orders)),
order_signals AS (
  SELECT 'order-' || o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'v2' ELSE 'v1' END AS event_hash
  FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')),
pass_attempts AS (
  SELECT 'sink-' || substr(o_orderpriority, 1, 1) AS sink_key, 'order-' || o_orderkey AS event_id,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'missing' WHEN o_custkey % 5 < 2 THEN 'success'
      WHEN o_custkey % 5 = 2 THEN 'permanent' ELSE 'retryable' END AS outcome,
    CASE WHEN o_orderstatus = 'O' THEN 0 ELSE CAST(o_orderkey % 9 AS INTEGER) END AS prior,
    CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_orderkey % 5000 AS DOUBLE) END AS retry_after,
    'send ' || o_orderpriority AS error, o_orderdate + INTERVAL 60 DAY AS attempted_at
  FROM orders WHERE o_orderstatus IN ('O', 'P')),
outcomes AS (
  SELECT d.*, a.attempted_at, a.retry_after, a.prior, a.error, a.outcome,
    CASE WHEN a.outcome IS NULL THEN NULL
      WHEN a.outcome = 'success' AND s.event_hash IS DISTINCT FROM 'v1' THEN 'superseded'
      WHEN a.outcome = 'success' THEN 'delivered'
      WHEN a.outcome IN ('permanent', 'missing') OR a.prior + 1 >= 8 THEN 'dead' ELSE 'failed' END AS result
  FROM pass_deliveries d LEFT JOIN pass_attempts a USING (sink_key, event_id)
  LEFT JOIN order_signals s ON s.id = d.event_id)"""

_REQUESTS = """requests AS (
  SELECT o_orderkey AS request_id, 'cust:' || o_custkey AS source_key, 'https://api.example.org/' || o_orderkey AS url,
    o_orderkey AS o, CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' WHEN o_orderkey % 17 = 0 THEN 'network' END AS failure,
    CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN
      [200,204,304,401,403,404,408,425,429,500,503,599][CAST(o_orderkey % 12 + 1 AS INTEGER)] END AS status,
    CAST(o_orderkey % 5 + 1 AS INTEGER) AS attempt, o_orderdate AS asked_at,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 END AS x_remaining,
    CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 2 END AS remaining2,
    CASE WHEN o_orderkey % 2 = 0 THEN 60 END AS x_limit,
    CASE WHEN o_orderkey % 4 = 0 THEN 1700000000 + o_orderkey % 1000 END AS x_reset,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 120 END AS rel_reset,
    CASE WHEN o_orderkey % 7 = 0 THEN greatest(CAST(o_orderkey % 15 - 2 AS DOUBLE), 0.0) END AS wait,
    repeat(o_orderpriority || ' ', 40) AS body
  FROM orders),
judged AS (
  SELECT *, CASE WHEN kind IS NULL THEN NULL ELSE retry END AS retryable,
    kind IS NOT NULL AND NOT (retry AND attempt < 4) AS gives_up,
    CASE WHEN kind IS NOT NULL AND retry AND attempt < 4 THEN
      CASE WHEN failure IS NULL AND wait IS NOT NULL THEN least(wait, 8.0) ELSE least(0.25 * pow(2.0, attempt - 1), 8.0) END END AS retry_delay
  FROM (SELECT *,
    CASE WHEN failure IS NOT NULL THEN failure
      WHEN status = 429 OR (status = 403 AND coalesce(x_remaining = 0, false)) THEN 'rate_limit'
      WHEN status IN (401, 403) THEN 'auth' WHEN status >= 400 THEN 'http' END AS kind,
    CASE WHEN failure IS NOT NULL THEN true ELSE status IN (408,425,429,500,502,503,504)
      OR (status = 403 AND coalesce(x_remaining = 0, false)) END AS retry
  FROM requests))"""

_POLLS = f"""polls AS (
  SELECT source || ':' || lang AS source_key, doc_id // 500 AS poll_id, doc_id % 500 AS pos,
    CAST(doc_id AS VARCHAR) AS external_id, doc_id, {after('doc_id * 37')} AS created_at,
    CASE WHEN doc_id % 3 <> 0 THEN {after('doc_id * 37 + 86400')} END AS updated_at
  FROM documents),
seen AS (
  SELECT source || ':' || lang AS source_key, CAST(doc_id AS VARCHAR) AS external_id, doc_id AS rank, quality, toxic
  FROM documents JOIN labels USING (doc_id))"""

_EVENT_PAGES = """event_pages AS (
  SELECT 'events:paged' AS source_key, event_id // 10 AS run_id, event_id % 10 + 1 AS page_no,
    CASE WHEN k < 3 THEN 0 ELSE k END AS primary_count, event_type <> 'signup' AND event_id % 10 <> 9 AS has_more,
    'c' || CASE WHEN k % 11 = 0 THEN 0 ELSE event_id END AS cursor_json
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""

PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "doc_fields": (_DOC_FIELDS, ()),
    "sig": (_SIG, ("doc_fields",)),
    "stored": (_STORED, ("sig",)),
    "doc_changes": (_DOC_CHANGES, ("stored",)),
    "sinks": (_SINKS, ()),
    "mut": (_MUTATIONS, ()),
    "runs": (_RUNS, ()),
    "health": (_HEALTH, ("runs",)),
    "turns": (_TURNS, ()),
    "deliveries": (_ATTEMPTS, ()),
    "fold_sinks": (_FOLD_SINKS, ()),
    "pass": (_PASS, ()),
    "requests": (_REQUESTS, ()),
    "polls": (_POLLS, ()),
    "event_pages": (_EVENT_PAGES, ()),
}


def with_parts(names: str, body: str) -> str:
    """Prefix ``body`` with the named expressions and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        text, needs = PARTS[name]
        for n in needs:
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    return "WITH " + ",\n".join(PARTS[n][0] for n in order) + "\n" + body
