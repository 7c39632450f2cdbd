"""Queries on identity, change classification, upsert and outbox."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.catalog import views as v
from rillflow.catalog.twins import CANON, EVENT_JSON, iso, iso_micros, with_parts
from rillflow.functions import (
    canonical_text, event_json, idempotency_key, initials, iso_utc, optional_text, prom_escape,
    query_instance, source_key, truncate,
)
from rillflow.operators import changes as ch
from rillflow.operators import outbox as ob
from rillflow.operators import store as st
from rillflow.plans import fan_out
from rillflow.schemas import SIGNAL_COLUMNS
from rillflow.sources import archive

NOW = "2024-03-01 00:00:00"


def identity(spark, sf):
    return v.doc_signals(spark, sf).select("seq", "id", source_key(F.col("source"), F.col("source_instance")).alias("source_key"))


def canonical(spark, sf):
    return v.doc_fields(spark, sf).select(
        "doc_id", canonical_text().alias("canonical"), F.sha2(canonical_text(), 256).alias("event_hash")
    )


def serialised(spark, sf):
    return v.doc_signals(spark, sf).select("id", event_json().alias("event"))


def scalars(spark, sf):
    s = v.doc_signals(spark, sf)
    return s.select(
        "id",
        iso_utc(F.col("created_at")).alias("created"),
        optional_text(F.concat(F.lit(" \n"), "author", F.lit("\t"))).alias("author"),
        initials(F.col("source")).alias("initials"),
        truncate(F.col("content"), 40).alias("short"),
        query_instance(F.col("url")).alias("search_instance"),
        prom_escape(F.concat(F.col("source"), F.lit('\\"\n'))).alias("label"),
        idempotency_key(F.lit("archive"), F.col("id"), F.col("event_hash")).alias("idempotency_key"),
    )


def event_times(spark, sf):
    return v.table(spark, sf, "events").select("event_id", iso_utc(F.col("ts").cast("timestamp")).alias("at"))


def archive_round_trip(spark, sf):
    lines = v.doc_signals(spark, sf).select(event_json().alias("value"))
    return archive.signals_from_json(lines).select(
        "id", "kind", "title", "author", "url", iso_utc(F.col("created_at")).alias("created_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"), "metadata_json", "event_hash",
    )


def _mutation_changes(spark, sf) -> DataFrame:
    return ch.classify_changes(v.mutations(spark, sf), v.no_signals(spark))


def _doc_changes(spark, sf) -> DataFrame:
    return ch.classify_changes(
        v.doc_signals(spark, sf), v.stored_docs(spark, sf), carry=("source", "collected_at")
    )


def classify_mutations(spark, sf):
    return _mutation_changes(spark, sf).select("seq", "id", "change")


def classify_documents(spark, sf):
    return _doc_changes(spark, sf).select("seq", "id", "change")


def counts(spark, sf):
    return ch.write_counts(_doc_changes(spark, sf), "source")


def counts_mutations(spark, sf):
    return ch.write_counts(_mutation_changes(spark, sf))


def _columns(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "content", iso_utc(F.col("collected_at")).alias("collected_at"), "event_hash")


def upsert_documents(spark, sf):
    return _columns(ch.apply_changes(v.stored_docs(spark, sf), v.doc_signals(spark, sf), _doc_changes(spark, sf)))


def upsert_mutations(spark, sf):
    return _columns(ch.apply_changes(v.no_signals(spark), v.mutations(spark, sf), _mutation_changes(spark, sf)))


def lookups(spark, sf):
    ids = v.doc_signals(spark, sf).select("id")
    return archive.exists(v.stored_docs(spark, sf), ids)


def point_reads(spark, sf):
    labels = v.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    ids = v.doc_signals(spark, sf).join(labels, F.col("seq") == F.col("doc_id"), "left_semi").select("id")
    return archive.get_signals(v.doc_signals(spark, sf), ids).select("id", "title")


def _queue_view(df: DataFrame) -> DataFrame:
    return df.select(
        "sink_key", "event_id", "status", "attempts",
        iso_utc(F.col("next_attempt_at")).alias("next_attempt_at"), "last_error",
        iso_utc(F.col("delivered_at")).alias("delivered_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"),
    )


def _stored_deliveries(spark, sf) -> DataFrame:
    """Every stored document was delivered to every sink a week earlier."""
    rows = v.stored_docs(spark, sf).select(F.col("id").alias("event_id"), "collected_at")
    at = F.col("collected_at")
    return fan_out(rows, v.doc_sinks(spark, sf), "sink_key").select(
        "sink_key", "event_id", F.lit("delivered").alias("status"), F.lit(1).alias("attempts"),
        F.lit(None).cast("timestamp").alias("next_attempt_at"), F.lit(None).cast("string").alias("last_error"),
        at.alias("delivered_at"), at.alias("updated_at"),
    )


def enqueue_documents(spark, sf):
    out = ob.enqueue(_doc_changes(spark, sf), v.doc_sinks(spark, sf), _stored_deliveries(spark, sf))
    return _queue_view(out)


def enqueue_mutations(spark, sf):
    return ob.queued(_mutation_changes(spark, sf), v.doc_sinks(spark, sf)).select(
        "sink_key", "event_id", "status", "attempts", iso_utc(F.col("updated_at")).alias("updated_at")
    )


def backfill_sink(spark, sf):
    names = v.table(spark, sf, "nation").select(F.concat(F.lit("sink-"), F.lower("n_name")).alias("sink_key"))
    wanted = names.unionByName(v.doc_sinks(spark, sf).select("sink_key")).filter("sink_key RLIKE '^sink-(a|e)'")
    out = ob.backfill(v.doc_signals(spark, sf), wanted, _stored_deliveries(spark, sf), v.ts(NOW))
    return out.groupBy("sink_key", "status").agg(F.count("*").alias("queued"))


def sink_registration(spark, sf):
    names = v.table(spark, sf, "nation").select(F.concat(F.lit("sink-"), F.lower("n_name")).alias("sink_key"))
    names = names.unionByName(v.doc_sinks(spark, sf).filter("NOT enabled").select("sink_key"))
    sinks, new = ob.register_sinks(v.doc_sinks(spark, sf), names, v.ts(NOW))
    return sinks.join(new, "sink_key", "left").select(
        "sink_key", "enabled", iso_utc(F.col("created_at")).alias("created_at"),
        iso_utc(F.col("updated_at")).alias("updated_at"), "is_new",
    )


def sink_disabling(spark, sf):
    sinks = v.doc_sinks(spark, sf)
    off = sinks.filter("sink_key LIKE '%america'")
    return ob.disable_sinks(sinks, off, v.ts(NOW)).select(
        "sink_key", "enabled", iso_utc(F.col("updated_at")).alias("updated_at")
    )


def legacy_upgrade(spark, sf):
    old = v.doc_signals(spark, sf).drop("schema_version", "source_instance", "updated_at", "event_hash", "seq")
    up = st.upgrade_legacy(old)
    changes = ch.classify_changes(v.doc_signals(spark, sf), up.select(*SIGNAL_COLUMNS))
    return up.groupBy("schema_version", "source_instance", "event_hash").agg(F.count("*").alias("n_rows")).withColumn(
        "updated", changes.agg(F.count_if(F.col("change") == "updated")).scalar()
    )


_QUEUE = """SELECT k.sink_key, c.id AS event_id, 'pending' AS status, 0 AS attempts, CAST(NULL AS VARCHAR) AS next_attempt_at,
  CAST(NULL AS VARCHAR) AS last_error, CAST(NULL AS VARCHAR) AS delivered_at, {at} AS updated_at
  FROM {changes} c CROSS JOIN sinks k WHERE k.enabled"""

QUERIES = {
    "stable_identity": (identity, with_parts("sig", "SELECT seq, id, source || ':' || source_instance AS source_key FROM sig")),
    "canonical_fingerprint": (
        canonical,
        with_parts("doc_fields", f"SELECT doc_id, {CANON} AS canonical, sha256({CANON}) AS event_hash FROM doc_fields"),
    ),
    "event_serialisation": (serialised, with_parts("sig", f"SELECT id, {EVENT_JSON} AS event FROM sig")),
    "scalar_functions": (
        scalars,
        with_parts("sig", f"""SELECT id, {iso('created_at')} AS created, author,
          upper(substr(source, 1, 2)) AS initials,
          CASE WHEN length(t) > 40 THEN substr(t, 1, 39) || '…' ELSE t END AS short,
          'search-' || substr(sha256(url), 1, 12) AS search_instance,
          source || '\\\\\\"\\n' AS label,
          'rillflow:' || substr(sha256('archive' || chr(31) || id || chr(31) || event_hash), 1, 32) AS idempotency_key
          FROM (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM sig)"""),
    ),
    "event_time_text": (event_times, f"SELECT event_id, {iso_micros('ts')} AS at FROM events"),
    "archive_round_trip": (
        archive_round_trip,
        with_parts("sig", f"""SELECT id, kind, title, author, url, {iso('created_at')} AS created_at,
          {iso('updated_at')} AS updated_at, metadata_json, event_hash FROM sig"""),
    ),
    "classify_mutations": (classify_mutations, with_parts("mut", "SELECT seq, id, change FROM mut_changes")),
    "classify_documents": (classify_documents, with_parts("doc_changes", "SELECT seq, id, change FROM doc_changes")),
    "write_counts": (
        counts,
        with_parts("doc_changes", """SELECT source, count(*) FILTER (WHERE change = 'inserted') AS inserted,
          count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'unchanged') AS unchanged,
          count(*) FILTER (WHERE change <> 'unchanged') AS changed FROM doc_changes GROUP BY source"""),
    ),
    "write_counts_total": (
        counts_mutations,
        with_parts("mut", """SELECT count(*) FILTER (WHERE change = 'inserted') AS inserted,
          count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'unchanged') AS unchanged,
          count(*) FILTER (WHERE change <> 'unchanged') AS changed FROM mut_changes"""),
    ),
    "upsert_documents": (
        upsert_documents,
        with_parts("doc_changes", f"""SELECT id, kind, content, {iso('collected_at')} AS collected_at, event_hash
          FROM doc_changes WHERE change <> 'unchanged'
          UNION ALL SELECT t.id, t.kind, t.content, {iso('t.collected_at')}, t.event_hash
          FROM stored t JOIN doc_changes c ON c.id = t.id WHERE c.change = 'unchanged'"""),
    ),
    "upsert_mutations": (
        upsert_mutations,
        with_parts("mut", f"""SELECT id, kind, content, {iso_micros('collected_at')} AS collected_at, event_hash
          FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM mut_changes WHERE change <> 'unchanged')
          WHERE rn = 1"""),
    ),
    "stored_lookup": (
        lookups,
        with_parts("stored", "SELECT s.id, t.id IS NOT NULL AS stored FROM sig s LEFT JOIN stored t ON t.id = s.id"),
    ),
    "point_reads": (
        point_reads,
        with_parts("sig", "SELECT id, title FROM sig WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    ),
    "signal_count": (
        lambda spark, sf: archive.count(v.doc_signals(spark, sf)), "SELECT count(*) AS signals_total FROM documents",
    ),
    "enqueue_documents": (
        enqueue_documents,
        with_parts("doc_changes sinks", _QUEUE.format(changes="doc_changes", at=iso("c.collected_at"))
          + f""" AND c.change <> 'unchanged'
          UNION ALL SELECT k.sink_key, t.id, 'delivered', 1, NULL, NULL, {iso('t.collected_at')}, {iso('t.collected_at')}
          FROM stored t CROSS JOIN sinks k JOIN doc_changes c ON c.id = t.id
          WHERE c.change = 'unchanged' OR NOT k.enabled"""),
    ),
    "enqueue_mutations": (
        enqueue_mutations,
        with_parts("mut sinks", f"""SELECT k.sink_key, m.id AS event_id, 'pending' AS status, 0 AS attempts, {iso_micros('m.at')} AS updated_at
          FROM (SELECT id, arg_max(collected_at, seq) AS at FROM mut_changes WHERE change <> 'unchanged' GROUP BY id) m
          CROSS JOIN sinks k WHERE k.enabled"""),
    ),
    "backfill_sinks": (
        backfill_sink,
        with_parts("stored sinks", """SELECT n.sink_key, 'pending' AS status, count(*) AS queued
          FROM (SELECT DISTINCT sink_key FROM (SELECT 'sink-' || lower(n_name) AS sink_key FROM nation
            UNION ALL SELECT sink_key FROM sinks) WHERE regexp_matches(sink_key, '^sink-(a|e)')) n
          CROSS JOIN sig s WHERE NOT EXISTS (SELECT 1 FROM sinks k WHERE k.sink_key = n.sink_key)
            OR s.id NOT IN (SELECT id FROM stored) GROUP BY 1"""),
    ),
    "register_sinks": (
        sink_registration,
        with_parts("sinks", """, asked AS (SELECT 'sink-' || lower(n_name) AS sink_key FROM nation
            UNION SELECT sink_key FROM sinks WHERE NOT enabled)
          SELECT coalesce(k.sink_key, a.sink_key) AS sink_key, a.sink_key IS NOT NULL OR k.enabled AS enabled,
            CASE WHEN k.sink_key IS NULL THEN '2024-03-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS created_at,
            CASE WHEN a.sink_key IS NOT NULL THEN '2024-03-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS updated_at,
            CASE WHEN a.sink_key IS NOT NULL THEN k.sink_key IS NULL END AS is_new
          FROM sinks k FULL JOIN asked a ON a.sink_key = k.sink_key"""),
    ),
    "disable_sinks": (
        sink_disabling,
        with_parts("sinks", """SELECT sink_key, enabled AND sink_key NOT LIKE '%america' AS enabled,
          CASE WHEN sink_key LIKE '%america' THEN '2024-03-01T00:00:00+00:00' ELSE '2024-01-01T00:00:00+00:00' END AS updated_at
          FROM sinks"""),
    ),
    "legacy_upgrade": (
        legacy_upgrade,
        "SELECT 1 AS schema_version, 'default' AS source_instance, '' AS event_hash, count(*) AS n_rows, count(*) AS updated FROM documents",
    ),
}
