"""The whole path in one query: signals, change classes, outbox, sink totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.catalog import views as v
from rillflow.catalog.twins import with_parts
from rillflow.operators.changes import classify_changes
from rillflow.operators.outbox import enqueue
from rillflow.operators.reports import sink_snapshot
from rillflow.schemas import DELIVERIES


def ingest_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = classify_changes(v.doc_signals(spark, sf_dir), v.stored_docs(spark, sf_dir))
    sinks = v.doc_sinks(spark, sf_dir)
    deliveries = enqueue(changes, sinks, spark.createDataFrame([], DELIVERIES))
    return sink_snapshot(sinks, deliveries).drop("last_failure_at", "last_error")


QUERIES = {
    "ingest_and_report": (
        ingest_and_report,
        with_parts("doc_changes sinks", """SELECT k.sink_key, k.enabled,
          CASE WHEN k.enabled THEN n ELSE 0 END AS pending, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS dead,
          CAST(0 AS BIGINT) AS delivered, CAST(0 AS BIGINT) AS attempts
          FROM sinks k, (SELECT count(*) AS n FROM doc_changes WHERE change <> 'unchanged')"""),
    ),
}
