"""Queries on page contracts and table verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.catalog import running as r
from rillflow.catalog import views as v
from rillflow.catalog.twins import with_parts
from rillflow.operators import contract as ct
from rillflow.operators import reports as rp
from rillflow.operators import store as st
from rillflow.operators import verify as vf
from rillflow.schemas import REQUIRED


def broken_signals(spark, sf) -> DataFrame:
    """Document signals; junk, short and foreign documents break one rule or more."""
    d = v.doc_signals(spark, sf)
    return d.withColumns(
        {
            "url": F.when(F.col("author").isNull(), " ").otherwise(F.col("url")),
            "kind": F.when(F.col("source_instance") == "es", "essay").otherwise(F.col("kind")),
            "schema_version": F.when(F.col("updated_at").isNull(), 0).otherwise(1),
        }
    )


def row_validity(spark, sf):
    return ct.validate_signals(broken_signals(spark, sf))[1].select("id", "reason")


def valid_rows(spark, sf):
    return ct.validate_signals(broken_signals(spark, sf))[0].groupBy("kind").agg(F.count("*").alias("n"))


def page_events(spark, sf) -> DataFrame:
    """Events grouped by the hour as pages of their type; users repeat within a page."""
    e = v.table(spark, sf, "events")
    return e.select(
        (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("bigint").alias("page_id"),
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("id"),
        F.lit("events").alias("source"),
        F.when(F.col("user_id") < 3, "stray").otherwise("all").alias("source_instance"),
        F.lit("other").alias("kind"), F.lit(1).alias("schema_version"), F.lit("https://x.example.org").alias("url"),
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )


def pages(spark, sf) -> DataFrame:
    """One page per hour; its counts, cursors and rate limit come from the hour's events."""
    e = v.table(spark, sf, "events").select(
        (F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("bigint").alias("page_id"), "event_type", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    g = e.groupBy("page_id").agg(
        F.count("*").alias("n"), F.max("k").alias("k"), F.max("user_id").alias("u"), F.count_if(F.col("event_type") == "error").alias("bad")
    )
    return g.select(
        "page_id", F.lit("events:all").alias("source_key"), F.lit(14).cast("bigint").alias("limit"),
        F.when(F.col("n") == 5, -1).otherwise(F.col("n")).alias("primary_count"),
        (F.col("k") % 2 == 0).alias("has_more"),
        F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("bad") > 5, "other:x").otherwise("events:all").alias("cursor_key"),
        F.when(F.col("u") % 13 == 0, "other:y").otherwise("events:all").alias("previous_key"),
        F.struct(
            (F.col("k") - 80).alias("limit"), (F.col("k") - 90).alias("remaining"),
            F.lit(None).cast("timestamp").alias("reset_at"), F.col("bad").cast("double").alias("retry_after"),
        ).alias("rate_limit"),
    )


def ownership(spark, sf):
    return ct.check_ownership(page_events(spark, sf), pages(spark, sf))


def uniqueness(spark, sf):
    return ct.check_unique(page_events(spark, sf))


def invariants(spark, sf):
    return ct.check_pages(pages(spark, sf))


def quarantine(spark, sf):
    events, good, _ = ct.quarantine_pages(page_events(spark, sf), pages(spark, sf))
    return good.select("page_id").join(events.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left")


def identities(spark, sf):
    """Customers of a segment as sources, parts as sinks: names that are configured twice."""
    sources = v.table(spark, sf, "customer").select(
        F.concat_ws(":", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("source_key")
    )
    sinks = v.table(spark, sf, "region").unionByName(v.table(spark, sf, "region")).select(F.col("r_name").alias("sink_key"))
    return ct.check_identities(sources, sinks)


def _tables(spark, sf) -> dict[str, DataFrame]:
    signals = v.doc_signals(spark, sf)
    bad = signals.withColumn("kind", F.when(F.col("source_instance") == "de", "essay").otherwise(F.col("kind")))
    sinks = v.doc_sinks(spark, sf)
    return {
        "signals": bad.drop("seq"),
        "source_health": r.health(spark, sf),
        "delivery_sinks": sinks.unionByName(sinks.filter("NOT enabled")),
        "deliveries": r.folded(spark, sf),
    }


def integrity(spark, sf):
    return vf.integrity(_tables(spark, sf))


def verification(spark, sf):
    return rp.verification_summary(vf.integrity(_tables(spark, sf)))


def orphans(spark, sf):
    return vf.orphans(v.pass_deliveries(spark, sf), v.order_signals(spark, sf))


def digest(spark, sf):
    """Two orders of the same rows have one digest, a changed row has another."""
    d = v.doc_signals(spark, sf)
    a = st.table_digest(d)
    b = st.table_digest(d.repartition("id"))
    c = st.table_digest(d.withColumn("title", F.when(F.col("seq") == 0, "x").otherwise(F.col("title"))))
    key = F.concat_ws("/", "n", "x", "s")
    return a.select(
        "n",
        (key == b.select(key).scalar()).alias("same"),
        (key == c.select(key).scalar()).alias("same_after_change"),
    )


_PAGES = """page_events AS (SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS page_id, event_type || '-' || user_id AS id,
    CASE WHEN user_id < 3 THEN 'events:stray' ELSE 'events:all' END AS k FROM events),
pages AS (SELECT page_id, 'events:all' AS source_key, CASE WHEN n = 5 THEN -1 ELSE n END AS primary_count, k % 2 = 0 AS has_more,
    CASE WHEN k % 3 = 0 THEN NULL WHEN bad > 5 THEN 'other:x' ELSE 'events:all' END AS cursor_key,
    CASE WHEN u % 13 = 0 THEN 'other:y' ELSE 'events:all' END AS previous_key, k - 80 AS lim, k - 90 AS rem FROM (
    SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS page_id, count(*) AS n, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k,
      max(user_id) AS u, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1)),
owner AS (SELECT e.page_id, e.id AS event_id, 'ownership' AS rule,
    'id ''' || e.id || ''' comes from ''' || e.k || ''', the page is for ''' || p.source_key || '''' AS message
    FROM page_events e JOIN pages p USING (page_id) WHERE e.k <> p.source_key),
twice AS (SELECT page_id, id AS event_id, 'unique' AS rule, 'id ''' || id || ''' stands on its page more than once' AS message
    FROM page_events GROUP BY page_id, id HAVING count(*) > 1),
broken AS (SELECT page_id, CAST(NULL AS VARCHAR) AS event_id, 'page' AS rule, message FROM (
    SELECT page_id, unnest(list_filter([
      CASE WHEN primary_count < 0 THEN 'negative item count' END,
      CASE WHEN primary_count > 14 THEN 'more items than asked for' END,
      CASE WHEN has_more AND cursor_key IS NULL THEN 'more pages announced without a cursor' END,
      CASE WHEN cursor_key <> source_key THEN 'new cursor of a foreign source' END,
      CASE WHEN previous_key <> source_key THEN 'old cursor of a foreign source' END,
      CASE WHEN lim < 0 THEN 'negative rate limit' END,
      CASE WHEN rem < 0 THEN 'negative rate-limit remainder' END], lambda m: m IS NOT NULL)) AS message FROM pages))"""

_BROKEN = """, broken AS (SELECT * REPLACE (CASE WHEN author IS NULL THEN ' ' ELSE url END AS url,
    CASE WHEN source_instance = 'es' THEN 'essay' ELSE kind END AS kind, CASE WHEN updated_at IS NULL THEN 0 ELSE 1 END AS schema_version) FROM sig)"""


def _integrity_sql() -> str:
    zero = [f"{t}.{c} not null" for t in ("signals", "source_health", "delivery_sinks", "deliveries") for c in REQUIRED[t]]
    zero += ["signals primary key unique", "source_health primary key unique", "deliveries primary key unique",
             "source_health.status known value", "deliveries.status known value"]
    values = ", ".join(f"('{c}')" for c in zero)
    return with_parts("deliveries", f"""SELECT "check", bad, status FROM (
      SELECT c AS "check", CAST(0 AS BIGINT) AS bad, 'pass' AS status FROM (VALUES {values}) t(c)
      UNION ALL SELECT 'signals.kind known value', count(*), CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END FROM documents WHERE lang = 'de'
      UNION ALL SELECT 'delivery_sinks primary key unique', 1, 'fail'
      UNION ALL SELECT 'deliveries have their event', count(*), CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END FROM deliveries)""")


QUERIES = {
    "row_validity": (
        row_validity,
        with_parts("sig", f"""{_BROKEN} SELECT id, unnest(list_filter([
          CASE WHEN trim(url) = '' THEN 'url is blank' END,
          CASE WHEN schema_version < 1 THEN 'schema version below one' END,
          CASE WHEN kind = 'essay' THEN 'kind is not known' END], lambda m: m IS NOT NULL)) AS reason FROM broken"""),
    ),
    "valid_rows": (
        valid_rows,
        with_parts("sig", f"{_BROKEN} SELECT kind, count(*) AS n FROM broken WHERE trim(url) <> '' AND schema_version >= 1 AND kind <> 'essay' GROUP BY 1"),
    ),
    "page_ownership": (ownership, f"WITH {_PAGES} SELECT * FROM owner"),
    "page_uniqueness": (uniqueness, f"WITH {_PAGES} SELECT * FROM twice"),
    "page_invariants": (invariants, f"WITH {_PAGES} SELECT * FROM broken"),
    "page_quarantine": (
        quarantine,
        f"""WITH {_PAGES} SELECT page_id, count(*) AS n FROM page_events WHERE page_id NOT IN (
          SELECT page_id FROM owner UNION ALL SELECT page_id FROM twice UNION ALL SELECT page_id FROM broken) GROUP BY 1""",
    ),
    "identity_uniqueness": (
        identities,
        """SELECT 'source' AS what, lower(c_mktsegment) || ':' || c_nationkey AS key, count(*) AS n FROM customer GROUP BY 2 HAVING count(*) > 1
        UNION ALL SELECT 'sink', r_name, 2 * count(*) FROM region GROUP BY 2""",
    ),
    "table_integrity": (integrity, _integrity_sql()),
    "verification_summary": (
        verification,
        'SELECT count(*) FILTER (WHERE status = \'pass\') AS pass, count(*) FILTER (WHERE status = \'warn\') AS warn, '
        'count(*) FILTER (WHERE status = \'fail\') AS fail, bool_and(status <> \'fail\') AS ok FROM (' + _integrity_sql() + ")",
    ),
    "orphan_deliveries": (
        orphans,
        with_parts("pass", "SELECT sink_key, event_id FROM pass_deliveries WHERE event_id NOT IN (SELECT id FROM order_signals)"),
    ),
    "snapshot_digest": (
        digest, "SELECT count(*) AS n, true AS same, false AS same_after_change FROM documents",
    ),
}
