"""Queries on incremental selection and cursor state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.catalog import payloads as p
from rillflow.catalog import views as v
from rillflow.catalog.twins import iso, iso_micros, with_parts
from rillflow.functions import iso_utc, parse_cursor
from rillflow.operators import checkpoints as cp
from rillflow.operators import incremental as inc
from rillflow.sources import stories

ITEMS = ("source_key", "poll_id", "pos", "external_id")
NOW = "2024-03-01 00:00:00"


def _items(spark, sf) -> DataFrame:
    return v.poll_items(spark, sf)


def _polls(spark, sf) -> DataFrame:
    """Every poll of the items, a third of them with an entry at the end that is no item, and an empty one per source."""
    items = _items(spark, sf)
    some = items.groupBy("source_key", "poll_id").agg((F.max("pos") + 1).alias("n")).select(
        "source_key", "poll_id", (F.col("n") + (F.col("poll_id") % 3 == 0).cast("int")).cast("bigint").alias("page_items")
    )
    none = items.select("source_key").distinct().select("source_key", F.lit(-1).cast(items.schema["poll_id"].dataType).alias("poll_id"), F.lit(0).cast("bigint").alias("page_items"))
    return some.unionByName(none)


def _seen(spark, sf) -> DataFrame:
    return v.seen_items(spark, sf)


def _sources(spark, sf) -> DataFrame:
    """Sources are initialised, but for those in Spanish."""
    return _items(spark, sf).select("source_key").distinct().withColumn(
        "initialized", ~F.col("source_key").endswith(":es")
    )


def _cursors(spark, sf) -> DataFrame:
    """Half-read feeds: a third have the right anchor, a third a moved one, the rest none."""
    s = F.length("source_key") + F.ascii(F.substring("source_key", 4, 1))
    first = _items(spark, sf).filter("poll_id = 0").groupBy("source_key").agg(
        F.min_by("external_id", "pos").alias("anchor"), F.min("pos").alias("at")
    )
    return first.select(
        "source_key",
        F.when(s % 3 == 2, 600).otherwise(F.col("at") + 1).cast("bigint").alias("offset"),
        F.when(s % 3 == 0, F.col("anchor")).when(s % 3 == 1, "gone").alias("page_anchor"),
        v.ts("2024-01-02 12:00:00").alias("watermark"),
        (s % 2 == 0).alias("done"),
    )


def skip_seen(spark, sf):
    return inc.skip_seen(_items(spark, sf), _seen(spark, sf), 5)[0].select(*ITEMS)


def skip_seen_pages(spark, sf):
    return inc.skip_seen(_items(spark, sf), _seen(spark, sf), 5, _polls(spark, sf))[1]


def until_known(spark, sf):
    seen = _seen(spark, sf)
    return inc.take_until_known(_items(spark, sf), seen.filter("toxic = 1"), seen, 12)[0].select(*ITEMS)


def until_known_pages(spark, sf):
    seen = _seen(spark, sf)
    return inc.take_until_known(_items(spark, sf), seen.filter("toxic = 1"), seen, 12, _polls(spark, sf))[1]


def until_known_page(spark, sf):
    seen = _seen(spark, sf)
    return inc.take_until_known_page(_items(spark, sf), seen.filter("toxic = 1"), seen, _polls(spark, sf))[1]


def take_new(spark, sf):
    seen = _seen(spark, sf)
    args = (_items(spark, sf), seen.filter("quality = 1"), seen.filter("toxic = 1"), _sources(spark, sf), 4)
    return inc.take_new(*args)[0].select(*ITEMS)


def take_new_pages(spark, sf):
    seen = _seen(spark, sf)
    args = (_items(spark, sf), seen.filter("quality = 1"), seen.filter("toxic = 1"), _sources(spark, sf), 4)
    return inc.take_new(*args, _polls(spark, sf))[1]


def _processed(spark, sf) -> DataFrame:
    return _items(spark, sf).select("source_key", "external_id", F.col("external_id").cast("bigint").alias("pos"))


def merge_seen(spark, sf):
    return inc.merge_seen(_seen(spark, sf), _processed(spark, sf), 50, True).select("source_key", "external_id", F.col("rank").cast("bigint").alias("rank"))


def merge_seen_continued(spark, sf):
    return inc.merge_seen(_seen(spark, sf), _processed(spark, sf), 2000, False).select("source_key", "external_id", F.col("rank").cast("bigint").alias("rank"))


def anchors(spark, sf):
    return inc.validate_anchor(_items(spark, sf), _cursors(spark, sf), _polls(spark, sf))


def page_slices(spark, sf):
    starts = inc.validate_anchor(_items(spark, sf), _cursors(spark, sf))
    return inc.page_slice(_items(spark, sf), starts, 100)[1]


def page_slice_items(spark, sf):
    starts = inc.validate_anchor(_items(spark, sf), _cursors(spark, sf))
    return inc.page_slice(_items(spark, sf), starts, 100)[0].select(*ITEMS)


def watermark(spark, sf):
    out = inc.advance_watermark(_items(spark, sf), _cursors(spark, sf), F.col("done"))
    return out.select("source_key", iso_utc(F.col("watermark")).alias("watermark"))


def overlap(spark, sf):
    return inc.since_watermark(_items(spark, sf), _cursors(spark, sf)).select(*ITEMS)


def _event_pages(spark, sf) -> DataFrame:
    """Events as fetched pages; every field a cursor rule reads comes from the event."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    return v.table(spark, sf, "events").select(
        e.alias("event_id"), (e % 10 + 1).alias("page"), F.lit(30).cast("bigint").alias("per_page"),
        F.least(k, F.lit(30)).alias("end_offset"), F.when(k > 20, 30).otherwise(k).cast("bigint").alias("page_items"),
        F.when(F.col("user_id") % 7 != 0, F.col("user_id") * 10).alias("total_count"),
        v.ts("2024-01-05 00:00:00").alias("watermark"), F.col("ts").cast("timestamp").alias("batch_watermark"),
        (F.col("event_type") == "view").alias("reached_known"), (F.col("event_type") == "click").alias("initialized"),
        (F.col("event_type") == "error").alias("backfill"), (k % 4 != 0).alias("fully_scanned"),
        F.least(k, F.lit(30)).alias("next_offset"), F.concat(F.lit("p"), e.cast("string")).alias("page_url"),
        F.when(k % 3 == 0, F.concat(F.lit("n"), e.cast("string"))).alias("next_url"),
        F.when(k % 3 == 1, F.concat(F.lit("t3_"), e.cast("string"))).alias("after"),
        k.alias("count"), (k % 5).alias("primary_count"),
        F.concat(F.lit("a"), e.cast("string")).alias("api_cursor"),
        F.when(k % 6 != 0, F.concat(F.lit("b"), e.cast("string"))).alias("next_cursor"),
    )


def search_state(spark, sf):
    return inc.next_search_state(_event_pages(spark, sf)).select(
        "event_id", "has_more", "next_page", "next_offset", iso_utc(F.col("next_watermark")).alias("next_watermark")
    )


def feed_state(spark, sf):
    return inc.next_feed_state(_event_pages(spark, sf)).select(
        "event_id", "cursor_url", "cursor_offset", "has_more", "keeps_watermark"
    )


def listing_state(spark, sf):
    return inc.next_listing_state(_event_pages(spark, sf)).select("event_id", "next_after", "has_more", "next_count")


def mapped_state(spark, sf):
    return inc.next_mapped_state(_event_pages(spark, sf), "cursor").select(
        "event_id", "complete", "has_more", "next_page", "next_api_cursor", "next_initialized"
    )


def mapped_state_paged(spark, sf):
    return inc.next_mapped_state(_event_pages(spark, sf), "page").select(
        "event_id", "complete", "next_page", "next_initialized"
    )


def newest_children(spark, sf):
    return inc.top_k_children(v.conversations(spark, sf), 2, "newest").select(
        "parent_id", "child_id", F.col("rank").cast("int").alias("rank")
    )


def highest_children(spark, sf):
    kids = stories.kid_ids(stories.parse_items(p.story_payloads(spark, sf))[0]).withColumn("source_key", F.lit("s"))
    return inc.top_k_children(kids, 2, "highest").select("parent_id", "child_id", F.col("rank").cast("int").alias("rank"))


def first_children(spark, sf):
    return inc.top_k_children(v.conversations(spark, sf), 3, "first").select("parent_id", "child_id")


def refresh(spark, sf):
    processed = _seen(spark, sf).filter("quality = 0")
    return inc.refresh_candidates(_seen(spark, sf), processed, 10).select("source_key", "external_id")


def drained(spark, sf):
    return inc.drain_pages(v.paged_events(spark, sf), 150, 6)[1]


def drained_pages(spark, sf):
    return inc.drain_pages(v.paged_events(spark, sf), 150, 6)[0].select("run_id", "page_no")


def _checkpoints(spark, sf) -> DataFrame:
    """The customers of the first nations have a checkpoint from an earlier run."""
    c = v.table(spark, sf, "customer").filter("c_nationkey < 15")
    return c.select(
        F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("source_key"),
        F.concat(F.lit('{"source_key":"cust:'), F.col("c_custkey").cast("string"), F.lit('","state":{"page":1},"version":1}')).alias("cursor_json"),
        v.ts("2024-01-01 00:00:00").alias("updated_at"), v.ts("2024-01-01 00:00:00").alias("last_success_at"),
        F.when(F.col("c_acctbal") < 0, "earlier error").alias("last_error"),
    )


def _checkpoint_updates(spark, sf) -> DataFrame:
    """Orders as pages of their customer; those in process carry no cursor."""
    o = F.col("o_orderkey").cast("string")
    key = F.concat(F.lit("cust:"), F.col("o_custkey").cast("string"))
    return v.table(spark, sf, "orders").select(
        key.alias("source_key"), F.col("o_orderkey").alias("page_no"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.concat(F.lit('{"source_key":"'), F.when(F.col("o_orderpriority") == "1-URGENT", "other").otherwise(key), F.lit('","state":{"page":'), o, F.lit('},"version":1}')),
        ).alias("cursor_json"),
    )


def checkpoints(spark, sf):
    good = _checkpoint_updates(spark, sf)
    good = good.join(cp.foreign_cursors(good).select("page_no"), "page_no", "left_anti")
    out = cp.apply_checkpoints(_checkpoints(spark, sf), good, v.ts(NOW))
    return out.select(
        "source_key", "cursor_json", iso_utc(F.col("updated_at")).alias("updated_at"),
        iso_utc(F.col("last_success_at")).alias("last_success_at"), "last_error",
    )


def foreign_cursors(spark, sf):
    return cp.foreign_cursors(_checkpoint_updates(spark, sf)).select("page_no", "source_key")


def failures(spark, sf):
    bad = v.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("source_key"),
        F.col("o_orderkey").alias("run_id"), F.concat(F.lit("timeout "), F.col("o_orderkey").cast("string")).alias("error"),
    )
    out = cp.record_failures(_checkpoints(spark, sf), bad, v.ts(NOW))
    return out.select(
        "source_key", "cursor_json", iso_utc(F.col("updated_at")).alias("updated_at"),
        iso_utc(F.col("last_success_at")).alias("last_success_at"), "last_error",
    )


def cursor_texts(spark, sf):
    rows = _checkpoint_updates(spark, sf).withColumn(
        "cursor_json", F.when(F.col("cursor_json").isNull(), F.concat(F.lit("["), F.col("page_no").cast("string"), F.lit("]"))).otherwise(F.col("cursor_json"))
    ).withColumn("c", parse_cursor(F.col("cursor_json")))
    return rows.select("page_no", "c.source_key", "c.state_json", "c.version", "c.valid")


def fresh_run(spark, sf):
    """A run that resumes has a cursor for every stored checkpoint, a fresh one has none."""
    stored = _checkpoints(spark, sf)
    return inc.stored_cursors(stored).agg(F.count("*").alias("resumed")).withColumn(
        "fresh", inc.stored_cursors(stored, resume=False).agg(F.count("*")).scalar()
    )


_ANCHOR = """, cur AS (
  SELECT source_key, CASE WHEN s % 3 = 2 THEN 600 ELSE at0 + 1 END AS off,
    CASE WHEN s % 3 = 0 THEN anchor WHEN s % 3 = 1 THEN 'gone' END AS anchor, s % 2 = 0 AS done
  FROM (SELECT source_key, arg_min(external_id, pos) AS anchor, min(pos) AS at0,
    length(source_key) + ascii(substr(source_key, 4, 1)) AS s FROM polls WHERE poll_id = 0 GROUP BY 1)),
sizes AS (SELECT source_key, poll_id, count(*) AS entries FROM polls GROUP BY 1, 2),
hit AS (SELECT p.source_key, p.poll_id, min(p.pos) AS apos FROM polls p JOIN cur c ON c.source_key = p.source_key AND c.anchor = p.external_id GROUP BY 1, 2),
starts AS (SELECT source_key, poll_id, entries,
    CAST(CASE WHEN moved OR beyond THEN 0 ELSE off END AS BIGINT) AS start, moved, beyond
  FROM (SELECT z.source_key, z.poll_id, entries, coalesce(off, 0) AS off,
    coalesce(off, 0) > 0 AND coalesce(anchor, '') <> '' AND apos IS DISTINCT FROM off - 1 AS moved,
    NOT (coalesce(off, 0) > 0 AND coalesce(anchor, '') <> '') AND coalesce(off, 0) > entries AS beyond
  FROM sizes z LEFT JOIN cur c USING (source_key) LEFT JOIN hit h ON h.source_key = z.source_key AND h.poll_id = z.poll_id))"""

_EVERY = """, every AS (SELECT source_key, poll_id, max(pos) + 1 + CASE WHEN poll_id % 3 = 0 THEN 1 ELSE 0 END AS page_items FROM polls GROUP BY 1, 2
  UNION ALL SELECT DISTINCT source_key, -1, 0 FROM polls)"""

_FRESH = """, fresh AS (SELECT *, row_number() OVER (PARTITION BY source_key, poll_id ORDER BY pos) AS rn FROM polls p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_key = p.source_key AND s.external_id = p.external_id))"""

_UNTIL = """, head AS (SELECT p.*, coalesce(s.toxic = 1, false) AS known, s.external_id IS NOT NULL AS was_seen,
    row_number() OVER (PARTITION BY p.source_key, poll_id ORDER BY pos) AS rn
    FROM polls p LEFT JOIN seen s ON s.source_key = p.source_key AND s.external_id = p.external_id),
cut AS (SELECT *, min(CASE WHEN known THEN pos END) OVER (PARTITION BY source_key, poll_id) AS first FROM head {where})"""

_NEW = """, uncycled AS (SELECT p.*, coalesce(s.quality = 1, false) AND NOT ends_with(p.source_key, ':es') AS known,
    row_number() OVER (PARTITION BY p.source_key, poll_id ORDER BY pos) AS rn
    FROM polls p LEFT JOIN seen s ON s.source_key = p.source_key AND s.external_id = p.external_id
    WHERE coalesce(s.toxic, 0) <> 1),
cut AS (SELECT *, min(CASE WHEN known THEN rn END) OVER (PARTITION BY source_key, poll_id) AS first FROM uncycled WHERE rn <= 5)"""

_STATE = """WITH pg AS (SELECT event_id AS e, event_id % 10 + 1 AS page, 30 AS per_page, least(k, 30) AS end_offset,
    CASE WHEN k > 20 THEN 30 ELSE k END AS page_items, CASE WHEN user_id % 7 <> 0 THEN user_id * 10 END AS total_count,
    event_type, k, ts FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""

_DRAIN = """, flagged AS (SELECT *, NOT has_more OR primary_count = 0 OR cursor_json = before OR total >= 150 AS stop,
    cursor_json = before AS stuck FROM (
    SELECT *, coalesce(lag(cursor_json) OVER w, 'c0') AS before, sum(primary_count) OVER w AS total FROM event_pages
    WHERE page_no <= 6 WINDOW w AS (PARTITION BY run_id ORDER BY page_no))),
taken AS (SELECT * FROM (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY run_id ORDER BY page_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM flagged) WHERE NOT earlier)"""

_CUR = """WITH upd AS (SELECT 'cust:' || o_custkey AS source_key, o_orderkey AS page_no, o_orderpriority = '1-URGENT' AS is_foreign,
    CASE WHEN o_orderstatus <> 'P' THEN '{"source_key":"' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'other' ELSE 'cust:' || o_custkey END
      || '","state":{"page":' || o_orderkey || '},"version":1}' END AS cursor_json FROM orders),
stored AS (SELECT 'cust:' || c_custkey AS source_key, '{"source_key":"cust:' || c_custkey || '","state":{"page":1},"version":1}' AS cursor_json,
    '2024-01-01T00:00:00+00:00' AS updated_at, '2024-01-01T00:00:00+00:00' AS last_success_at,
    CASE WHEN c_acctbal < 0 THEN 'earlier error' END AS last_error FROM customer WHERE c_nationkey < 15)"""

QUERIES = {
    "skip_seen": (skip_seen, with_parts("polls", f"{_FRESH} SELECT source_key, poll_id, pos, external_id FROM fresh WHERE rn <= 5")),
    "skip_seen_pages": (
        skip_seen_pages,
        with_parts("polls", f"""{_FRESH} {_EVERY} SELECT source_key, poll_id, least(coalesce(n, 0), 5) AS primary_count, coalesce(n, 0) > 5 AS has_more
          FROM every LEFT JOIN (SELECT source_key, poll_id, count(*) AS n FROM fresh GROUP BY 1, 2) USING (source_key, poll_id)"""),
    ),
    "take_until_known": (
        until_known,
        with_parts("polls", _UNTIL.format(where="WHERE rn <= 12") + " SELECT source_key, poll_id, pos, external_id FROM cut WHERE (first IS NULL OR pos < first) AND NOT was_seen"),
    ),
    "take_until_known_pages": (
        until_known_pages,
        with_parts("polls", _UNTIL.format(where="WHERE rn <= 12") + _EVERY + """ SELECT source_key, poll_id, coalesce(n, 0) AS primary_count,
          coalesce(e, 0) AS emitted, coalesce(k, false) AS reached_known, CAST(coalesce(stop + 1, page_items) AS BIGINT) AS next_offset
          FROM every LEFT JOIN (SELECT source_key, poll_id, count(*) FILTER (WHERE first IS NULL OR pos < first) AS n,
            count(*) FILTER (WHERE (first IS NULL OR pos < first) AND NOT was_seen) AS e, bool_or(known) AS k,
            coalesce(max(first), CASE WHEN count(*) = 12 THEN max(pos) END) AS stop FROM cut GROUP BY 1, 2) USING (source_key, poll_id)"""),
    ),
    "take_until_known_listing": (
        until_known_page,
        with_parts("polls", _UNTIL.format(where="") + _EVERY + """ SELECT source_key, poll_id, coalesce(n, 0) AS primary_count, coalesce(e, 0) AS emitted,
          coalesce(k, false) AS reached_known FROM every LEFT JOIN (SELECT source_key, poll_id, count(*) FILTER (WHERE first IS NULL OR pos < first) AS n,
            count(*) FILTER (WHERE (first IS NULL OR pos < first) AND NOT was_seen) AS e, max(first) IS NOT NULL AS k FROM cut GROUP BY 1, 2)
          USING (source_key, poll_id)"""),
    ),
    "take_new": (take_new, with_parts("polls", _NEW + " SELECT source_key, poll_id, pos, external_id FROM cut WHERE rn <= 4 AND (first IS NULL OR rn < first)")),
    "take_new_pages": (
        take_new_pages,
        with_parts("polls", _NEW + _EVERY + """ SELECT source_key, poll_id, coalesce(n, 0) AS primary_count, coalesce(k, false) AS reached_known,
          coalesce(w, true) AS fully_scanned FROM every LEFT JOIN (SELECT source_key, poll_id,
            count(*) FILTER (WHERE rn <= 4 AND (first IS NULL OR rn < first)) AS n, max(first) IS NOT NULL AS k,
            max(first) IS NOT NULL OR max(rn) <= 4 AS w FROM cut GROUP BY 1, 2) USING (source_key, poll_id)"""),
    ),
    "merge_seen": (
        merge_seen,
        with_parts("polls", """SELECT source_key, external_id, rn AS rank FROM (SELECT source_key, external_id,
          row_number() OVER (PARTITION BY source_key ORDER BY doc_id) AS rn FROM polls) WHERE rn <= 50"""),
    ),
    "merge_seen_continued": (
        merge_seen_continued,
        with_parts("polls", """SELECT source_key, external_id, rn AS rank FROM (SELECT p.source_key, p.external_id,
          row_number() OVER (PARTITION BY p.source_key ORDER BY s.external_id IS NULL, doc_id) AS rn
          FROM polls p LEFT JOIN seen s ON s.source_key = p.source_key AND s.external_id = p.external_id) WHERE rn <= 2000"""),
    ),
    "anchor_check": (
        anchors,
        with_parts("polls", _ANCHOR.replace("GROUP BY 1, 2),\nhit", "GROUP BY 1, 2 UNION ALL SELECT DISTINCT source_key, -1, 0 FROM polls),\nhit") + f""" SELECT source_key, poll_id, entries, start, CASE WHEN moved THEN '{inc.ANCHOR_MOVED}'
          WHEN beyond THEN '{inc.OFFSET_BEYOND}' END AS warning FROM starts"""),
    ),
    "page_slices": (
        page_slices,
        with_parts("polls", _ANCHOR + """ SELECT source_key, poll_id, n AS primary_count, start + n < entries AS has_more,
          CASE WHEN start + n < entries THEN start + n ELSE 0 END AS next_offset, CASE WHEN start + n < entries THEN anchor END AS page_anchor
          FROM (SELECT t.source_key, t.poll_id, start, entries, count(p.pos) AS n, arg_max(p.external_id, p.pos) AS anchor FROM starts t
            LEFT JOIN polls p ON p.source_key = t.source_key AND p.poll_id = t.poll_id AND p.pos >= start AND p.pos < start + 100 GROUP BY 1, 2, 3, 4)"""),
    ),
    "page_slice_items": (
        page_slice_items,
        with_parts("polls", _ANCHOR + """ SELECT p.source_key, p.poll_id, p.pos, p.external_id FROM starts t
          JOIN polls p ON p.source_key = t.source_key AND p.poll_id = t.poll_id AND p.pos >= start AND p.pos < start + 100"""),
    ),
    "high_water_mark": (
        watermark,
        with_parts("polls", _ANCHOR + f""" SELECT source_key, {iso("CASE WHEN coalesce(done, true) THEN greatest(CASE WHEN done IS NOT NULL THEN TIMESTAMP '2024-01-02 12:00:00' END, newest) ELSE TIMESTAMP '2024-01-02 12:00:00' END")} AS watermark
          FROM (SELECT source_key, max(coalesce(updated_at, created_at)) AS newest FROM polls GROUP BY 1) LEFT JOIN cur USING (source_key)"""),
    ),
    "inclusive_overlap": (
        overlap,
        with_parts("polls", _ANCHOR + """ SELECT p.source_key, poll_id, pos, external_id FROM polls p LEFT JOIN cur c USING (source_key)
          WHERE c.source_key IS NULL OR coalesce(updated_at, created_at) >= TIMESTAMP '2024-01-02 12:00:00'"""),
    ),
    "next_search_state": (
        search_state,
        _STATE + f""" SELECT e AS event_id, rest OR onward AS has_more, CASE WHEN rest THEN page WHEN onward THEN page + 1 ELSE 1 END AS next_page,
          CASE WHEN rest THEN end_offset ELSE 0 END AS next_offset,
          CASE WHEN rest OR onward OR ts < TIMESTAMP '2024-01-05 00:00:00' THEN '2024-01-05T00:00:00+00:00' ELSE {iso_micros('ts')} END AS next_watermark
          FROM (SELECT *, end_offset < page_items AS rest,
            page_items > 0 AND page_items = per_page AND page * per_page < least(coalesce(total_count, page_items), 1000) AS onward FROM pg)""",
    ),
    "next_feed_state": (
        feed_state,
        _STATE + """ SELECT e AS event_id, CASE WHEN rest THEN 'p' || e WHEN event_type <> 'view' AND k % 3 = 0 THEN 'n' || e END AS cursor_url,
          CASE WHEN rest THEN end_offset ELSE 0 END AS cursor_offset, rest OR (event_type <> 'view' AND k % 3 = 0) AS has_more,
          rest OR (event_type <> 'view' AND k % 3 = 0) AS keeps_watermark FROM (SELECT *, event_type <> 'view' AND end_offset < page_items AS rest FROM pg)""",
    ),
    "next_listing_state": (
        listing_state,
        _STATE + """ SELECT e AS event_id, CASE WHEN more THEN 't3_' || e END AS next_after, more AS has_more,
          CASE WHEN more THEN k + k % 5 ELSE 0 END AS next_count FROM (SELECT *, event_type <> 'view' AND k % 3 = 1 AS more FROM pg)""",
    ),
    "next_mapped_state": (
        mapped_state,
        _STATE + """ SELECT e AS event_id, done AS complete, NOT done AS has_more, CASE WHEN done THEN 1 ELSE page END AS next_page,
          CASE WHEN done THEN NULL WHEN scanned THEN CASE WHEN k % 6 <> 0 THEN 'b' || e END ELSE 'a' || e END AS next_api_cursor,
          done OR event_type = 'click' AS next_initialized FROM (SELECT *, k % 4 <> 0 AS scanned,
            (event_type <> 'click' AND event_type <> 'error') OR event_type = 'view' OR (k % 4 <> 0 AND k % 6 = 0) AS done FROM pg)""",
    ),
    "next_mapped_state_paged": (
        mapped_state_paged,
        _STATE + """ SELECT e AS event_id, done AS complete, CASE WHEN done THEN 1 WHEN scanned THEN page + 1 ELSE page END AS next_page,
          done OR event_type = 'click' AS next_initialized FROM (SELECT *, k % 4 <> 0 AS scanned,
            (event_type <> 'click' AND event_type <> 'error') OR event_type = 'view' OR (k % 4 <> 0 AND page_items = 0) AS done FROM pg)""",
    ),
    "newest_children": (
        newest_children,
        with_parts("turns", """SELECT parent_id, child_id, CAST(rn AS INTEGER) AS rank FROM (SELECT *,
          row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC, child_id DESC) AS rn FROM turns) WHERE rn <= 2"""),
    ),
    "highest_children": (
        highest_children,
        """SELECT CAST(conv_id * 100 AS VARCHAR) AS parent_id, conv_id * 100 + t AS child_id, CAST(last - t + 1 AS INTEGER) AS rank
          FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1), generate_series(1, 1000) g(t)
          WHERE t <= last AND last - t < 2 AND (conv_id * 100) % 90 <> 1""",
    ),
    "first_children": (first_children, with_parts("turns", "SELECT parent_id, child_id FROM turns WHERE pos < 3")),
    "refresh_candidates": (
        refresh,
        with_parts("polls", """SELECT source_key, external_id FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY rank) AS rn
          FROM seen WHERE quality <> 0) WHERE rn <= 10"""),
    ),
    "drain_runs": (
        drained,
        with_parts("event_pages", _DRAIN + """ SELECT source_key, run_id, count(*) AS pages, CAST(sum(primary_count) AS BIGINT) AS primary_count,
          arg_max(has_more, page_no) AS has_more, arg_max(cursor_json, page_no) AS cursor_json,
          arg_max(CASE WHEN has_more AND primary_count = 0 THEN 'a page without items announced another one; the run ends here'
            WHEN has_more AND stuck THEN 'the page left the cursor where it was; the run ends here' END, CASE WHEN has_more AND (primary_count = 0 OR stuck) THEN page_no END) AS stop_warning,
          CASE WHEN count(*) >= 6 AND arg_max(has_more, page_no) THEN 'stopped after max_pages=6' END AS depth_warning FROM taken GROUP BY 1, 2"""),
    ),
    "drain_pages": (drained_pages, with_parts("event_pages", _DRAIN + " SELECT run_id, page_no FROM taken")),
    "apply_checkpoints": (
        checkpoints,
        _CUR + """ SELECT source_key, arg_max(cursor_json, page_no) AS cursor_json, '2024-03-01T00:00:00+00:00' AS updated_at,
          '2024-03-01T00:00:00+00:00' AS last_success_at, CAST(NULL AS VARCHAR) AS last_error FROM upd WHERE cursor_json IS NOT NULL AND NOT is_foreign GROUP BY 1
          UNION ALL SELECT * FROM stored WHERE source_key NOT IN (SELECT source_key FROM upd WHERE cursor_json IS NOT NULL AND NOT is_foreign)""",
    ),
    "foreign_cursors": (foreign_cursors, _CUR + " SELECT page_no, source_key FROM upd WHERE cursor_json IS NOT NULL AND is_foreign"),
    "record_failures": (
        failures,
        _CUR + """, bad AS (SELECT source_key, 'timeout ' || max(page_no) AS error FROM upd WHERE cursor_json IS NULL GROUP BY 1)
          SELECT coalesce(s.source_key, b.source_key) AS source_key,
            coalesce(cursor_json, '{"source_key":"' || b.source_key || '","state":{},"version":1}') AS cursor_json,
            CASE WHEN b.source_key IS NOT NULL THEN '2024-03-01T00:00:00+00:00' ELSE updated_at END AS updated_at,
            last_success_at, CASE WHEN b.source_key IS NOT NULL THEN error ELSE last_error END AS last_error
          FROM stored s FULL JOIN bad b ON b.source_key = s.source_key""",
    ),
    "cursor_texts": (
        cursor_texts,
        _CUR + """ SELECT page_no, CASE WHEN cursor_json IS NOT NULL THEN CASE WHEN is_foreign THEN 'other' ELSE source_key END END AS source_key,
          CASE WHEN cursor_json IS NOT NULL THEN '{"page":' || page_no || '}' ELSE '{}' END AS state_json, 1 AS version,
          cursor_json IS NOT NULL AS valid FROM upd""",
    ),
    "fresh_run": (fresh_run, "SELECT count(*) AS resumed, CAST(0 AS BIGINT) AS fresh FROM customer WHERE c_nationkey < 15"),
}
