"""Queries on search, lists and text views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillflow.catalog import views as v
from rillflow.catalog.twins import iso, with_parts
from rillflow.functions import html_to_text, iso_utc
from rillflow.operators import reports as rp
from rillflow.operators import search as se

NEEDLE = "THE"


def recent(spark, sf):
    rows = se.list_recent(v.doc_signals(spark, sf), source="src3", limit=50)
    return rows.select("id", "title", iso_utc(F.col("created_at")).alias("created_at"))


def recent_kind(spark, sf):
    rows = se.list_recent(v.doc_signals(spark, sf), kind="post", instance="en", limit=25)
    return rows.select("id", "source", iso_utc(F.col("created_at")).alias("created_at"))


def search_page(spark, sf):
    page, _ = se.search(v.doc_signals(spark, sf), NEEDLE, limit=50, offset=25)
    return se.search_view(page)


def search_totals(spark, sf):
    return se.search(v.doc_signals(spark, sf), NEEDLE, limit=50, offset=25)[1]


def search_filtered(spark, sf):
    page, _ = se.search(v.doc_signals(spark, sf), "e", source="src5", kind="story", limit=200)
    return se.search_view(page).select("id", "content_truncated", "collected_at")


def search_literal(spark, sf):
    """Wildcards of pattern languages are ordinary characters."""
    rows = v.doc_signals(spark, sf).withColumn(
        "title", F.when(F.col("author").isNull(), "100% coverage").otherwise("100x coverage")
    ).withColumn("content", F.lit(""))
    return se.search(rows, "0%")[1].select("total")


def detail(spark, sf):
    rows = v.doc_signals(spark, sf)
    q = F.col("seq") % 4
    odd = (
        F.when(q == 0, F.col("metadata_json")).when(q == 1, "[1,2]").when(q == 2, "{broken").otherwise("")
    )
    return se.event_detail(rows.withColumn("metadata_json", odd), rows.select("id")).select(
        "id", "source_key", "content", "content_truncated", "title", "author", "updated_at", "metadata"
    )


def preview(spark, sf):
    return se.preview(v.doc_signals(spark, sf))


def links(spark, sf):
    return v.table(spark, sf, "pages").select(
        "page_id", se.safe_link(F.col("url")).alias("link"),
        se.safe_link(F.concat(F.lit("javascript:"), "url")).alias("bad_link"),
    )


def page_text(spark, sf):
    return v.table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


def activity(spark, sf):
    return rp.activity(v.doc_signals(spark, sf), v.ts("2024-02-01 12:00:00"))


def facets(spark, sf):
    return rp.facets(v.doc_signals(spark, sf))


_HIT = (
    "(contains(translate(title, u, l), 'the') OR contains(translate(content, u, l), 'the') OR "
    "contains(coalesce(translate(author, u, l), ''), 'the') OR contains(translate(url, u, l), 'the'))"
)
_FOLD = ", hits AS (SELECT * FROM (SELECT *, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l FROM sig) WHERE " + _HIT + ")"
_ROW = f"""id, schema_version, source, source_instance, source || ':' || source_instance AS source_key, kind,
  nullif(title, '') AS title, substr(content, 1, 600) AS content, length(content) > 600 AS content_truncated,
  author, url, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at, {iso('collected_at')} AS collected_at"""

# Markup tokens as in the text function, without the possessive quantifiers DuckDB has no need of.
_TOKENS = (
    "(?is)<!--.*?-->|<(?:script|style)\\b[^>]*>.*?</(?:script|style)\\s*>"
    "|</?[a-z](?:[^>\"'']+|\"[^\"]*\"|''[^'']*'')*>|<[!?/][^>]*>|[^<]+|<"
)
_RAW = "(?is)^<(?:script|style)\\b.*</(?:script|style)\\s*>$"


def _entities(column: str) -> str:
    """The entities the provided pages hold, the ampersand last."""
    out = column
    for name, char in (("copy", 169), ("middot", 183)):
        out = f"replace({out}, '&{name};', chr({char}))"
    return f"regexp_replace(replace({out}, '&quot;', '\"'), '&amp;?', '&', 'g')"


_TEXT = f"""SELECT page_id, trim(regexp_replace(replace({_entities('joined')}, chr(1), '&'), '\\s+', ' ', 'g')) AS text FROM (
  SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, '{_TOKENS}'), lambda t:
    CASE WHEN regexp_matches(t, '{_RAW}') THEN replace(regexp_replace(t, '(?is)^<[^>]*>|</[a-z]+\\s*>$', '', 'g'), '&', chr(1))
      WHEN regexp_matches(t, '(?s)^<.+') THEN '' ELSE t END), lambda p: trim(p) <> ''), ' ') AS joined FROM pages)"""

QUERIES = {
    "list_recent": (
        recent,
        with_parts("sig", f"SELECT id, title, {iso('created_at')} AS created_at FROM sig WHERE source = 'src3' ORDER BY sig.created_at DESC, sig.collected_at DESC, id DESC LIMIT 50"),
    ),
    "list_recent_kind": (
        recent_kind,
        with_parts("sig", f"SELECT id, source, {iso('created_at')} AS created_at FROM sig WHERE kind = 'post' AND source_instance = 'en' ORDER BY sig.created_at DESC, sig.collected_at DESC, id DESC LIMIT 25"),
    ),
    "search_page": (
        search_page,
        with_parts("sig", f"{_FOLD} SELECT {_ROW} FROM hits ORDER BY hits.collected_at DESC, hits.created_at DESC, id DESC LIMIT 50 OFFSET 25"),
    ),
    "search_totals": (
        search_totals,
        with_parts("sig", f"{_FOLD} SELECT count(*) AS total, 50 AS \"limit\", 25 AS \"offset\", least(count(*), 75) < count(*) AS has_more FROM hits"),
    ),
    "search_filtered": (
        search_filtered,
        with_parts("sig", f"""SELECT id, length(content) > 600 AS content_truncated, {iso('collected_at')} AS collected_at FROM sig
          WHERE source = 'src5' AND kind = 'story' AND (contains(lower(title), 'e') OR contains(lower(content), 'e')
            OR contains(lower(coalesce(author, '')), 'e') OR contains(lower(url), 'e'))
          ORDER BY sig.collected_at DESC, sig.created_at DESC, id DESC LIMIT 200"""),
    ),
    "search_literal": (search_literal, with_parts("sig", "SELECT count(*) AS total FROM sig WHERE author IS NULL")),
    "event_detail": (
        detail,
        with_parts("sig", f"""SELECT id, source || ':' || source_instance AS source_key, content, false AS content_truncated,
          nullif(title, '') AS title, author, {iso('updated_at')} AS updated_at,
          CASE seq % 4 WHEN 0 THEN metadata_json WHEN 1 THEN '{{"value":[1,2]}}'
            WHEN 2 THEN '{{"_error":"stored metadata is not valid JSON"}}' ELSE '{{}}' END AS metadata FROM sig"""),
    ),
    "preview_lines": (
        preview,
        with_parts("sig", """SELECT id, preview, rpad(source || ':' || source_instance, 22, ' ') || ' ' || rpad(kind, 14, ' ') || ' '
          || rpad(coalesce(author, '-'), 18, ' ') || ' ' || preview AS line FROM (
          SELECT *, CASE WHEN length(t) > 48 THEN substr(t, 1, 45) || '...' ELSE t END AS preview FROM (
          SELECT *, trim(regexp_replace(coalesce(nullif(title, ''), content), '\\s+', ' ', 'g')) AS t FROM sig))"""),
    ),
    "safe_links": (
        links,
        "SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://[^\\s/]') THEN url END AS link, CAST(NULL AS VARCHAR) AS bad_link FROM pages",
    ),
    "html_text": (page_text, _TEXT),
    "activity": (
        activity,
        with_parts("sig", """SELECT count(*) FILTER (WHERE collected_at >= TIMESTAMP '2024-02-01 11:00:00') AS last_hour,
          count(*) FILTER (WHERE collected_at >= TIMESTAMP '2024-01-31 12:00:00') AS last_24h FROM sig"""),
    ),
    "facets": (
        facets,
        with_parts("sig", "SELECT DISTINCT 'source' AS facet, source AS value FROM sig UNION ALL SELECT DISTINCT 'kind', kind FROM sig"),
    ),
}
