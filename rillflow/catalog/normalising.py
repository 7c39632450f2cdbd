"""Queries that render the tables as payloads and normalise them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillflow.catalog import payloads as p
from rillflow.catalog.twins import after, iso, js, sid
from rillflow.catalog.views import table
from rillflow.functions import html_to_text, iso_utc, parse_epoch, parse_iso, parse_mail_date
from rillflow.sources import feeds, issues, jsonfeed, listings, mapped, payloads, registry, stories

COLUMNS = ("payload_id", "pos", "external_id", "id", "kind", "title", "content", "author", "url")


def show(df: DataFrame) -> DataFrame:
    return df.select(
        *[c for c in COLUMNS if c not in ("payload_id", "pos")],
        F.col("payload_id"), F.col("pos").cast("int").alias("pos"),
        iso_utc(F.col("created_at")).alias("created_at"), iso_utc(F.col("updated_at")).alias("updated_at"),
        "metadata_json",
    )


def jsonfeed_signals(spark, sf):
    return show(jsonfeed.normalize(p.jsonfeed_payloads(spark, sf))[0])


def jsonfeed_problems(spark, sf):
    problems = jsonfeed.normalize(p.jsonfeed_payloads(spark, sf))[1]
    broken = p.jsonfeed_payloads(spark, sf).withColumn(
        "body",
        F.when(F.col("payload_id") % 3 == 0, F.replace("body", F.lit("jsonfeed.org/version/1"), F.lit("x/2")))
        .when(F.col("payload_id") % 3 == 1, F.substring("body", 1, 50))
        .otherwise('{"version":"https://jsonfeed.org/version/1","items":{}}'),
    )
    both = problems.unionByName(jsonfeed.parse_jsonfeed(broken)[1])
    return both.groupBy("level", "message").agg(F.count("*").alias("n"))


def rss_signals(spark, sf):
    return show(feeds.normalize(p.rss_payloads(spark, sf))[0])


def atom_signals(spark, sf):
    return show(feeds.normalize(p.atom_payloads(spark, sf))[0])


def feed_dispatch(spark, sf):
    """Both formats and a page of HTML in one table."""
    html = p.rss_payloads(spark, sf).withColumn("body", F.lit("<html><body>no feed</body></html>"))
    every = p.rss_payloads(spark, sf).unionByName(p.atom_payloads(spark, sf)).unionByName(html)
    entries, errors = feeds.parse_feed(every)
    good = entries.groupBy(F.col("source_instance").alias("what")).agg(F.count("*").alias("n"))
    return good.unionByName(errors.groupBy(F.col("message").alias("what")).agg(F.count("*").alias("n")))


def mapped_signals(spark, sf):
    mapping = mapped.mapping_from_options(p.MAPPING)
    return show(mapped.normalizer(mapping)(p.mapped_payloads(spark, sf))[0])


def mapped_rejections(spark, sf):
    """One bad time rejects its whole page."""
    mapping = mapped.mapping_from_options({**p.MAPPING, "created_at_path": "node.title"})
    items, errors = mapped.parse_mapped(p.mapped_payloads(spark, sf), mapping)
    return errors.groupBy("message").agg(F.count("*").alias("n")).withColumn(
        "items_left", items.agg(F.count("*")).scalar()
    )


def search_signals(spark, sf):
    return show(issues.normalize_github_items(issues.parse_search(p.search_payloads(spark, sf))[0]))


def search_problems(spark, sf):
    return issues.parse_search(p.search_payloads(spark, sf))[1].groupBy("level", "message").agg(F.count("*").alias("n"))


def issue_comments(spark, sf):
    items, _ = issues.parse_search(p.search_payloads(spark, sf))
    comments = issues.parse_comments(p.issue_comment_payloads(spark, sf), 3)
    return show(issues.normalize_github_comments(comments, issues.issue_keys(items)))


def issue_comments_all(spark, sf):
    items, _ = issues.parse_search(p.search_payloads(spark, sf))
    comments = issues.parse_comments(p.issue_comment_payloads(spark, sf))
    return show(issues.normalize_github_comments(comments, issues.issue_keys(items)))


def posts(spark, sf):
    return show(listings.normalize_reddit_posts(listings.parse_posts(p.listing_payloads(spark, sf))[0]))


def post_comments(spark, sf):
    comments, _ = listings.parse_comment_pages(p.thread_payloads(spark, sf), 3)
    return show(listings.normalize_reddit_comments(comments))


def post_comments_all(spark, sf):
    comments, _ = listings.parse_comment_pages(p.thread_payloads(spark, sf))
    return show(listings.normalize_reddit_comments(comments))


def truncated_threads(spark, sf):
    return listings.parse_comment_pages(p.thread_payloads(spark, sf), 3)[1].select("post_id", "truncated")


def story_signals(spark, sf):
    items, _ = stories.parse_items(p.story_payloads(spark, sf))
    return show(stories.normalize_hn_stories(items))


def story_comments(spark, sf):
    items, _ = stories.parse_items(p.story_payloads(spark, sf))
    return show(stories.normalize_hn_comments(items))


def every_source(spark, sf):
    """All source types of one payload table through the registry."""
    tables = [
        p.jsonfeed_payloads, p.rss_payloads, p.atom_payloads, p.search_payloads, p.issue_comment_payloads,
        p.listing_payloads, p.thread_payloads, p.story_payloads,
    ]
    every = tables[0](spark, sf)
    for t in tables[1:]:
        every = every.unionByName(t(spark, sf))
    signals, _ = registry.normalize_payloads(every, registry.default_sources())
    return signals.groupBy("source", "kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def unmodified(spark, sf):
    """Every other page answers 304 and keeps the validators of the last changed one."""
    polls = p.jsonfeed_payloads(spark, sf).withColumn(
        "http_status", F.when(F.col("payload_id") % 2 == 1, 304).otherwise(200)
    )
    changed, same = payloads.drop_unmodified(polls)
    return payloads.next_validators(polls).select(
        "source_key", "etag", "last_modified",
        changed.agg(F.count("*")).scalar().alias("changed"), same.agg(F.count("*")).scalar().alias("same"),
    )


def times(spark, sf):
    e = F.col("event_id")
    at = F.col("ts").cast("timestamp")
    rendered = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.element_at(
            F.array(*[F.lit(z) for z in (" GMT", " +0200", " EST", " -0330", " XYZ", "")]), (e % 6 + 1).cast("int"))).alias("mail"),
        F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(
            F.array(*[F.lit(z) for z in ("Z", "+02:00", "-0330", "", " junk")]), (e % 5 + 1).cast("int"))).alias("iso_text"),
        F.when(e % 4 == 0, "no number").otherwise(F.unix_timestamp(at).cast("string")).alias("epoch_text"),
    )
    return rendered.select(
        "event_id", iso_utc(parse_mail_date(F.col("mail"))).alias("from_mail"),
        iso_utc(parse_iso(F.col("iso_text"))).alias("from_iso"),
        iso_utc(parse_epoch(F.col("epoch_text"))).alias("from_epoch"),
    )


def markup_of_documents(spark, sf):
    html = F.concat(F.lit("<div><b>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</b><!-- x --></div>"))
    return table(spark, sf, "documents").select("doc_id", html_to_text(html).alias("text"))


_TITLE = "substr(split_part(text, chr(10), 1), 1, 80)"
_FLAT = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_CREATED, _MODIFIED = after("doc_id * 37"), f"CASE WHEN doc_id % 3 <> 0 THEN {after('doc_id * 37 + 86400')} END"
_AUTHOR5 = "CASE WHEN doc_id % 5 <> 0 THEN 'author-' || (doc_id % 97) END"
_AUTHOR4 = "CASE WHEN doc_id % 4 <> 0 THEN 'author-' || (doc_id % 97) END"
_LINK = "'https://docs.example.org/' || doc_id"
_PLACE = "doc_id // 20 AS payload_id, CAST(doc_id % 20 AS INTEGER) AS pos"


def _docs(external: str, kind: str, source: str, instance: str, content: str, author: str, updated: str, meta: str, title: str) -> str:
    return f"""SELECT external_id, {sid(f"'{source}'", 'external_id', f"'{kind}'", f"'{instance}'")} AS id, '{kind}' AS kind,
      {title} AS title, {content} AS content, {author} AS author, {_LINK} AS url, {_PLACE},
      {iso(_CREATED)} AS created_at, {iso(updated)} AS updated_at, {meta} AS metadata_json
      FROM (SELECT *, {external} AS external_id, {_AUTHOR5} AS a5 FROM documents)"""


_JSONFEED_META = f"""'{{"attachments":[],"authors":' || CASE WHEN a5 IS NULL THEN '[]' ELSE '["' || a5 || '"]' END
  || ',"external_id":"' || external_id || '","external_url":null,"feed_title":"Docs","feed_url":"https://docs.example.org/feed.json","language":'
  || {js('lang')} || ',"tags":[' || {js('lang')} || ',' || {js('source')} || ']}}'"""


def _feed_meta(url: str, tags: str) -> str:
    return f"""'{{"external_id":"' || external_id || '","feed_title":"Docs","feed_url":"{url}","tags":[' || {tags} || ']}}'"""


_TURN = "FROM (SELECT *, conv_id * 100 + turn AS doc_id FROM conversations)"

def _issue_comments_sql(where: str, pos: str) -> str:
    """Comments on orders as issues; a conversation without an order has no known parent."""
    parent = sid("'github'", "parent", "pkind", "'search-orders'")
    return f"""SELECT external_id, {sid("'github'", 'external_id', "'comment'", "'search-orders'")} AS id, 'comment' AS kind,
      CAST(NULL AS VARCHAR) AS title, text AS content, role AS author,
      CASE WHEN known THEN 'https://example.org/i/' || conv_id ELSE repo END AS url,
      conv_id AS payload_id, CAST({pos} AS INTEGER) AS pos, {iso(after('doc_id'))} AS created_at,
      CAST(NULL AS VARCHAR) AS updated_at,
      '{{"external_id":"' || external_id || '","issue_number":' || conv_id || ',"parent_event_id":'
      || CASE WHEN known THEN '"' || {parent} || '"' ELSE 'null' END || ',"repository_url":"' || repo || '"}}' AS metadata_json
      FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN 'C' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS external_id,
        CASE WHEN conv_id % 10 <> 0 THEN 'N' || conv_id ELSE repo || '#' || conv_id END AS parent,
        CASE WHEN conv_id % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS pkind, conv_id IN (SELECT o_orderkey FROM orders) AS known
        FROM (SELECT *, conv_id * 100 + turn AS doc_id, max(turn) OVER (PARTITION BY conv_id) AS last,
          'https://api.example.org/repos/r' || conv_id % 7 AS repo FROM conversations)
        {where})"""


def _thread_comments_sql(where: str) -> str:
    return f"""SELECT external_id, {sid("'reddit'", 'external_id', "'comment'", "'r-chat-new'")} AS id, 'comment' AS kind,
          CAST(NULL AS VARCHAR) AS title, text AS content, role AS author, 'https://www.reddit.com/comments/' || conv_id AS url,
          conv_id AS payload_id, CAST(turn AS INTEGER) AS pos, {iso(after('doc_id'))} AS created_at, CAST(NULL AS VARCHAR) AS updated_at,
          '{{"external_id":"' || external_id || '","link_id":"t3_' || conv_id || '","native_id":"' || doc_id || '","parent_event_id":"'
          || {sid("'reddit'", "'t3_' || conv_id", "'post'", "'r-chat-new'")} || '","parent_id":null,"post_id":"' || conv_id
          || '","score":' || turn || ',"subreddit":"chat"}}' AS metadata_json
          FROM (SELECT *, 't1_' || (conv_id * 100 + turn) AS external_id, conv_id * 100 + turn AS doc_id FROM conversations) {where}"""


QUERIES = {
    "jsonfeed_signals": (
        jsonfeed_signals,
        _docs("CAST(doc_id AS VARCHAR)", "article", "jsonfeed", "docs",
              f"CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE {_FLAT.format('text')} END", "a5", _MODIFIED,
              _JSONFEED_META, f"nullif(trim({_TITLE}), '')"),
    ),
    "jsonfeed_problems": (
        jsonfeed_problems,
        """WITH pages AS (SELECT DISTINCT doc_id // 20 AS page FROM documents)
        SELECT 'warning' AS level, 'skipped a feed item that is no object' AS message, count(*) AS n FROM pages
        UNION ALL SELECT 'warning', 'skipped a feed item without an id', count(*) FROM pages
        UNION ALL SELECT 'error', ['cannot read feed version: https://x/2.1', 'feed body is no JSON',
          'feed items are no list'][CAST(page % 3 + 1 AS INTEGER)], count(*) FROM pages GROUP BY page % 3""",
    ),
    "rss_signals": (
        rss_signals,
        _docs("'doc-' || doc_id", "article", "rss", "docs", _FLAT.format("text"), _AUTHOR4, "CAST(NULL AS TIMESTAMP)",
              _feed_meta("https://docs.example.org/rss", f"{js('lang')} || ',' || {js('source')}"), f"nullif({_FLAT.format(_TITLE)}, '')"),
    ),
    "atom_signals": (
        atom_signals,
        _docs("'doc-' || doc_id", "article", "rss", "atom", _FLAT.format("text"), _AUTHOR4, f"coalesce({_MODIFIED}, {_CREATED})",
              _feed_meta("https://docs.example.org/atom", js("lang")), f"nullif({_FLAT.format(_TITLE)}, '')"),
    ),
    "feed_dispatch": (
        feed_dispatch,
        """SELECT 'docs' AS what, count(*) AS n FROM documents UNION ALL SELECT 'atom', count(*) FROM documents
        UNION ALL SELECT 'unsupported feed root element: html', count(DISTINCT doc_id // 20) FROM documents""",
    ),
    "mapped_signals": (
        mapped_signals,
        _docs("CAST(doc_id AS VARCHAR)", "post", "rest", "docs", "text", "a5", _MODIFIED,
              f"""'{{"external_id":"' || external_id || '","lang":' || {js('lang')} || ',"tags":[' || {js('lang')} || ',' || {js('source')} || ']}}'""",
              f"nullif({_TITLE}, '')"),
    ),
    "mapped_rejections": (
        mapped_rejections,
        "SELECT 'an item has no readable time at ''node.title''' AS message, count(DISTINCT doc_id // 20) AS n, CAST(0 AS BIGINT) AS items_left FROM documents",
    ),
    "issue_signals": (
        search_signals,
        f"""SELECT external_id, {sid("'github'", 'external_id', 'kind', "'search-orders'")} AS id, kind, 'Order ' || o AS title,
          o_orderpriority AS content, c_name AS author, 'https://example.org/i/' || o AS url, o // 20 AS payload_id,
          CAST(o % 20 AS INTEGER) AS pos, {iso('o_orderdate')} AS created_at, {iso('o_orderdate')} AS updated_at,
          '{{"comments":' || o % 4 || ',"external_id":"' || external_id || '","labels":["' || c_mktsegment || '"],"number":' || o
          || ',"repository_url":"' || repo || '","state":"' || o_orderstatus || '"}}' AS metadata_json
          FROM (SELECT *, CASE WHEN o % 10 <> 0 THEN 'N' || o ELSE repo || '#' || o END AS external_id,
            CASE WHEN o % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS kind
            FROM (SELECT *, o_orderkey AS o, 'https://api.example.org/repos/r' || o_orderkey % 7 AS repo
              FROM orders LEFT JOIN customer ON c_custkey = o_custkey))""",
    ),
    "issue_problems": (
        search_problems,
        """WITH pages AS (SELECT DISTINCT o_orderkey // 20 AS page FROM orders)
        SELECT 'warning' AS level, 'skipped a search result that is no object' AS message, count(*) AS n FROM pages
        UNION ALL SELECT 'warning', 'the search says that it left out matches', count(*) FROM pages WHERE page % 10 = 0""",
    ),
    "issue_comments": (issue_comments, _issue_comments_sql("WHERE last - turn < 3", "least(last, 2) - (last - turn)")),
    "issue_comments_all": (issue_comments_all, _issue_comments_sql("", "turn")),
    "listing_posts": (
        posts,
        f"""SELECT external_id, {sid("'reddit'", 'external_id', "'post'", "'r-chat-new'")} AS id, 'post' AS kind,
          'Conversation ' || c AS title, text AS content, role AS author,
          CASE WHEN c % 3 <> 0 THEN 'https://www.reddit.com/r/chat/comments/' || c ELSE 'https://x.example.org/' || c END AS url,
          c // 20 AS payload_id, CAST(pos AS INTEGER) AS pos, {iso(after('c * 60'))} AS created_at,
          CASE WHEN c % 4 = 0 THEN {iso(after('86400 + c'))} END AS updated_at,
          '{{"domain":null,"external_id":"' || external_id || '","is_self":true,"link_flair_text":null,"link_url":"https://x.example.org/' || c
          || '","locked":null,"native_id":"' || c || '","num_comments":null,"over_18":null,"permalink":"'
          || CASE WHEN c % 3 <> 0 THEN '/r/chat/comments/' || c ELSE '' END || '","score":' || c % 50
          || ',"stickied":null,"subreddit":"chat"}}' AS metadata_json
          FROM (SELECT *, conv_id AS c, 't3_' || conv_id AS external_id,
            row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id) - 1 AS pos FROM conversations WHERE turn = 0)""",
    ),
    "thread_comments": (post_comments, _thread_comments_sql("WHERE turn < 3")),
    "thread_comments_all": (post_comments_all, _thread_comments_sql("")),
    "truncated_threads": (
        truncated_threads,
        "SELECT CAST(conv_id AS VARCHAR) AS post_id, count(*) < 3 AS truncated FROM conversations GROUP BY conv_id",
    ),
    "story_signals": (
        story_signals,
        f"""SELECT external_id, {sid("'hackernews'", 'external_id', "'story'", "'newstories'")} AS id, 'story' AS kind,
          'Story & ' || conv_id AS title, coalesce(nullif({_FLAT.format('text')}, ''), 'Story & ' || conv_id) AS content, role AS author,
          'https://news.ycombinator.com/item?id=' || doc_id AS url, doc_id AS payload_id, 0 AS pos, {iso(after('doc_id'))} AS created_at,
          CAST(NULL AS VARCHAR) AS updated_at,
          '{{"descendants":null,"external_id":"' || external_id || '","hn_type":"story","score":' || conv_id % 10 || '}}' AS metadata_json
          FROM (SELECT *, CAST(doc_id AS VARCHAR) AS external_id {_TURN}) WHERE turn = 0 AND doc_id % 90 <> 1""",
    ),
    "story_comments": (
        story_comments,
        f"""SELECT external_id, {sid("'hackernews'", 'external_id', "'comment'", "'newstories'")} AS id, 'comment' AS kind,
          CAST(NULL AS VARCHAR) AS title, {_FLAT.format('text')} AS content, role AS author,
          'https://news.ycombinator.com/item?id=' || doc_id AS url, doc_id AS payload_id, 0 AS pos, {iso(after('doc_id'))} AS created_at,
          CAST(NULL AS VARCHAR) AS updated_at,
          '{{"external_id":"' || external_id || '","parent_event_id":"' || {sid("'hackernews'", 'CAST(conv_id * 100 AS VARCHAR)', "'story'", "'newstories'")}
          || '","parent_id":' || conv_id * 100 || ',"story_id":' || conv_id * 100 || '}}' AS metadata_json
          FROM (SELECT *, CAST(doc_id AS VARCHAR) AS external_id {_TURN}) WHERE turn > 0 AND doc_id % 90 <> 1""",
    ),
    "all_source_types": (
        every_source,
        """SELECT 'jsonfeed' AS source, 'article' AS kind, count(*) AS n, count(*) AS ids FROM documents
        UNION ALL SELECT 'rss', 'article', 2 * count(*), 2 * count(*) FROM documents
        UNION ALL SELECT 'github', CASE WHEN o_orderkey % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS k, count(*), count(*) FROM orders GROUP BY k
        UNION ALL SELECT 'github', 'comment', count(*), count(*) FROM conversations
        UNION ALL SELECT 'reddit', 'post', count(*), count(*) FROM conversations WHERE turn = 0
        UNION ALL SELECT 'reddit', 'comment', count(*), count(*) FROM conversations
        UNION ALL SELECT 'hackernews', CASE WHEN turn = 0 THEN 'story' ELSE 'comment' END AS k, count(*), count(*) FROM conversations
          WHERE (conv_id * 100 + turn) % 90 <> 1 GROUP BY k""",
    ),
    "unmodified_polls": (
        unmodified,
        """WITH pages AS (SELECT DISTINCT doc_id // 20 AS page FROM documents)
        SELECT 'jsonfeed:docs' AS source_key, 'e' || max(CASE WHEN page % 2 = 0 THEN page END) AS etag, CAST(NULL AS VARCHAR) AS last_modified,
          count(*) FILTER (WHERE page % 2 = 0) AS changed, count(*) FILTER (WHERE page % 2 = 1) AS same FROM pages""",
    ),
    "time_parsing": (
        times,
        f"""SELECT event_id,
          {iso("(s - to_seconds(CAST([0, 7200, -18000, -12600, 0, 0][CAST(event_id % 6 + 1 AS INTEGER)] AS BIGINT)))")} AS from_mail,
          CASE WHEN event_id % 5 <> 4 THEN {iso("(s - to_seconds(CAST([0, 7200, -12600, 0, 0][CAST(event_id % 5 + 1 AS INTEGER)] AS BIGINT)))")} END AS from_iso,
          CASE WHEN event_id % 4 <> 0 THEN {iso('s')} END AS from_epoch
          FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)""",
    ),
    "markup_of_documents": (
        markup_of_documents,
        f"SELECT doc_id, {_FLAT.format('text')} AS text FROM documents",
    ),
}
