"""V7 and V10: the provided tables rendered as the payloads of each source type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.catalog.views import EPOCH, PAGE, plus, table, ts
from rillflow.functions import iso_utc

FETCHED = "2024-03-01 00:00:00"


def _escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text",
        F.floor(d / PAGE).alias("page"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        plus(EPOCH, d * 37).alias("created"),
        F.when(d % 3 != 0, plus(EPOCH, d * 37 + 86400)).alias("modified"),
        F.concat(F.lit("https://docs.example.org/"), d.cast("string")).alias("link"),
    )


def _payloads(pages: DataFrame, source_type: str, url: Column, body: Column, source: Column, instance: Column) -> DataFrame:
    return pages.select(
        F.col("page").alias("payload_id"),
        F.lit(0).cast("bigint").alias("batch_id"),
        F.lit(source_type).alias("source_type"),
        source.alias("source"), instance.alias("source_instance"),
        url.alias("url"), F.lit(200).alias("http_status"),
        F.create_map(F.lit("ETag"), F.concat(F.lit("e"), F.col("page").cast("string"))).alias("headers"),
        body.alias("body"), ts(FETCHED).alias("fetched_at"), F.lit(1).alias("page_no"),
    )


def _pages(docs: DataFrame, rendered: Column) -> DataFrame:
    """At most twenty rendered items per page, in id order."""
    items = docs.select("page", F.struct("doc_id", rendered.alias("x")).alias("i"))
    return items.groupBy("page").agg(F.array_sort(F.collect_list("i")).alias("items"))


def _joined(separator: str) -> Column:
    return F.array_join(F.transform("items", lambda i: i["x"]), separator)


def jsonfeed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    item = F.to_json(
        F.struct(
            d.cast("string").alias("id"), F.col("link").alias("url"), "title",
            F.when(d % 2 == 0, F.col("text")).alias("content_text"),
            F.when(d % 2 == 1, F.concat(F.lit("<p>"), _escape(F.col("text")), F.lit("</p>"))).alias("content_html"),
            iso_utc(F.col("created")).alias("date_published"),
            iso_utc(F.col("modified")).alias("date_modified"),
            F.when(d % 5 != 0, F.array(F.struct(F.concat(F.lit("author-"), (d % 97).cast("string")).alias("name")))).alias("authors"),
            F.array(F.col("lang"), F.col("source")).alias("tags"),
            F.col("lang").alias("language"),
        )
    )
    body = F.concat(
        F.lit('{"version":"https://jsonfeed.org/version/1.1","title":"Docs","home_page_url":"https://docs.example.org","items":['),
        _joined(","), F.lit(',7,{"title":"no id"}]}'),
    )
    pages = _pages(_docs(spark, sf_dir), item)
    return _payloads(pages, "jsonfeed", F.lit("https://docs.example.org/feed.json"), body, F.lit("jsonfeed"), F.lit("docs"))


def rss_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions hold escaped HTML, as feeds do."""
    d = F.col("doc_id")
    item = F.concat(
        F.lit("<item><guid isPermaLink=\"false\">doc-"), d.cast("string"), F.lit("</guid><title>"),
        _escape(_escape(F.col("title"))), F.lit("</title><link>"), "link", F.lit("</link>"),
        F.when(d % 4 != 0, F.concat(F.lit("<dc:creator>author-"), (d % 97).cast("string"), F.lit("</dc:creator>"))).otherwise(""),
        F.lit("<category>"), "lang", F.lit("</category><category>"), "source", F.lit("</category><pubDate>"),
        F.date_format("created", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><description>"),
        _escape(F.concat(F.lit("<p>"), _escape(F.col("text")), F.lit("</p>"))), F.lit("</description></item>"),
    )
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>Docs</title>'),
        _joined(""), F.lit("</channel></rss>"),
    )
    pages = _pages(_docs(spark, sf_dir), item)
    return _payloads(pages, "rss", F.lit("https://docs.example.org/rss"), body, F.lit("rss"), F.lit("docs"))


def atom_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    item = F.concat(
        F.lit("<entry><id>doc-"), d.cast("string"), F.lit('</id><title type="html">'),
        _escape(_escape(F.col("title"))), F.lit('</title><link rel="self" href="https://x.example.org/self"/><link rel="alternate" href="'),
        "link", F.lit('"/>'),
        F.when(d % 4 != 0, F.concat(F.lit("<author><name>author-"), (d % 97).cast("string"), F.lit("</name></author>"))).otherwise(""),
        F.lit('<category term="'), "lang", F.lit('"/><updated>'), iso_utc(F.coalesce("modified", "created")),
        F.lit("</updated><published>"), iso_utc(F.col("created")), F.lit('</published><summary type="html">'),
        _escape(F.concat(F.lit("<p>"), _escape(F.col("text")), F.lit("</p>"))), F.lit("</summary></entry>"),
    )
    body = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>Docs</title>'), _joined(""), F.lit("</feed>")
    )
    pages = _pages(_docs(spark, sf_dir), item)
    return _payloads(pages, "rss", F.lit("https://docs.example.org/atom"), body, F.lit("rss"), F.lit("atom"))


MAPPING = {
    "url": "https://docs.example.org/api", "items_path": "data.items", "id_path": "node.id",
    "kind": "post", "source": "rest", "instance": "docs", "title_path": "node.title",
    "content_path": "node.body", "author_path": "node.users.0.login", "url_path": "node.link",
    "created_at_path": "node.created", "updated_at_path": "node.updated",
    "metadata_paths": {"lang": "node.lang", "tags": "node.tags", "none": "node.absent"},
}


def mapped_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    item = F.to_json(
        F.struct(
            F.struct(
                d.alias("id"), "title", F.col("text").alias("body"),
                F.when(d % 5 != 0, F.array(F.struct(F.concat(F.lit("author-"), (d % 97).cast("string")).alias("login")))).alias("users"),
                "link", iso_utc(F.col("created")).alias("created"),
                F.unix_timestamp("modified").alias("updated"), "lang",
                F.array("lang", "source").alias("tags"),
            ).alias("node")
        )
    )
    body = F.concat(F.lit('{"data":{"items":['), _joined(","), F.lit('],"next":null}}'))
    pages = _pages(_docs(spark, sf_dir), item)
    return _payloads(pages, "rest", F.lit(MAPPING["url"]), body, F.lit("rest"), F.lit("docs"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").join(customers, "o_custkey", "left").select(
        o.alias("doc_id"), F.floor(o / PAGE).alias("page"), "o_orderpriority", "o_orderstatus",
        "c_name", "c_mktsegment", F.col("o_orderdate").cast("timestamp").alias("created"),
    )


def search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issue-search pages, their customers as authors."""
    o = F.col("doc_id")
    stamp = F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    repo = F.concat(F.lit("https://api.example.org/repos/r"), (o % 7).cast("string"))
    item = F.to_json(
        F.struct(
            F.when(o % 10 != 0, F.concat(F.lit("N"), o.cast("string"))).alias("node_id"),
            repo.alias("repository_url"), o.alias("number"),
            F.concat(F.lit("Order "), o.cast("string")).alias("title"), F.col("o_orderpriority").alias("body"),
            F.concat(F.lit("https://example.org/i/"), o.cast("string")).alias("html_url"),
            stamp.alias("created_at"), stamp.alias("updated_at"), F.col("o_orderstatus").alias("state"),
            (o % 4).alias("comments"),
            F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.lit("").alias("name"))).alias("labels"),
            F.when(o % 3 == 0, F.struct(F.lit("x").alias("url"))).alias("pull_request"),
            F.struct(F.col("c_name").alias("login")).alias("user"),
        )
    )
    body = F.concat(
        F.lit('{"total_count":'), F.size("items").cast("string"), F.lit(',"incomplete_results":'),
        F.when(F.col("page") % 10 == 0, "true").otherwise("false"), F.lit(',"items":['), _joined(","), F.lit(',"bad"]}'),
    )
    pages = _pages(_orders(spark, sf_dir), item)
    return _payloads(pages, "github", F.lit("https://api.example.org/search/issues"), body, F.lit("github"), F.lit("search-orders"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", (c * 100 + F.col("turn")).alias("doc_id"), c.alias("page")
    )


def issue_comment_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the comment list, newest first, of the order with the same number."""
    turn = F.col("turn")
    item = F.to_json(
        F.struct(
            F.when(turn % 2 == 0, F.concat(F.lit("C"), F.col("doc_id").cast("string"))).alias("node_id"),
            F.col("doc_id").alias("id"), F.col("text").alias("body"),
            F.date_format(plus(EPOCH, F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
            F.struct(F.col("role").alias("login")).alias("user"),
        )
    )
    items = _turns(spark, sf_dir).select("page", F.struct((-turn).alias("doc_id"), item.alias("x")).alias("i"))
    pages = items.groupBy("page").agg(F.array_sort(F.collect_list("i")).alias("items"))
    url = F.concat(
        F.lit("https://api.example.org/repos/r"), (F.col("page") % 7).cast("string"),
        F.lit("/issues/"), F.col("page").cast("string"), F.lit("/comments"),
    )
    body = F.concat(F.lit("["), _joined(","), F.lit("]"))
    return _payloads(pages, "github", url, body, F.lit("github"), F.lit("search-orders"))


def listing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation as a post, the last element being no post."""
    c = F.col("conv_id")
    item = F.to_json(
        F.struct(
            F.lit("t3").alias("kind"),
            F.struct(
                c.cast("string").alias("id"),
                F.when(c % 2 == 0, F.concat(F.lit("t3_"), c.cast("string"))).alias("name"),
                F.concat(F.lit(" Conversation "), c.cast("string")).alias("title"),
                F.col("text").alias("selftext"), F.col("role").alias("author"), F.lit("chat").alias("subreddit"),
                F.when(c % 3 != 0, F.concat(F.lit("/r/chat/comments/"), c.cast("string"))).alias("permalink"),
                F.concat(F.lit("https://x.example.org/"), c.cast("string")).alias("url"),
                (1_704_067_200 + c * 60).alias("created_utc"),
                F.when(c % 4 == 0, 1_704_153_600 + c).otherwise(0).alias("edited"),
                (c % 50).alias("score"), F.lit(True).alias("is_self"),
            ).alias("data"),
        )
    )
    first = _turns(spark, sf_dir).filter("turn = 0").withColumn("page", F.floor(c / PAGE))
    pages = _pages(first, item)
    body = F.concat(
        F.lit('{"kind":"Listing","data":{"after":null,"children":['), _joined(","), F.lit(',{"kind":"t5","data":{}}]}}')
    )
    return _payloads(pages, "reddit", F.lit("https://oauth.example.org/r/chat/new"), body, F.lit("reddit"), F.lit("r-chat-new"))


def thread_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as comment pages: turns in order, then a note that more exist."""
    item = F.to_json(
        F.struct(
            F.lit("t1").alias("kind"),
            F.struct(
                F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"),
                F.col("role").alias("author"), F.lit("chat").alias("subreddit"),
                F.lit(False).alias("edited"), F.col("turn").alias("score"),
                (1_704_067_200 + F.col("doc_id")).alias("created_utc"),
                F.concat(F.lit("t3_"), F.col("conv_id").cast("string")).alias("link_id"),
            ).alias("data"),
        )
    )
    pages = _pages(_turns(spark, sf_dir), item)
    body = F.concat(
        F.lit('[{},{"data":{"children":['), _joined(","), F.lit(',{"kind":"more","data":{}}]}}]')
    )
    url = F.concat(F.lit("https://oauth.example.org/comments/"), F.col("page").cast("string"))
    return _payloads(pages, "reddit", url, body, F.lit("reddit"), F.lit("r-chat-new"))


def story_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as stories, later turns as comments on them; one item per payload."""
    turns = _turns(spark, sf_dir)
    story = F.col("turn") == 0
    c = F.col("conv_id") * 100
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = turns.join(sizes, "conv_id")
    kids = F.when(
        story & (F.col("last") > 0), F.transform(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.col("last"), F.lit(1))), lambda t: c + t)
    )
    body = F.to_json(
        F.struct(
            F.col("doc_id").alias("id"), F.when(story, "story").otherwise("comment").alias("type"),
            F.col("role").alias("by"), (1_704_067_200 + F.col("doc_id")).alias("time"),
            F.when(story, F.concat(F.lit("Story &amp; "), F.col("conv_id").cast("string"))).alias("title"),
            F.concat(F.lit("<p>"), _escape(F.col("text")), F.lit("</p>")).alias("text"),
            F.when(story, F.col("conv_id") % 10).alias("score"), kids.alias("kids"),
            F.when(~story, c).alias("parent"), F.when(F.col("doc_id") % 90 == 1, True).alias("deleted"),
        )
    )
    pages = rows.withColumn("page", F.col("doc_id"))
    url = F.concat(F.lit("https://api.example.org/item/"), F.col("doc_id").cast("string"))
    return _payloads(pages, "hackernews", url, body, F.lit("hackernews"), F.lit("newstories"))
