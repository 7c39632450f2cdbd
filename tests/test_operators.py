"""Rules that want hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from rillflow.functions import age_text, cursor_json, html_to_text, initials, join_authors, parse_cursor, strip, truncate
from rillflow.operators import contract, incremental, outbox, requests, search, sinks, verify
from rillflow.schemas import DELIVERIES, SIGNALS, TABLES
from rillflow.sources.registry import Registry


def one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0]["x"]


def test_text_helpers(spark):
    assert one(spark, strip(F.lit("  a b \n"))) == "a b"
    assert one(spark, initials(F.lit("hacker-news"))) == "HN"
    assert one(spark, initials(F.lit(""))) == "?"
    assert one(spark, truncate(F.lit("a  b"), 10)) == "a b"
    assert one(spark, truncate(F.lit("x" * 20), 10)) == "x" * 9 + "…"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    ages = {30: "30 seconds ago", 60: "1 minute ago", 7200: "2 hours ago", 86400 * 3: "3 days ago"}
    for seconds, text in ages.items():
        assert one(spark, age_text(F.timestamp_seconds(F.unix_timestamp(now) - seconds), now)) == text
    people = F.array(F.struct(F.lit(" ").alias("name"), F.lit("u").alias("url")))
    assert one(spark, join_authors(F.array().cast("array<struct<name:string,url:string>>"), people)) == ["u"]


def test_markup_edges(spark):
    cases = {
        "a<b>b</b>c": "a b c", "about AT&T": "about AT&T", "<!-- x -->t": "t", "a < b": "a < b", "x&nbsp;&eacute;": "x é",
        "<script>if (a<b) { c('&amp;') }</script>d": "if (a<b) { c('&amp;') } d", "<a title='x>y'>q</a>": "q",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "h string, want string")
    assert df.filter(html_to_text(F.col("h")) != F.col("want")).count() == 0


def test_cursors(spark):
    text = one(spark, cursor_json(F.lit('a:"b"'), F.lit('{"z":1,"a":[2]}')))
    assert json.loads(text) == {"source_key": 'a:"b"', "state": {"a": [2], "z": 1}, "version": 1}
    for bad in ("[1]", "nope", '{"source_key":" "}', '{"source_key":"a","version":0}'):
        assert one(spark, parse_cursor(F.lit(bad))["valid"]) is False
    assert one(spark, parse_cursor(F.lit('{"source_key":"a"}'))["version"]) == 1


def test_retry_policy(spark):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert one(spark, requests.retry_after(F.lit("-3"), at)) == 0
    assert one(spark, requests.retry_after(F.lit("Mon, 01 Jan 2024 00:00:30 GMT"), at)) == 30
    assert one(spark, requests.retry_after(F.lit("soon"), at)) is None
    none = F.lit(None).cast("double")
    assert [one(spark, requests.retry_delay(F.lit(n), none)) for n in (1, 2, 3, 9)] == [0.25, 0.5, 1.0, 8.0]
    assert one(spark, requests.retry_delay(F.lit(1), F.lit(30.0))) == 8.0
    spread = spark.range(200).select(requests.retry_delay(F.lit(3), none, jitter=0.2, seed=1).alias("d"))
    low, high = spread.agg(F.min("d"), F.max("d")).collect()[0]
    assert 0.8 <= low < high <= 1.2
    assert one(spark, requests.has_time_left(at, at, F.lit(0.1))) is False
    assert one(spark, requests.has_time_left(at, F.lit(None).cast("timestamp"), F.lit(9.0))) is True


def test_baseline_poll_completes_at_once(spark):
    rows = [(False, False, False, False, 1, 5, "a", "b"), (False, True, False, True, 1, 5, "a", "b"), (True, False, False, True, 1, 5, "a", None)]
    df = spark.createDataFrame(
        rows, "initialized boolean, backfill boolean, reached_known boolean, fully_scanned boolean, page int, page_items int, api_cursor string, next_cursor string",
    )
    got = incremental.next_mapped_state(df, "cursor").collect()
    assert [(r["complete"], r["next_api_cursor"]) for r in got] == [(True, None), (False, "b"), (True, None)]


def test_anchor_restart(spark):
    items = spark.createDataFrame(
        [("s", 1, i, x) for i, x in enumerate("nabcd")] + [("t", 1, i, x) for i, x in enumerate("abcd")],
        "source_key string, poll_id int, pos int, external_id string",
    )
    cursors = spark.createDataFrame([("s", 2, "b"), ("t", 2, "b")], "source_key string, offset int, page_anchor string")
    got = {r["source_key"]: (r["start"], r["warning"] is not None) for r in incremental.validate_anchor(items, cursors).collect()}
    assert got == {"s": (0, True), "t": (2, False)}


def test_contract_violations(spark):
    events = spark.createDataFrame([(1, "a", "s", "x"), (1, "a", "s", "x"), (2, "b", "other", "x"), (3, "c", "s", "x")],
                                   "page_id int, id string, source string, source_instance string").withColumns(
        {"kind": F.lit("post"), "url": F.lit("u"), "schema_version": F.lit(1), "created_at": F.current_timestamp()})
    limit = "struct<limit:bigint,remaining:bigint,retry_after:double>"
    pages = spark.createDataFrame([(1, 10, 1, False), (2, 10, 1, False), (3, 10, 2, True), (4, 10, 11, False)],
                                  "page_id int, limit int, primary_count int, has_more boolean").withColumns(
        {"source_key": F.lit("s:x"), "cursor_key": F.when(F.col("page_id") != 3, "s:x"), "previous_key": F.lit("s:x"), "rate_limit": F.lit(None).cast(limit)})
    ok, good, found = contract.quarantine_pages(events, pages)
    assert (ok.count(), good.count()) == (0, 0)
    assert sorted((r["page_id"], r["rule"]) for r in found.collect()) == [(1, "unique"), (2, "ownership"), (3, "page"), (4, "page")]


def test_layout_status():
    schemas = dict(TABLES)
    assert verify.layout_status(schemas, 1) == ("current", None)
    assert verify.layout_status(schemas, 0)[0] == "migration_required"
    assert verify.layout_status(schemas, 2)[0] == "future"
    del schemas["checkpoints"]
    assert verify.layout_status(schemas, 1) == ("invalid", "missing tables: checkpoints")


def test_search_is_literal(spark):
    rows = [("1", "100% coverage"), ("2", "100x coverage"), ("3", "CAFÉ")]
    df = spark.createDataFrame(rows, "id string, title string").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in SIGNALS.fields if f.name not in ("id", "title")}
    )
    for query, n in (("%", 1), ("COVERAGE", 2), ("café", 0), ("cafÉ", 1), (" ", 3), (None, 3)):
        assert search.search(df, query)[1].collect()[0]["total"] == n
    page, totals = search.search(df, None, limit=2, offset=0)
    assert page.count() == 2 and totals.collect()[0]["has_more"] is True


def test_jsonl_and_custom_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "t")], "id string, title string").withColumns(
        {f.name: F.lit(None).cast(f.dataType) for f in SIGNALS.fields if f.name not in ("id", "title", "metadata_json")}
    ).withColumn("metadata_json", F.lit('{"x":1}'))
    for _ in range(2):
        sinks.write_jsonl(df, str(tmp_path / "out"), batch_id=3)
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert len(lines) == 1 and json.loads(lines[0]["value"])["metadata"] == {"x": 1}
    registry = sinks.default_sinks()
    seen = []
    sinks.register_sink(registry, "mine", lambda d, b: seen.append((d.count(), b)))
    registry.get("MINE")(df, 7)
    assert seen == [(1, 7)]
    with pytest.raises(ValueError):
        sinks.register_sink(registry, "jsonl", print)
    assert Registry("x").types == ()


def test_replay_clears_dead_rows(spark):
    row = ("s", "e", "dead", 8, None, "boom", None, None)
    table, counts = outbox.replay_dead(spark.createDataFrame([row], DELIVERIES), F.current_timestamp(), "s")
    r = table.collect()[0]
    assert (r["status"], r["attempts"], r["last_error"]) == ("pending", 0, None)
    assert counts.collect()[0]["replayed"] == 1


def test_no_forbidden_plan_nodes(spark, sf_dir):
    """No registered query plans a cross join, and none collects a whole group on the driver."""
    from rillflow.catalog import catalog

    for name in ("ingest_and_report", "overview", "enqueue_documents", "classify_mutations", "source_health", "take_new"):
        plan = catalog()[name][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_archive_lines_that_are_no_events(spark):
    from rillflow.sources.archive import parse_archive

    good = '{"id":"a","source":"s","kind":"post","url":"u","created_at":"2024-01-01T00:00:00Z"}'
    lines = spark.createDataFrame([(x,) for x in (good, "", "{broken", "[1]", '{"id":" "}')], "value string")
    signals, problems = parse_archive(lines)
    row = signals.collect()[0]
    assert signals.count() == 1 and row["id"] == "a" and row["collected_at"] == row["created_at"]
    assert sorted(r["message"] for r in problems.collect()) == ["the event has no id", "the line is JSON but no object", "the line is no JSON"]


def test_nothing_open(spark):
    from rillflow.operators.search import attention

    health = spark.createDataFrame([("a", "healthy", None)], "source_key string, status string, last_error string")
    sinks = spark.createDataFrame([(0, 0)], "failed bigint, dead bigint")
    assert [r["title"] for r in attention(health, sinks).collect()] == ["Nothing open"]
    assert attention(health, sinks, "migration_required").count() == 1


def test_seen_window_has_a_floor(spark):
    from rillflow.operators.incremental import merge_seen

    prior = spark.createDataFrame([("s", f"p{i}", i) for i in range(80)], "source_key string, external_id string, rank bigint")
    new = spark.createDataFrame([("s", "n", 0)], "source_key string, external_id string, pos bigint")
    assert merge_seen(prior, new, 10).count() == 50
