"""Comments and their issues in either order, over batches; what a batch reads for it."""

import itertools
import json

from pyspark.sql import functions as F

from rillflow.operators.store import Store, delete_path
from rillflow.schemas import RAW_PAYLOADS
from rillflow.sources.registry import default_sources
from rillflow.streaming import Ingest

REPO = "https://api.x/repos/r"
ISSUE = {"node_id": "N7", "number": 7, "title": "t", "repository_url": REPO, "html_url": "https://x/7", "created_at": "2024-01-01T00:00:00Z"}


def comments(number, ids, text="c", **more):
    rows = [{"id": i, "body": f"{text}{i}", "created_at": "2024-01-02T00:00:00Z", **more} for i in ids]
    return f"{REPO}/issues/{number}/comments", json.dumps(rows)


SEARCH = ("https://api.x/search", json.dumps({"items": [ISSUE]}))


def ingest_all(spark, store, batches, first=0):
    """``batches`` are lists of (url, body); their payloads count up."""
    ingest, n = Ingest(store, default_sources(), ["archive"]), itertools.count(first * 100)
    for batch, bodies in enumerate(batches, first):
        rows = [(next(n), 0, "github", "github", "a", url, 200, {}, body, None, 1) for url, body in bodies]
        frame = spark.createDataFrame(rows, RAW_PAYLOADS).withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("payload_id")))
        ingest.process(frame, batch)
    return ingest


def state(store):
    rows = store.current("signals", ["seq"]).select("id", "kind", "url", "content", "metadata_json", "event_hash").collect()
    return sorted(map(tuple, rows))


def waiting(store):
    return store.current("parked_comments").filter("waits").count()


def test_any_order_gives_one_state(spark, tmp_path):
    parts = [SEARCH, comments(7, range(3)), comments(8, range(50, 52)), comments(7, range(2, 5), html_url="https://x/own")]
    ends = []
    orders = [[[parts[0]], parts[1:]], [parts[1:3], [parts[0], parts[3]]]]
    for i, batches in enumerate(orders):
        store = Store(spark, str(tmp_path / str(i)))
        ingest_all(spark, store, batches)
        ends.append(state(store))
        assert waiting(store) == 2
    assert ends[0] == ends[1]
    issue = next(r[0] for r in ends[0] if r[1] == "issue")
    told = {r[3]: (json.loads(r[4])["parent_event_id"], r[2]) for r in ends[0] if r[1] == "comment"}
    assert told == {
        **{f"c{i}": (issue, "https://x/7") for i in range(2)}, **{f"c{i}": (issue, "https://x/own") for i in range(2, 5)},
        **{f"c{i}": (None, REPO) for i in (50, 51)},
    }


def test_late_issue_updates_and_queues_its_comments_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest_all(spark, store, [[comments(7, range(40))], [SEARCH], [comments(7, range(40))]])
    changes = store.log("changes", spark.read.parquet(store.path("changes", "ingest", 1)).drop("stream_id", "batch_id").schema)
    counts = {(r["version"], r["change"]): r["count"] for r in changes.groupBy("version", "change").count().collect()}
    assert counts == {(1, "inserted"): 40, (2, "inserted"): 1, (2, "updated"): 40, (3, "unchanged"): 40}
    assert waiting(store) == 0
    # The run of the search page brought one event; its comments are no events of that page.
    assert store.current("source_health").head()["total_events"] == 81
    at = {r[0] for r in store.current("signals", ["seq"]).filter("kind = 'comment'").select(F.unix_timestamp("collected_at")).collect()}
    assert at == {1_704_067_201}
    assert store.current("deliveries").count() == 41


def test_replayed_batch_and_compaction_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest = ingest_all(spark, store, [[comments(7, range(3))]])
    row = (100, 0, "github", "github", "a", *SEARCH[:1], 200, {}, SEARCH[1], None, 1)
    frame = spark.createDataFrame([row], RAW_PAYLOADS).withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_300)))
    ingest._stage(frame, 1)
    ingest._derive(frame, 1)
    assert waiting(store) == 3
    ingest.process(frame, 1)
    done = state(store)
    ingest.process(frame, 1)
    for table in ("issue_links", "parked_comments"):
        store.compact(table)
    assert state(store) == done and waiting(store) == 0
    ingest_all(spark, store, [[comments(7, range(9, 11))]], first=2)
    assert waiting(store) == 0 and len(state(store)) == 6


def test_store_without_the_tables_is_indexed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    ingest = ingest_all(spark, store, [[comments(8, [1])], [SEARCH]])
    for table in ("issue_links", "parked_comments"):
        delete_path(spark, store.path(table))
    ingest.index_parents(0)
    other = ("https://api.x/search", json.dumps({"items": [{**ISSUE, "node_id": "N8", "number": 8}]}))
    ingest_all(spark, store, [[comments(7, [2]), other]], first=2)
    parents = [json.loads(r[4])["parent_event_id"] for r in state(store) if r[1] == "comment"]
    assert len(parents) == 2 and None not in parents


def test_orphans_read_no_signals(spark, tmp_path, monkeypatch):
    """A batch of comments whose issue never comes reads the stored signals by its own ids only."""
    store = Store(spark, str(tmp_path / "s"))
    ingest_all(spark, store, [[SEARCH]])
    asked = []
    current = Store.current

    def watch(self, table, *args, **kwargs):
        asked.append((table, kwargs.get("only")))
        return current(self, table, *args, **kwargs)

    monkeypatch.setattr(Store, "current", watch)
    ingest_all(spark, store, [[comments(8, range(5)), comments(7, [])]], first=1)
    assert {"issue_links", "parked_comments", "signals"} <= {t for t, _ in asked}
    assert all(only is not None for _, only in asked)
